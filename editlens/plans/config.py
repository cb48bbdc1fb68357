"""What an analysis is made of: filters, feature types, rules of actions, analyzers and regions; and the XML loader."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from .schema import HIERARCHY

GEOMETRIES = ("Point", "LineString", "Polygon")
ENTRY_POINTS = ("YES", "NO", "IF_FEATURE_TYPE_ADDED", "IF_FEATURE_TYPE_REMOVED")
#: Twelve hours.
ACTION_GAP_MS = 43_200_000
#: Feature types that always exist, for geometries that match no other.
INVALID_TYPES = {"Point": "invalidPoint", "LineString": "invalidLine", "Polygon": "invalidPolygon"}


@dataclass(frozen=True)
class FeatureType:
    name: str
    geometry: str  # Point, LineString or Polygon
    include: dict[str, tuple[str, ...]] = field(default_factory=dict)
    exclude: dict[str, tuple[str, ...]] = field(default_factory=dict)
    properties: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    operation_type: str
    entry_point: str = "YES"


@dataclass(frozen=True)
class ActionDefinition:
    name: str
    action_type: str  # CREATE, UPDATE or DELETE
    geometry_type: str = "UNDEFINED"
    rules: tuple[Rule, ...] = ()

    def ordered(self) -> tuple[Rule, ...]:
        """Rules from the highest hierarchy level down; of equal levels the last one first."""
        return tuple(reversed(sorted(self.rules, key=lambda r: HIERARCHY.get(r.operation_type, 0))))


@dataclass(frozen=True)
class Region:
    label: str
    wkt: str


@dataclass(frozen=True)
class Analyzer:
    name: str
    settings: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class AnalysisConfig:
    name: str = "Default"
    data_folder: str | None = None
    result_folder: str | None = None
    read_quadtree: bool = False
    filter_timestamp: datetime | None = None
    filter_tags: dict[str, tuple[str, ...]] | None = None
    filter_uid: int | None = None
    element_type: str = "UNDEFINED"
    start: datetime | None = None
    end: datetime | None = None
    temporal_resolution: str = "year"
    find_related: bool = False
    write_geometry: bool = False
    action_gap_ms: int = ACTION_GAP_MS
    only_feature_type_tags: bool = False
    #: Whether a closed way of two or three nodes is a line; else it has no geometry.
    short_rings: bool = False
    feature_types: tuple[FeatureType, ...] = ()
    actions: tuple[ActionDefinition, ...] = ()
    analyzers: tuple[Analyzer, ...] = ()
    regions: tuple[Region, ...] = ()

    def with_(self, **changes) -> "AnalysisConfig":
        return replace(self, **changes)

    def feature_type(self, name: str) -> FeatureType:
        return next(t for t in self.feature_types if t.name == name)


def _tags(elements) -> dict[str, tuple[str, ...]]:
    """Values of each key; an empty value stands for every value, unless the key has others too."""
    out: dict[str, list[str]] = {}
    for e in elements:
        values = out.setdefault(e.get("key"), [])
        if (v := e.get("value") or "") and v not in values:
            values.append(v)
    return {k: tuple(v) for k, v in out.items()}


def _time(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc) if text else None


def _flag(text: str | None, default: bool) -> bool:
    return default if text is None else text.strip().lower() == "true"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def expand(text: str | None, properties: dict[str, str]) -> str | None:
    """Replaces %name% by the property of that name; unknown ones stay."""
    return text and re.sub(r"%([^%]+)%", lambda m: properties.get(m[1], m[0]), text)


def load_settings(source: str, properties: dict[str, str] | None = None) -> AnalysisConfig:
    """Reads an XML profile (a path or the document itself). A feature type's name may be used once only."""
    root = ET.fromstring(source) if source.lstrip().startswith("<") else ET.parse(source).getroot()
    properties = {"userdir": os.path.expanduser("~"), **(properties or {})}
    for e in root.iter():
        e.tag = _local(e.tag)
    general = root.find("general")
    if general is None or not general.get("pbfDataFolder"):
        raise ValueError("general/pbfDataFolder is required")
    filters = root.find("filterTags")
    analysis = root.find("analysis")
    attr = (lambda k: analysis.get(k)) if analysis is not None else (lambda k: None)
    of = (lambda k: analysis.findall(k)) if analysis is not None else (lambda k: [])
    types, seen = [], set()
    for e in of("featureType"):
        if e.get("name") in seen:
            raise ValueError(f"feature type {e.get('name')!r} is defined twice")
        seen.add(e.get("name"))
        if e.get("geometryType") not in GEOMETRIES:
            raise ValueError(f"geometry type {e.get('geometryType')!r} is unknown")
        types.append(FeatureType(e.get("name"), e.get("geometryType"), _tags(e.findall("includeTag")), _tags(e.findall("excludeTag")), tuple(p.get("key") for p in e.findall("property"))))
    actions = tuple(
        ActionDefinition(e.get("name"), e.get("actionType"), e.get("geometryType") or "UNDEFINED", tuple(Rule(r.get("operationType"), r.get("entryPoint") or "YES") for r in e.findall("definitionRule")))
        for e in of("actionDefinition")
    )
    analyzers = tuple(Analyzer(e.get("name"), {s.get("key"): s.get("value") or "" for s in e.findall("analysisSetting")}) for e in of("analysisSubject"))
    polygons = root.find("filterPolygons")
    regions = tuple(Region(p.get("label") or "", p.get("geometry")) for p in (polygons.findall("polygon") if polygons is not None else []) if p.get("geometry"))
    return AnalysisConfig(
        name=general.get("settingName") or "Default",
        data_folder=expand(general.get("pbfDataFolder"), properties),
        result_folder=expand(general.get("resultFolder"), properties),
        read_quadtree=_flag(general.get("readQuadtree"), False),
        filter_timestamp=_time(general.get("filterTimestamp")),
        filter_tags=_tags(filters.findall("includeTag")) if filters is not None else None,
        element_type=attr("filterElementType") or "UNDEFINED",
        start=_time(attr("analysisStartDate")),
        end=_time(attr("analysisEndDate")),
        temporal_resolution=attr("temporalResolution") or "year",
        find_related=_flag(attr("findRelatedOperations"), False),
        write_geometry=_flag(attr("writeGeometryFiles"), False),
        action_gap_ms=int(attr("actionTimeBuffer") or ACTION_GAP_MS),
        feature_types=tuple(types),
        actions=actions,
        analyzers=analyzers,
        regions=regions,
    )


def default_config(**changes) -> AnalysisConfig:
    """Feature types and rules that cover points and lines, as in everyday profiles."""
    rule = lambda kinds, entry="YES": tuple(Rule(f"OP_{k}", entry) for k in kinds.split())
    feature_types = (
        FeatureType("street", "LineString", {"highway": ()}, {}, ("highway", "name", "ref", "maxspeed")),
        FeatureType("building", "Polygon", {"building": ()}, {"building": ("no",)}, ("building", "name")),
        FeatureType("buildingPoint", "Point", {"building": ()}, {"building": ("no",)}, ("building", "name")),
        FeatureType("amenity", "Point", {"amenity": ()}, {}, ("amenity", "name")),
        FeatureType("natural", "Point", {"natural": ("_value",)}, {}, ("natural",)),
    )
    actions = (
        ActionDefinition("AC_CREATE_POINT", "CREATE", "POINT", rule("RECREATE_NODE CREATE_NODE") + rule("ADD_TAG MODIFY_TAG_VALUE", "IF_FEATURE_TYPE_ADDED")),
        ActionDefinition("AC_CREATE_LINE", "CREATE", "LINE", rule("RECREATE_WAY CREATE_WAY") + rule("ADD_TAG MODIFY_TAG_VALUE", "IF_FEATURE_TYPE_ADDED") + rule("ADD_NODE", "NO")),
        ActionDefinition("AC_DELETE_POINT", "DELETE", "POINT", rule("DELETE_NODE") + rule("REMOVE_TAG MODIFY_TAG_VALUE", "IF_FEATURE_TYPE_REMOVED")),
        ActionDefinition("AC_DELETE_LINE", "DELETE", "LINE", rule("DELETE_WAY") + rule("REMOVE_TAG MODIFY_TAG_VALUE", "IF_FEATURE_TYPE_REMOVED") + rule("REMOVE_NODE", "NO")),
        ActionDefinition("AC_UPDATE_POINT", "UPDATE", "POINT", rule("ADD_TAG MODIFY_TAG_VALUE REMOVE_TAG MODIFY_COORDINATE")),
        ActionDefinition("AC_UPDATE_LINE", "UPDATE", "LINE", rule("SPLIT_WAY MERGE_WAY ADD_TAG MODIFY_TAG_VALUE REMOVE_TAG REVERSE_WAY ADD_NODE REMOVE_NODE REORDER_NODE MODIFY_WAY_COORDINATE")),
    )
    return AnalysisConfig(feature_types=feature_types, actions=actions).with_(**changes)
