"""Features at a point in time: tags by windows, geometry by folding a feature's operations in canonical order.

The fold streams partitions that are shuffled by feature and sorted within: a task holds the state of one feature, not
its history."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.config import INVALID_TYPES, AnalysisConfig, FeatureType
from ..plans.schema import OPERATION_COLUMNS, canonical_order
from .filters import FEATURE, TAG_SET

CLEARING = [f"OP_{a}_{b}" for a in ("CREATE", "DELETE", "RECREATE") for b in ("NODE", "WAY", "RELATION")]


class FeatureState:
    """What is known of a feature after some of its operations. Deletion keeps what was there; re-creation drops that."""

    def __init__(self):
        self.point = None
        #: [id, coordinate] of each node, and those of an id.
        self.nodes: list[list] = []
        self.of_id: dict[int, list[list]] = {}
        self.tags: dict[str, str] = {}
        self.members: list[tuple[str, int, str]] = []
        self.before_deletion: tuple | None = None
        self.visible = True

    def apply(self, op: dict) -> None:
        kind = op["operation_type"].removeprefix("OP_")
        at = (op["lon"], op["lat"]) if op["lon"] is not None and op["lat"] is not None else None
        ref, place = op["ref_id"], op["position"]
        if kind.startswith(("CREATE_", "RECREATE_")):
            self.before_deletion, self.visible = None, True
            if kind.endswith("_NODE") and at:
                self.point = at
        elif kind == "MODIFY_COORDINATE":
            self.point = at or self.point
        elif kind in ("DELETE_NODE", "DELETE_WAY", "DELETE_RELATION"):
            self.visible = False
            if kind != "DELETE_RELATION":
                self.before_deletion = (self.point, [tuple(n) for n in self.nodes], dict(self.tags))
                if kind == "DELETE_NODE":
                    self.point = None
        elif kind == "ADD_NODE":
            node = [ref, at]
            self.nodes.insert(max(place, 0), node)
            self.of_id.setdefault(ref, []).append(node)
        elif kind == "REMOVE_NODE":
            if 0 <= place < len(self.nodes):
                node = self.nodes.pop(place)
                own = self.of_id[node[0]]
                own.pop(next(i for i, n in enumerate(own) if n is node))
        elif kind == "REORDER_NODE":
            if 0 <= ref < len(self.nodes):
                self.nodes.insert(max(place, 0), self.nodes.pop(ref))
        elif kind == "MODIFY_WAY_COORDINATE":
            for node in self.of_id.get(ref, ()):
                node[1] = at
        elif kind in ("ADD_TAG", "MODIFY_TAG_VALUE"):
            self.tags[op["key"]] = op["value"]
        elif kind == "REMOVE_TAG":
            self.tags.pop(op["key"], None)
        elif kind == "ADD_MEMBER":
            self.members.insert(max(place, 0), (op["key"], ref, op["value"]))
        elif kind == "REMOVE_MEMBER":
            if 0 <= place < len(self.members):
                del self.members[place]
        elif kind == "REORDER_MEMBER":
            if 0 <= ref < len(self.members):
                self.members.insert(max(place, 0), self.members.pop(ref))
        elif kind == "MODIFY_ROLE" and 0 <= place < len(self.members):
            self.members[place] = (*self.members[place][:2], op["value"])

    @property
    def deleted(self) -> bool:
        return self.before_deletion is not None

    def seen(self) -> tuple:
        """(point, coordinates, tags), of a deleted feature those before."""
        point, nodes, tags = self.before_deletion or (self.point, self.nodes, self.tags)
        return point, [c for _, c in nodes if c is not None], tags

    def shapes(self, short_rings: bool = False) -> dict[str, list]:
        """Coordinates for each geometry type that the feature can have: a point, or a line, and a ring a polygon too.

        A ring of less than four is nothing, or with ``short_rings`` a line."""
        point, line, _ = self.seen()
        if point is not None:
            return {"Point": [point]}
        if len(line) < 2:
            return {}
        if line[0] != line[-1]:
            return {"LineString": line}
        if len(line) < 4:
            return {"LineString": line} if short_rings else {}
        return {"LineString": line, "Polygon": line}


def shape_wkt(kind: str, points: list) -> str:
    return geo.point_wkt(*points[0]) if kind == "Point" else geo.line_wkt(points) if kind == "LineString" else geo.polygon_wkt([points])


def exported_type(tags: dict[str, str], shapes: dict, types: tuple[FeatureType, ...]) -> tuple[str, str]:
    """(feature type, geometry) for export: the first type of the configuration that fits tags and geometry, else an invalid one."""
    for t in types:
        for key, values in t.include.items():
            value = tags.get(key)
            if value is not None and (not values or value in values) and value not in t.exclude.get(key, ()) and t.geometry in shapes:
                return t.name, t.geometry
    kind = next(k for k in ("Point", "Polygon", "LineString") if k in shapes)
    return INVALID_TYPES[kind], kind


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(key, rows) of sorted batches; a group's rows are read as they come."""
    from itertools import groupby

    def rows():
        for batch in batches:
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                yield values[:keys], dict(zip(names, values))

    for key, group in groupby(rows(), key=lambda r: r[0]):
        yield key, (r for _, r in group)


#: What a feature's state is made of.
STATE_COLUMNS = ("operation_type", "lon", "lat", "key", "value", "ref_id", "position")


def by_feature(operations: DataFrame, columns: tuple[str, ...] = tuple(c for c in OPERATION_COLUMNS if c not in FEATURE), only: Column | None = None) -> DataFrame:
    """Operations dealt by feature and sorted in canonical order, with some columns. ``only``: of features of which it holds for
    an operation; the dealt rows tell, so that nothing more is shuffled."""
    rows = operations.select(*FEATURE, *(c for c in OPERATION_COLUMNS if c not in FEATURE)).repartition(*FEATURE)
    if only is not None:
        rows = rows.withColumn("_only", F.max(only).over(Window.partitionBy(*FEATURE))).where("_only").drop("_only")
    return rows.sortWithinPartitions(*FEATURE, *canonical_order()).select(*FEATURE, *columns)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


FEATURE_ROWS = "geometry_type string, oid long, feature_type string, geometry string, geom_wkt string, deleted boolean, tags map<string,string>"
_FEATURE_SCHEMA = pa.schema([("geometry_type", pa.string()), ("oid", pa.int64()), ("feature_type", pa.string()), ("geometry", pa.string()), ("geom_wkt", pa.string()), ("deleted", pa.bool_()), ("tags", pa.map_(pa.string(), pa.string()))])


def feature_rows(states: Iterator[tuple[tuple, FeatureState]], types: tuple[FeatureType, ...], short_rings: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of ``assembled_features`` from features' states."""
    out = []
    for key, state in states:
        if shapes := state.shapes(short_rings):
            tags = state.seen()[2]
            name, kind = exported_type(tags, shapes, types)
            out.append((*key, name, kind, shape_wkt(kind, shapes[kind]), state.deleted, sorted(tags.items())))
        if len(out) >= 1000:
            yield _as_batch(out, _FEATURE_SCHEMA)
            out = []
    yield _as_batch(out, _FEATURE_SCHEMA)


def states_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, FeatureState]]:
    """(feature, state after all of its operations) of rows dealt and sorted by feature."""
    for key, rows in grouped_rows(batches, 2):
        state = FeatureState()
        for op in rows:
            state.apply(op)
        yield key, state


def assembled_features(operations: DataFrame, config: AnalysisConfig, slice_rows: int | None = None) -> DataFrame:
    """(geometry_type, oid, feature_type, geometry, geom_wkt, deleted, tags): features as they are after all of operations.

    Features without a geometry, and relations, don't come out. ``slice_rows``: long histories are folded in slices of about
    so many operations, by many tasks (``split_fold``)."""
    types, short, rows = config.feature_types, config.short_rings, operations.where("geometry_type != 'RELATION'")
    if slice_rows:
        from .split_fold import fold_in_slices

        return fold_in_slices(rows, lambda states: feature_rows(states, types, short), FEATURE_ROWS, slice_rows)
    return by_feature(rows, STATE_COLUMNS).mapInArrow(lambda batches: feature_rows(states_of(batches), types, short), FEATURE_ROWS)


def with_export_columns(features: DataFrame, feature_type: FeatureType) -> DataFrame:
    """Rows of one feature type with a column for each of its properties, and the length of lines in metres."""
    pairs = F.split(F.regexp_extract("geom_wkt", r"LINESTRING \((.*)\)", 1), ", ")
    points = F.transform(pairs, lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("x"), F.split(p, " ")[1].cast("double").alias("y")))
    length = F.when(F.col("geom_wkt").startswith("LINESTRING"), geo.andoyer_length(points))
    return features.where(F.col("feature_type") == feature_type.name).select(F.col("oid").alias("osm_id"), "geom_wkt", "deleted", length.alias("length"), *(F.col("tags")[p].alias(p) for p in feature_type.properties))


def tags_at(operations: DataFrame, ts: datetime | None = None) -> DataFrame:
    """(geometry_type, oid, tags): each feature's tags at a time (None: now); creation, deletion and re-creation clear them."""
    rows = operations if ts is None else operations.where(F.col("ts") <= F.lit(ts))
    of = Window.partitionBy(*FEATURE)
    rows = rows.withColumn("_n", F.row_number().over(of.orderBy(*canonical_order())))
    kept = rows.withColumn("_clear", F.max(F.when(F.col("operation_type").isin(*CLEARING), F.col("_n"))).over(of)).where((F.col("_clear").isNull()) | (F.col("_n") > F.col("_clear")))
    last = kept.where(F.col("operation_type").isin(*TAG_SET, "OP_REMOVE_TAG")).groupBy(*FEATURE, "key").agg(F.max_by(F.struct("operation_type", "value"), "_n").alias("last"))
    return last.where("last.operation_type != 'OP_REMOVE_TAG'").groupBy(*FEATURE).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "last.value")))).alias("tags"))


def all_tag_values(operations: DataFrame) -> DataFrame:
    """(geometry_type, oid, key, values): all values that a feature ever had for a key."""
    return operations.where(F.col("operation_type").isin(*TAG_SET)).groupBy(*FEATURE, "key").agg(F.sort_array(F.collect_set("value")).alias("values"))


ELEMENT_ROWS = "geometry_type string, oid long, visible boolean, lon double, lat double, nodes array<long>, members array<struct<element_type:string,id:long,role:string>>, tags map<string,string>"
_ELEMENT_SCHEMA = pa.schema(
    [("geometry_type", pa.string()), ("oid", pa.int64()), ("visible", pa.bool_()), ("lon", pa.float64()), ("lat", pa.float64()), ("nodes", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("element_type", pa.string()), ("id", pa.int64()), ("role", pa.string())]))), ("tags", pa.map_(pa.string(), pa.string()))]
)


def element_rows(states: Iterator[tuple[tuple, FeatureState]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``elements_at`` from features' states."""
    kinds, out = {"n": "NODE", "w": "WAY", "r": "RELATION"}, []
    for key, state in states:
        x, y = state.point if state.point and state.visible else (None, None)
        members = [{"element_type": kinds.get(k, k), "id": i, "role": r} for k, i, r in state.members]
        out.append((*key, state.visible, x, y, [n for n, _ in state.nodes], members, sorted(state.tags.items())))
        if len(out) >= 1000:
            yield _as_batch(out, _ELEMENT_SCHEMA)
            out = []
    yield _as_batch(out, _ELEMENT_SCHEMA)


def elements_at(operations: DataFrame, cutoff: datetime | None = None, slice_rows: int | None = None) -> DataFrame:
    """(geometry_type, oid, visible, lon, lat, nodes, members, tags): elements rebuilt from operations up to a time.

    ``slice_rows``: as in ``assembled_features``."""
    rows = operations if cutoff is None else operations.where(F.col("ts") <= F.lit(cutoff))
    if slice_rows:
        from .split_fold import fold_in_slices

        return fold_in_slices(rows, element_rows, ELEMENT_ROWS, slice_rows)
    return by_feature(rows, STATE_COLUMNS).mapInArrow(lambda batches: element_rows(states_of(batches)), ELEMENT_ROWS)
