"""Changes of buildings and streets from action to action: attributes by windows' logic in a fold, geometry in UTM 33N.

Actions of a feature and feature type follow each other in order; the state starts anew with either. Within an action
attributes come first, then geometry against the one before, then split or merge, creation and deletion. Geometries are the same
if they are made of the same points, wherever a ring starts and whatever nodes lie on its edges. A street is held against the
buffer of the other with flat ends, grown by AROUND on all sides; with ``round_ends`` against all that is near enough to it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .filters import FEATURE
from .fold import grouped_rows

NEAR, AROUND, SHORTER, LONGER, NAME_EDITS = 20.0, 1.0, 0.8, 1.2, 3
#: Geometries, and pairs of them, whose comparison a task keeps, as shapes come again (edits and their reverts, tags of the same shape).
KEPT = 1 << 16
_BUILDINGS = ("building", "buildingPoint")


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in UTF-16 units."""
    units = lambda s: np.frombuffer(s.encode("utf-16-le"), np.uint16)
    x, y = units(a), units(b)
    row = np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        best = np.concatenate(([i], best))
        row = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
    return int(row[-1])


def edit_distances(a: Column, b: Column) -> Column:
    """``edit_distance`` of two columns; null where either is. Built in, but where a character has two UTF-16 units."""

    @F.arrow_udf("int")
    def in_units(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if s is None or t is None else edit_distance(s, t) for s, t in zip(x.to_pylist(), y.to_pylist())], pa.int32())

    wide = F.concat(a, b).rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.when(wide, in_units(F.when(wide, a), F.when(wide, b))).otherwise(F.levenshtein(a, b))


def attribute_changes(feature_type: str, ops: list[dict], state: dict[str, str]):
    """(status, old, new) of tag operations; ``state`` has the attributes and is brought up to date."""
    if feature_type in _BUILDINGS:
        names = {"building": "BuildingTypeModified", "addr:housenumber": "BuildingHousenumberModified"}
    elif feature_type == "street":
        names = {"highway": "StreetTypeModified", "ref": "StreetRefModified", "maxspeed": "StreetMaxSpeedModified", "name": "StreetNameModified"}
    else:
        return
    for op in ops:
        status = names.get(op["key"])
        if status is None or op["operation_type"] not in ("OP_ADD_TAG", "OP_MODIFY_TAG_VALUE"):
            continue
        old, new = state.get(op["key"]), op["value"]
        if op["operation_type"] == "OP_MODIFY_TAG_VALUE":
            if status == "StreetNameModified" and edit_distance(new, old or "") <= NAME_EDITS:
                status = "StreetNameModifiedLittle"
            yield op, status, old, new
        state[op["key"]] = new


def _projected(wkt: str, project):
    kind, rings = geo.parse_wkt(wkt)
    return kind, [np.stack(project(r[:, 0], r[:, 1]), 1) for r in rings]


def planar(x, y):
    """For coordinates that are metres already."""
    return x, y


def _street_change(x, y, away: float, round_ends: bool):
    """As ``geometry_change``, for lines."""
    against = (lambda a, b: (geo.outside_buffer(a, b, NEAR), away <= NEAR)) if round_ends else lambda a, b: geo.against_flat_buffer(a, b, NEAR, AROUND)
    out, meets = ([], False) if away > NEAR + AROUND else against(y, x)
    if not meets:
        return "StreetDisjoint", None, away, True, None
    was, now = geo.length(x), geo.length(y)
    if out and against(x, y)[0]:
        return "StreetCrossesBuffer", was, now, True, None
    status, much = ("StreetLengthened", now > LONGER * was) if out else ("StreetShortened", now < SHORTER * was)
    if not much:
        return ("StreetWithinBuffer", was, now, False, None) if now != was else None
    return status, was, now, True, geo.outside_buffer(x, y, NEAR) if round_ends else geo.against_flat_buffer(x, y, NEAR)[0]


def geometry_change(feature_type: str, old, new, round_ends: bool = False):
    """(status, old value, new value, whether the old geometry is told, stretches of the old that are gone) of a geometry
    against the one before, or None. Values are areas and lengths, or the distance as the new one."""
    (ka, a), (kb, b) = old, new
    if geo.same_geometry(ka, a, kb, b):
        return None
    away = geo.distance(ka, a, kb, b)
    if feature_type == "building":
        if away == 0:
            size = lambda k, g: geo.area(g[0]) if k == "POLYGON" else 0.0
            return "BuildingIntersects", size(ka, a), size(kb, b), True, None
        return "BuildingWithinBuffer" if away < NEAR else "BuildingOutsideBuffer", None, away, True, None
    if feature_type == "buildingPoint":
        return ("BuildingOutsideBuffer", None, away, True, None) if away > NEAR else None
    if feature_type == "street":
        return _street_change(a[0], b[0], away, round_ends)
    return None


def comparison(project=geo.utm33, round_ends: bool = False):
    """(feature type, old WKT, new WKT) -> ``geometry_change``'s result, with the stretches that are gone as WKT. What was compared
    before is looked up, the least recent of more than ``KEPT`` is compared anew."""
    projected = lru_cache(KEPT)(lambda wkt: _projected(wkt, project))

    @lru_cache(KEPT)
    def compare(feature_type: str, old: str, new: str):
        change = geometry_change(feature_type, projected(old), projected(new), round_ends)
        return change and (*change[:4], geo.pieces_wkt(geo.parse_wkt(old)[1][0], change[4]) if change[4] else None)

    return lambda feature_type, old, new: None if old == new else compare(feature_type, old, new)


def action_changes(feature_type: str, actions, project=geo.utm33, round_ends: bool = False, compare=None):
    """Changes of one feature and feature type, in order."""
    attributes, before, compare = {}, None, compare or comparison(project, round_ends)
    for a in actions:
        ops, first = a["operations"], a["operations"][0]
        kinds = [op["operation_type"] for op in ops]
        for op, status, old, new in attribute_changes(feature_type, ops, attributes):
            yield op, status, old, new, None, None, None
        wkt = a["geom_wkt"]
        if before is not None and (change := compare(feature_type, before, wkt)):
            yield first, change[0], *(None if v is None else str(v) for v in change[1:3]), before if change[3] else None, wkt, change[4]
        joined = next((k for k in kinds if k in ("OP_SPLIT_WAY", "OP_MERGE_WAY")), None)
        if joined:
            yield first, "GeometrySplit" if joined == "OP_SPLIT_WAY" else "GeometryMerge", None, None, before, wkt, None
        if a["action_type"] == "CREATE" and kinds[0] != "OP_SPLIT_WAY":
            yield first, "CreateGeometry", None, None, None, wkt, None
        if a["action_type"] == "DELETE" and kinds[0] != "OP_MERGE_WAY":
            yield first, "DeleteGeometry", None, None, before, None, None
        before = wkt


_CHANGES = "geometry_type string, osm_id long, feature_type string, change_no int, version int, changeset long, us long, status string, value_old string, value_new string, geometry_old string, geometry_new string, geometry_diff string"


def change_detection(actions: DataFrame, project=geo.utm33, round_ends: bool = False) -> DataFrame:
    """actions -> changes in order by ``change_no`` within (region, where there is that column,) feature and feature type.

    ``project`` brings coordinates to metres (``planar`` where they are)."""
    region = [c for c in ("region",) if c in actions.columns]
    keys, spec = [*region, *FEATURE, "feature_type"], "".join(f"{c} string, " for c in region) + _CHANGES
    schema = pa.schema([(n.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[n.split()[1]]) for n in spec.split(", ")])

    def run(batches):
        rows, compare = [], comparison(project, round_ends)
        for key, group in grouped_rows(batches, len(keys)):
            for n, (op, *rest) in enumerate(action_changes(key[-1], group, compare=compare)):
                rows.append((*key, n, op["version"], op["changeset"], op["us"], *rest))
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ops = F.transform("operations", lambda o: F.struct(o["operation_type"].alias("operation_type"), o["version"].alias("version"), o["changeset"].alias("changeset"), F.unix_micros(o["ts"]).alias("us"), o["key"].alias("key"), o["value"].alias("value")))
    rows = actions.where(F.col("feature_type").isin(*_BUILDINGS, "street")).select(*keys, "action_no", "action_type", ops.alias("operations"), "geom_wkt")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "action_no")
    out = rows.mapInArrow(run, spec)
    return out.withColumn("ts", F.timestamp_micros("us")).drop("us")
