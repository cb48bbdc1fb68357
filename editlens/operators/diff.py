"""Element versions to operations: what each version changed against the one before it.

One window over (element_type, id) brings the previous version alongside; creations, moves, tag changes, deletions
and the lists of new elements are array expressions, so the only Python is the list comparison of elements that had a
list before and have another one now. Operations of a version are numbered by ``seq`` in the order of emission: type
specific ones, then tags by key, then deletion or re-creation."""

from __future__ import annotations

from collections import Counter, deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import ELEMENT_TO_GEOMETRY, OPERATION_COLUMNS, lookup

EDIT = T.ArrayType(
    T.StructType(
        [
            T.StructField("operation_type", T.StringType()),
            T.StructField("lon", T.DoubleType()),
            T.StructField("lat", T.DoubleType()),
            T.StructField("key", T.StringType()),
            T.StructField("value", T.StringType()),
            T.StructField("ref_id", T.LongType()),
            T.StructField("position", T.IntegerType()),
        ]
    )
)


class _Left:
    """How many items of a list are left before each (a tree of counts)."""

    def __init__(self, n: int):
        self.count = [i & -i for i in range(n + 1)]

    def before(self, i: int) -> int:
        total = 0
        while i > 0:
            total += self.count[i]
            i &= i - 1
        return total

    def take(self, i: int) -> None:
        i += 1
        while i < len(self.count):
            self.count[i] -= 1
            i += i & -i


def reorder(now: list, new: list) -> tuple[list[tuple[int, int]], list[int]]:
    """The moves (from, to) that make ``new`` of ``now``, which has the same items, and where each item of ``new`` stood.

    From the front on, each place gets the first item that fits of those behind it."""
    if now == new:
        return [], list(range(len(now)))
    places: dict = {}
    for i, item in enumerate(now):
        places.setdefault(item, deque()).append(i)
    left, moves, order = _Left(len(now)), [], []
    for to, wanted in enumerate(new):
        at = places[wanted].popleft()
        ahead = left.before(at)
        left.take(at)
        order.append(at)
        if ahead:
            moves.append((to + ahead, to))
    return moves, order


def list_edits(old: list, new: list, first_is_new: bool) -> tuple[list[int], list[int], list[tuple[int, int]], list[int]]:
    """How a list became another: removed positions (from the end), added positions, moves (from, to), and where each item of
    the result stood before the moves.

    Where an item stands more often in ``new`` than in ``old``, ``first_is_new`` tells whether its first or its last
    occurrences count as added."""
    spare = Counter(new)
    removed = []
    for i in range(len(old) - 1, -1, -1):
        if spare[old[i]] > 0:
            spare[old[i]] -= 1
        else:
            removed.append(i)
    if first_is_new:
        missing, added = spare, []
        for i, item in enumerate(new):
            if missing[item] > 0:
                missing[item] -= 1
                added.append(i)
    else:
        there, added = Counter(old), []
        for i, item in enumerate(new):
            if there[item] > 0:
                there[item] -= 1
            else:
                added.append(i)
    gone, fresh = set(removed), set(added)
    kept = iter([x for i, x in enumerate(old) if i not in gone])
    moves, order = reorder([new[i] if i in fresh else next(kept) for i in range(len(new))], new)
    return removed, added, moves, order


def _edit(kind, key="", value="", ref=-1, position=-1):
    return (f"OP_{kind}", None, None, key, value, ref, position)


def way_edits(old, new) -> list[tuple]:
    removed, added, moves, _ = list_edits(old, new, True)
    return [*(_edit("REMOVE_NODE", ref=old[i], position=i) for i in removed), *(_edit("ADD_NODE", ref=new[i], position=i) for i in added), *(_edit("REORDER_NODE", ref=a, position=b) for a, b in moves)]


def member_edits(old, new) -> list[tuple]:
    """old, new: (element_type, id, role); a member's identity is its type and id."""
    same = lambda m: m[:2]
    removed, added, moves, order = list_edits([same(m) for m in old], [same(m) for m in new], False)
    gone, fresh = set(removed), set(added)
    kept = iter([m[2] for i, m in enumerate(old) if i not in gone])
    roles = [new[i][2] if i in fresh else next(kept) for i in range(len(new))]
    roles = [roles[i] for i in order]
    out = [_edit("REMOVE_MEMBER", ref=0, position=i) for i in removed]
    out += [_edit("ADD_MEMBER", key=new[i][0][:1].lower(), value=new[i][2] or "", ref=new[i][1], position=i) for i in added]
    out += [_edit("REORDER_MEMBER", ref=a, position=b) for a, b in moves]
    return out + [_edit("MODIFY_ROLE", value=m[2] or "", position=i) for i, m in enumerate(new) if i < len(roles) and roles[i] != m[2]]


def id_lists(lists: pa.Array) -> list[list[int]]:
    """Lists of ids, without a scalar for each."""
    flat, ends = lists.flatten().to_pylist(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def member_tuples(lists: pa.Array) -> list[list[tuple]]:
    """Lists of members as (element_type, id, role), without a dict for each."""
    flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    every = list(zip(*(pc.struct_field(flat, n).to_pylist() for n in ("element_type", "id", "role"))))
    return [every[a:b] for a, b in zip([0, *ends], ends)]


_EDIT_ARROW = pa.struct([("operation_type", pa.string()), ("lon", pa.float64()), ("lat", pa.float64()), ("key", pa.string()), ("value", pa.string()), ("ref_id", pa.int64()), ("position", pa.int32())])


@F.arrow_udf(EDIT)
def _list_edits(old_nodes: pa.Array, nodes: pa.Array, old_members: pa.Array, members: pa.Array) -> pa.Array:
    edits, offsets = [], np.zeros(len(nodes) + 1, np.int32)
    counts = np.zeros(len(nodes), np.int64)
    for column, other, edit, shape in ((old_nodes, nodes, way_edits, id_lists), (old_members, members, member_edits, member_tuples)):
        at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))  # only these rows become Python values
        for i, was, now in zip(at.tolist(), shape(column.take(pa.array(at))), shape(other.take(pa.array(at)))):
            own = edit(was, now)
            counts[i] = len(own)
            edits.append((i, own))
    np.cumsum(counts, out=offsets[1:])
    rows = [e for _, own in sorted(edits, key=lambda x: x[0]) for e in own]
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_EDIT_ARROW), _EDIT_ARROW)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_EDIT_ARROW)))


def _op(kind: Column | str, lon=None, lat=None, key="", value="", ref=-1, position=-1) -> Column:
    c = lambda x, t: x.cast(t) if isinstance(x, Column) else F.lit(x).cast(t)
    return F.struct(
        c(kind if isinstance(kind, Column) else f"OP_{kind}", "string").alias("operation_type"),
        c(lon, "double").alias("lon"),
        c(lat, "double").alias("lat"),
        c(key, "string").alias("key"),
        c(value, "string").alias("value"),
        c(ref, "long").alias("ref_id"),
        c(position, "int").alias("position"),
    )


def _none() -> Column:
    return F.array().cast(EDIT)


def tag_edits(old: Column, new: Column) -> Column:
    """ADD_TAG and MODIFY_TAG_VALUE by key, then REMOVE_TAG by key."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    keys = F.array_sort(F.map_keys(new))
    changed = F.filter(keys, lambda k: ~F.coalesce(F.element_at(old, k) == F.element_at(new, k), F.lit(False)))
    set_ = F.transform(changed, lambda k: _op(F.when(F.map_contains_key(old, k), "OP_MODIFY_TAG_VALUE").otherwise("OP_ADD_TAG"), key=k, value=F.element_at(new, k)))
    gone = F.transform(F.array_sort(F.array_except(F.map_keys(old), F.map_keys(new))), lambda k: _op("REMOVE_TAG", key=k))
    return F.concat(set_, gone)


def version_diff(versions: DataFrame, lists: bool = True) -> DataFrame:
    """element_versions -> operations. A missing earlier version counts as none; versions of an element are compared
    in ascending order. Null lists count as empty, and null ``visible`` as visible. Without ``lists`` nodes of ways and
    members aren't compared, and nothing runs in Python."""
    w = Window.partitionBy("element_type", "id").orderBy("version", "ts")
    fields = ("visible", "tags", "lon", "lat", "nodes", "members")
    pairs = versions.withColumn("visible", F.coalesce("visible", F.lit(True))).withColumn("old", F.lag(F.struct(*fields)).over(w))
    old = lambda f: F.col(f"old.{f}")
    fresh = F.col("old").isNull()
    kind = F.col("element_type")
    name = lookup(kind, {"NODE": "NODE", "WAY": "WAY", "RELATION": "RELATION"})
    nodes, members = F.coalesce("nodes", F.array().cast("array<bigint>")), F.coalesce(F.col("members"), F.array().cast(versions.schema["members"].dataType))
    was_nodes, was_members = F.coalesce(old("nodes"), F.array().cast("array<bigint>")), F.coalesce(old("members"), F.array().cast(versions.schema["members"].dataType))
    create = F.when(fresh, F.array(_op(F.concat(F.lit("OP_CREATE_"), name), lon=F.when(kind == "NODE", F.col("lon")), lat=F.when(kind == "NODE", F.col("lat"))))).otherwise(_none())
    move = F.when(
        (kind == "NODE") & F.coalesce((F.col("lon") != old("lon")) | (F.col("lat") != old("lat")), F.lit(False)),
        F.array(_op("MODIFY_COORDINATE", lon=F.col("lon"), lat=F.col("lat"))),
    ).otherwise(_none())
    # lists: from nothing all is added, to nothing all is removed; only a change between two lists needs Python
    added = F.when(kind == "WAY", F.transform(nodes, lambda n, i: _op("ADD_NODE", ref=n, position=i))).otherwise(
        F.transform(members, lambda m, i: _op("ADD_MEMBER", key=F.lower(F.substring(m["element_type"], 1, 1)), value=F.coalesce(m["role"], F.lit("")), ref=m["id"], position=i))
    )
    removed = F.when(kind == "WAY", F.reverse(F.transform(was_nodes, lambda n, i: _op("REMOVE_NODE", ref=n, position=i)))).otherwise(
        F.reverse(F.transform(was_members, lambda m, i: _op("REMOVE_MEMBER", ref=0, position=i)))
    )
    size, was = F.when(kind == "WAY", F.size(nodes)).otherwise(F.size(members)), F.when(kind == "WAY", F.size(was_nodes)).otherwise(F.size(was_members))
    both = F.when(kind == "NODE", False).otherwise((size > 0) & (was > 0) & ~F.when(kind == "WAY", nodes == was_nodes).otherwise(members == was_members))
    pairs = pairs.withColumn("_both", both & F.lit(lists))
    list_part = _none() if not lists else F.when(kind == "NODE", _none()).when(F.col("_both"), F.col("_edits")).when((was == 0) & (size > 0), added).when((size == 0) & (was > 0), removed).otherwise(_none())
    way = (kind == "WAY") & F.col("_both")
    rel = (kind == "RELATION") & F.col("_both")
    if lists:
        pairs = pairs.withColumn("_edits", _list_edits(F.when(way, was_nodes), F.when(way, nodes), F.when(rel, was_members), F.when(rel, members)))
    was_visible = F.coalesce(old("visible"), F.lit(True))
    delete = F.when(~F.col("visible") & (fresh | was_visible), F.array(_op(F.concat(F.lit("OP_DELETE_"), name)))).otherwise(_none())
    again = F.when(
        F.col("visible") & ~fresh & ~was_visible,
        F.array(_op(F.concat(F.lit("OP_RECREATE_"), name), lon=F.when(kind == "NODE", F.col("lon")), lat=F.when(kind == "NODE", F.col("lat")))),
    ).otherwise(_none())
    every = pairs.select(
        lookup("element_type", ELEMENT_TO_GEOMETRY).alias("geometry_type"),
        F.col("id").alias("oid"),
        F.col("version").cast("int").alias("version"),
        "uid",
        "ts",
        "changeset",
        F.posexplode(F.concat(create, move, list_part, tag_edits(old("tags"), F.col("tags")), delete, again)).alias("seq", "op"),
    )
    return every.select(*(F.col(f"op.{c}").alias(c) if c in EDIT.elementType.names else F.col(c) for c in OPERATION_COLUMNS))


def node_moves(versions: DataFrame) -> DataFrame:
    """The rows of ``version_diff`` that are OP_REORDER_NODE, and no other: only ways whose nodes may have moved reach Python, and neither tags nor what is added or removed is made into operations."""
    w = Window.partitionBy("element_type", "id").orderBy("version", "ts")
    ways = versions.where("element_type = 'WAY'").select("element_type", "id", "version", "uid", "ts", "changeset", "nodes")
    pairs = ways.withColumn("old", F.lag("nodes").over(w)).where((F.size("old") > 0) & (F.size("nodes") > 0) & (F.col("old") != F.col("nodes")))
    # where no node comes twice and those of both lists stand in the same order, nothing moves
    twice = (F.size(F.array_distinct("old")) < F.size("old")) | (F.size(F.array_distinct("nodes")) < F.size("nodes"))
    pairs = pairs.where(twice | (F.array_intersect("old", "nodes") != F.array_intersect("nodes", "old")))
    none = F.lit(None).cast(versions.schema["members"].dataType)
    every = pairs.select("element_type", "id", "version", "uid", "ts", "changeset", _list_edits("old", "nodes", none, none).alias("_edits"))
    moves = every.select(
        lookup("element_type", ELEMENT_TO_GEOMETRY).alias("geometry_type"), F.col("id").alias("oid"), F.col("version").cast("int").alias("version"), "uid", "ts", "changeset", F.posexplode("_edits").alias("seq", "op")
    ).where("op.operation_type = 'OP_REORDER_NODE'")
    return moves.select(*(F.col(f"op.{c}").alias(c) if c in EDIT.elementType.names else F.col(c) for c in OPERATION_COLUMNS))
