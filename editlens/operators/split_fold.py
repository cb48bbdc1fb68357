"""The fold of a feature's history by many tasks.

Operations are borders by their content: one in ``slice_rows``, by a hash. A feature's borders cut its history, in canonical
order, into slices of about so many operations; the borders of a feature are 1 / ``slice_rows`` of its operations. Features
without a border are folded as they are. Of the others,

1. each slice tells how it changes the length of the feature's lists: edits beyond the end of a list append or do nothing, so
   what a slice does depends on the length that it meets. That length only matters by comparison: a slice adds ``grown`` items
   and takes one away for each of its ``steps`` that the length reaches;
2. a scan over the slices of a feature gives each the lengths that it begins with;
3. each slice is folded into what it changes (``SliceChange``): the last value of a tag, of the point, of a node's coordinates;
   the lists as runs of what was there and of new items;
4. a scan over the slices of a feature puts the changes together.

Tasks of steps 1 and 3 hold a slice, those of 2 and 4 a feature's state and one slice's change. The result is that of the
plain fold. Operations of a feature that are alike in all of the canonical order are in one slice."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import canonical_order, hierarchy
from .filters import FEATURE
from .fold import STATE_COLUMNS, FeatureState, by_feature, grouped_rows, states_of

SLICE_ROWS = 16_384


def _order_key() -> Column:
    """The canonical order as one value."""
    return F.struct(F.col("version"), F.col("ts"), (-hierarchy()).alias("level"), F.col("seq"))


class Lengths:
    """How a slice changes a list's length: length + grown - (number of steps <= length)."""

    def __init__(self, grown: int = 0, steps: list[int] | None = None):
        self.grown, self.steps = grown, list(steps or ())

    def after(self, length: int) -> int:
        return length + self.grown - bisect_right(self.steps, length)

    def add(self) -> None:
        self.grown += 1

    def remove(self, place: int) -> None:
        """An item is taken away wherever the length is above ``place`` by now, which only grows with the length at first."""
        if place < 0:
            return
        low, high = 0, max(0, place + 1 - self.grown + len(self.steps))
        while low < high:
            middle = (low + high) // 2
            if self.after(middle) > place:
                high = middle
            else:
                low = middle + 1
        if low:
            insort(self.steps, low)
        else:
            self.grown -= 1  # whatever the length


class SliceChange:
    """What a slice's operations do to a state whose lists have ``nodes`` and ``members`` items.

    Items of a list are numbered: those that were there, then those that are new."""

    def __init__(self, nodes: int, members: int):
        self.lists = {"NODE": list(range(nodes)), "MEMBER": list(range(members))}
        self.there = {"NODE": nodes, "MEMBER": members}
        self.new: dict[str, list] = {"NODE": [], "MEMBER": []}
        self.new_of_id: dict[int, dict[int, None]] = {}
        self.moved: dict[int, tuple | None] = {}
        self.roles: dict[int, str] = {}
        self.tags: dict[str, tuple[str | None, bool]] = {}
        self.point_set, self.point, self.visible = False, None, None

    def apply(self, op: dict) -> None:
        kind = op["operation_type"].removeprefix("OP_")
        at = (op["lon"], op["lat"]) if op["lon"] is not None and op["lat"] is not None else None
        ref, place, what = op["ref_id"], op["position"], kind.rpartition("_")[2]
        if kind.startswith(("CREATE_", "RECREATE_")):
            self.visible = True
            if what == "NODE" and at:
                self.point_set, self.point = True, at
        elif kind == "MODIFY_COORDINATE":
            if at:
                self.point_set, self.point = True, at
        elif kind in ("DELETE_NODE", "DELETE_WAY", "DELETE_RELATION"):
            self.visible = False
            if what == "NODE":
                self.point_set, self.point = True, None
        elif kind in ("ADD_NODE", "ADD_MEMBER"):
            new, no = self.new[what], len(self.new[what])
            new.append([ref, at] if what == "NODE" else [op["key"], ref, op["value"]])
            self.lists[what].insert(max(place, 0), self.there[what] + no)
            if what == "NODE":
                self.new_of_id.setdefault(ref, {})[no] = None
        elif kind in ("REMOVE_NODE", "REMOVE_MEMBER"):
            if 0 <= place < len(self.lists[what]):
                no = self.lists[what].pop(place) - self.there[what]
                if what == "NODE" and no >= 0:
                    del self.new_of_id[self.new[what][no][0]][no]
        elif kind in ("REORDER_NODE", "REORDER_MEMBER"):
            items = self.lists[what]
            if 0 <= ref < len(items):
                items.insert(max(place, 0), items.pop(ref))
        elif kind == "MODIFY_WAY_COORDINATE":
            self.moved[ref] = at
            for no in self.new_of_id.get(ref, ()):
                self.new["NODE"][no][1] = at
        elif kind in ("ADD_TAG", "MODIFY_TAG_VALUE"):
            self.tags[op["key"]] = (op["value"], False)
        elif kind == "REMOVE_TAG":
            self.tags[op["key"]] = (None, True)
        elif kind == "MODIFY_ROLE" and 0 <= place < len(self.lists["MEMBER"]):
            no = self.lists["MEMBER"][place]
            if no < self.there["MEMBER"]:
                self.roles[no] = op["value"]
            else:
                self.new["MEMBER"][no - self.there["MEMBER"]][2] = op["value"]

    def _list(self, what: str) -> tuple[list[dict], list]:
        """A list as runs of numbers, and the new items that are in it, numbered anew."""
        numbers, there = np.array(self.lists[what], np.int64), self.there[what]
        fresh = np.unique(numbers[numbers >= there])
        numbers = np.where(numbers >= there, there + np.searchsorted(fresh, numbers), numbers)
        starts = np.flatnonzero(np.diff(numbers, prepend=-2) != 1)
        sizes = np.diff(starts, append=len(numbers))
        return [{"start": s, "size": n} for s, n in zip(numbers[starts].tolist(), sizes.tolist())], [self.new[what][i] for i in (fresh - there).tolist()]

    def row(self) -> dict:
        """The change as a value of ``CHANGE``."""
        place = lambda at: {"lon": at and at[0], "lat": at and at[1]}
        (nodes, new_nodes), (members, new_members) = self._list("NODE"), self._list("MEMBER")
        return {
            "point_set": self.point_set, **place(self.point), "visible": self.visible,
            "tags": [{"key": k, "value": v, "gone": gone} for k, (v, gone) in self.tags.items()],
            "nodes": nodes, "new_nodes": [{"ref": r, **place(at)} for r, at in new_nodes], "moved": [{"ref": r, **place(at)} for r, at in self.moved.items()],
            "members": members, "new_members": [{"key": k, "ref": r, "value": v} for k, r, v in new_members], "roles": [{"start": i, "role": r} for i, r in self.roles.items()],
        }


def changed(state: FeatureState, change: dict) -> FeatureState:
    """The state that a change makes of one; of what was before a deletion nothing is told here."""
    place = lambda c: (c["lon"], c["lat"]) if c["lon"] is not None else None
    out = FeatureState()
    out.point = place(change) if change["point_set"] else state.point
    out.visible = state.visible if change["visible"] is None else change["visible"]
    out.tags = dict(state.tags)
    for tag in change["tags"]:
        if tag["gone"]:
            out.tags.pop(tag["key"], None)
        else:
            out.tags[tag["key"]] = tag["value"]
    moved = {m["ref"]: place(m) for m in change["moved"]}
    nodes = [[ref, moved.get(ref, at)] for ref, at in state.nodes] + [[n["ref"], place(n)] for n in change["new_nodes"]]
    out.nodes = [n for run in change["nodes"] for n in nodes[run["start"] : run["start"] + run["size"]]]
    members = state.members + [(m["key"], m["ref"], m["value"]) for m in change["new_members"]]
    for role in change["roles"]:
        members[role["start"]] = (*members[role["start"]][:2], role["role"])
    out.members = [m for run in change["members"] for m in members[run["start"] : run["start"] + run["size"]]]
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
_NODES = pa.list_(pa.struct([("ref", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64())]))
CHANGE = pa.struct(
    [
        ("point_set", pa.bool_()), ("lon", pa.float64()), ("lat", pa.float64()), ("visible", pa.bool_()),
        ("tags", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string()), ("gone", pa.bool_())]))),
        ("nodes", _RUNS), ("new_nodes", _NODES), ("moved", _NODES),
        ("members", _RUNS), ("new_members", pa.list_(pa.struct([("key", pa.string()), ("ref", pa.int64()), ("value", pa.string())]))), ("roles", pa.list_(pa.struct([("start", pa.int64()), ("role", pa.string())]))),
    ]
)
_CHANGE_DDL = (
    "struct<point_set:boolean,lon:double,lat:double,visible:boolean,tags:array<struct<key:string,value:string,gone:boolean>>,nodes:array<struct<start:bigint,size:bigint>>,"
    "new_nodes:array<struct<ref:bigint,lon:double,lat:double>>,moved:array<struct<ref:bigint,lon:double,lat:double>>,members:array<struct<start:bigint,size:bigint>>,"
    "new_members:array<struct<key:string,ref:bigint,value:string>>,roles:array<struct<start:bigint,role:string>>>"
)
_SLICE = "geometry_type string, oid long, slice int, "


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    schema = pa.schema([("geometry_type", pa.string()), ("oid", pa.int64()), ("slice", pa.int32()), *fields])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _gathered(made: Iterator[tuple[tuple, int]], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """(row, operations that it is made of) in batches of rows of about SLICE_ROWS operations: short slices have no batch of their own."""
    out, held = [], 0
    for row, n in made:
        out.append(row)
        held += n
        if held >= SLICE_ROWS:
            yield _batch(out, fields)
            out, held = [], 0
    if out:
        yield _batch(out, fields)


def with_borders(operations: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """operations with ``_borders``, those of their feature in order, null if it isn't cut, and ``_strides``, the powers of two up to
    their number, downwards."""
    chosen = F.pmod(F.xxhash64(*FEATURE, "version", "ts", "operation_type", "seq"), F.lit(slice_rows)) == 0
    borders = operations.where(chosen).groupBy(*FEATURE).agg(F.array_sort(F.collect_set(_order_key())).alias("_borders"))
    strides = F.filter(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), lambda x: x <= F.size("_borders"))
    return operations.join(borders.withColumn("_strides", strides), FEATURE, "left")


def with_slices(operations: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """operations of features that are cut, with ``slice``: 0, 1, ... along a feature's canonical order."""
    cut = with_borders(operations, slice_rows).where("_borders IS NOT NULL").withColumn("_order", _order_key())
    onward = lambda at, stride: F.when(F.get("_borders", at + stride - 1) <= F.col("_order"), at + stride).otherwise(at)
    return cut.withColumn("slice", F.aggregate("_strides", F.lit(0), onward)).drop("_order", "_borders", "_strides")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: how each slice changes lengths."""
    fields = [(f"{c}_{w}", pa.int64() if c == "grown" else pa.list_(pa.int64())) for w in ("nodes", "members") for c in ("grown", "steps")]

    def made():
        for key, rows in grouped_rows(batches, 3):
            lists, n = {"NODE": Lengths(), "MEMBER": Lengths()}, 0
            for op in rows:
                edit, _, what = op["operation_type"].removeprefix("OP_").partition("_")
                if edit == "ADD" and what in lists:
                    lists[what].add()
                elif edit == "REMOVE" and what in lists:
                    lists[what].remove(op["position"])
                n += 1
            yield (*key, *(x for w in lists.values() for x in (w.grown, w.steps))), n

    yield from _gathered(made(), fields)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: the lengths that each slice begins with."""
    feature, nodes, members, out = None, 0, 0, []
    for (geometry_type, oid, no), rows in grouped_rows(batches, 3):
        if (geometry_type, oid) != feature:
            feature, nodes, members = (geometry_type, oid), 0, 0
        out.append((geometry_type, oid, no, nodes, members))
        for row in rows:
            nodes = Lengths(row["grown_nodes"], row["steps_nodes"]).after(nodes)
            members = Lengths(row["grown_members"], row["steps_members"]).after(members)
        if len(out) >= 1000:
            yield _batch(out, [("ref_id", pa.int64()), ("position", pa.int32())])
            out = []
    if out:
        yield _batch(out, [("ref_id", pa.int64()), ("position", pa.int32())])


_SNAPSHOTS = ("OP_DELETE_NODE", "OP_DELETE_WAY")


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: slices to changes. Each slice's first row has its lengths. ``kept``: whether the slice's last deletion or creation
    deletes, and ``before``: the change up to there."""

    def made():
        for key, rows in grouped_rows(batches, 3):
            first = next(rows)
            change, ops = SliceChange(first["ref_id"], first["position"]), list(rows)
            turns = [i for i, op in enumerate(ops) if op["operation_type"] in _SNAPSHOTS or op["operation_type"].startswith(("OP_CREATE_", "OP_RECREATE_"))]
            kept, before = None, None
            for i, op in enumerate(ops):
                if turns and i == turns[-1]:
                    kept = op["operation_type"] in _SNAPSHOTS
                    before = change.row() if kept else None
                change.apply(op)
            yield (*key, kept, before, change.row()), len(ops)

    yield from _gathered(made(), [("kept", pa.bool_()), ("before", CHANGE), ("change", CHANGE)])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, FeatureState]]:
    """Step 4: (feature, state) of its slices' changes."""
    for key, rows in grouped_rows(batches, 2):
        state, before = FeatureState(), None
        for row in rows:
            if row["kept"] is not None:
                then = changed(state, row["before"]) if row["kept"] else None
                before = then and (then.point, [tuple(n) for n in then.nodes], then.tags)
            state = changed(state, row["change"])
        state.before_deletion = before
        yield key, state


def fold_in_slices(operations: DataFrame, finish: Callable, rows_ddl: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """What ``finish`` makes of (feature, state) of each feature, with long histories folded slice by slice."""
    rows = with_borders(operations, slice_rows).where("_borders IS NULL")
    plain = by_feature(rows, STATE_COLUMNS).mapInArrow(lambda batches: finish(states_of(batches)), rows_ddl)
    cut = with_slices(operations, slice_rows).withColumn("oid", F.col("oid").cast("long"))
    of_slice, order = [*FEATURE, "slice"], canonical_order()
    # a number of partitions of our own: slices cost time in Python, so few small partitions aren't to be put together
    n = int(operations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edits = cut.select(*of_slice, "version", "ts", "operation_type", "seq", "position").repartition(n, *of_slice).sortWithinPartitions(*of_slice, *order).select(*of_slice, "operation_type", "position")
    lengths = edits.mapInArrow(_lengths, _SLICE + "grown_nodes long, steps_nodes array<long>, grown_members long, steps_members array<long>")
    starts = lengths.repartition(*FEATURE).sortWithinPartitions(*of_slice).mapInArrow(_starts, _SLICE + "ref_id long, position int")
    led = cut.withColumn("_op", F.lit(1)).unionByName(starts.withColumn("_op", F.lit(0)), allowMissingColumns=True)
    dealt = led.select(*of_slice, "_op", "version", "ts", "seq", *STATE_COLUMNS).repartition(n, *of_slice).sortWithinPartitions(*of_slice, "_op", *order).select(*of_slice, *STATE_COLUMNS)
    changes = dealt.mapInArrow(_changes, _SLICE + f"kept boolean, before {_CHANGE_DDL}, change {_CHANGE_DDL}")
    whole = changes.repartition(*FEATURE).sortWithinPartitions(*of_slice).drop("slice")
    return plain.unionByName(whole.mapInArrow(lambda batches: finish(_joined(batches)), rows_ddl))
