"""Operations to actions: what a contributor did to a feature in one go, by the rules of the configuration.

Within a feature, operations of one contributor that follow each other within the gap form a group. After each group
the feature's types are found anew from its tags; a type that is gone makes a DELETE, a type that stays an UPDATE and a
new one a CREATE. For each, rules take operations of the group, level by level of their hierarchy, until none fits. The
geometry that a group sees has all operations, of anyone, that lie before the end of its gap.

``sessions`` is the grouping alone as windows; it equals the fold wherever times ascend with versions, and keeps to
built-in functions. ``generate_actions`` streams features dealt by one shuffle and sorted, so that differing clocks are
followed exactly; its memory is the history of one feature."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import AnalysisConfig, FeatureType
from ..plans.schema import ACTIONS, HIERARCHY, OPERATION_COLUMNS, canonical_order
from .filters import FEATURE, TAG_SET
from .fold import FeatureState, by_feature, grouped_rows, shape_wkt

_CLEARS = tuple(f"OP_{a}" for a in ("CREATE_", "DELETE_", "RECREATE_"))


def sessions(operations: DataFrame, gap_ms: int) -> DataFrame:
    """operations with ``session`` (1, 2, ... within feature and contributor): a gap of more than ``gap_ms`` starts one."""
    w = Window.partitionBy(*FEATURE, "uid").orderBy(*canonical_order())
    wait = F.expr("timestampdiff(MICROSECOND, _before, ts)")
    fresh = F.when(wait.isNull() | (wait > gap_ms * 1000), 1).otherwise(0)
    return operations.withColumn("_before", F.lag("ts").over(w)).withColumn("_fresh", fresh).drop("_before").withColumn("session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def clock_anomalies(operations: DataFrame) -> DataFrame:
    """Features of which some operation is earlier than the one before it: there ``sessions`` may differ from the fold."""
    w = Window.partitionBy(*FEATURE).orderBy(*canonical_order())
    return operations.withColumn("_back", F.col("ts") < F.lag("ts").over(w)).where("_back").select(*FEATURE).distinct()


class _Later:
    """Where the first of the operations that are left, from a place on, is later than a time.

    Ascending times need no more than a search; else a tree of greatest times, from which operations are taken out."""

    _GONE = -(1 << 63)

    def __init__(self, times: list[int]):
        self.times = times
        self.ascending = all(a <= b for a, b in zip(times, times[1:]))
        if not self.ascending:
            self.size = 1 << (len(times) - 1).bit_length()
            self.tree = [self._GONE] * self.size + times + [self._GONE] * (self.size - len(times))
            for i in range(self.size - 1, 0, -1):
                self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def take(self, i: int) -> None:
        if self.ascending:
            return  # what lies behind a later one is later too, and was seen with it
        tree, i = self.tree, i + self.size
        tree[i] = self._GONE
        while i > 1:
            i >>= 1
            most = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == most:
                break
            tree[i] = most

    def first(self, i: int, time: int) -> int:
        if self.ascending:
            return bisect_right(self.times, time, min(i, len(self.times)))
        if i >= self.size:
            return len(self.times)
        tree, i = self.tree, i + self.size
        while tree[i] <= time:
            while i & 1:  # a right side: up to the next subtree
                i >>= 1
            if not i:
                return len(self.times)
            i += 1
        while i < self.size:
            i = 2 * i if tree[2 * i] > time else 2 * i + 1
        return i - self.size


def edit_groups(ops: list[dict], gap_us: int):
    """(group, number of operations seen) of a feature's operations in canonical order, each with ``us`` and ``uid``.

    A group begins with the first operation that is left and goes on through its contributor's, until any that is left is
    more than the gap later than the group's last. Each contributor's operations wait in a queue, so nothing is gone through twice."""
    queues: dict = {}
    for i, op in enumerate(ops):
        queues.setdefault(op["uid"], deque()).append(i)
    later, taken, seen = _Later([op["us"] for op in ops]), [False] * len(ops), 0
    for head in range(len(ops)):
        if taken[head]:
            continue
        own, group, at = queues[ops[head]["uid"]], [], head
        while True:
            own.popleft()
            group.append(at)
            taken[at] = True
            later.take(at)
            end = later.first(at + 1, ops[at]["us"] + gap_us)
            if not own or own[0] >= end:
                break
            at = own[0]
        seen = max(seen, end, at + 1)
        yield [ops[i] for i in group], seen


def type_matches(t: FeatureType, tags: dict[str, str]) -> bool:
    """As ``filters.feature_types_of``, for one map of tags."""
    for key, values in t.include.items():
        value = tags.get(key)
        if value is None:
            continue
        if not values and value not in t.exclude.get(key, ()) or values == ("_value",) or value in values:
            return True
    return False


class Rules:
    """The action definitions, ready to be held against operations."""

    def __init__(self, config: AnalysisConfig):
        self.definitions = [
            (d.name, d.action_type, d.geometry_type, {r.operation_type for r in d.rules if r.entry_point != "NO"}, {HIERARCHY.get(r.operation_type, 0) for r in d.rules}) for d in config.actions
        ]

    def find(self, ops: list[dict], action_type: str):
        for op in ops:
            for d in self.definitions:
                if d[1] == action_type and d[2] in ("UNDEFINED", op["geometry_type"]) and op["operation_type"] in d[3]:
                    return d
        return None

    def actions(self, ops: list[dict], action_type: str):
        """(name, type, operations): ops, from the highest level down, taken by one definition after the other.

        What no CREATE takes is offered to UPDATE; what remains then isn't part of an action."""
        while ops:
            d = self.find(ops, action_type)
            if d is None:
                if action_type != "CREATE":
                    return
                action_type = "UPDATE"
                continue
            taken = [op for op in ops if HIERARCHY.get(op["operation_type"], 0) in d[4]]
            yield d[0], action_type, taken
            ops = [op for op in ops if HIERARCHY.get(op["operation_type"], 0) not in d[4]]


class Past:
    """What actions depend on of a feature's earlier operations."""

    def __init__(self):
        self.state, self.tags, self.types = FeatureState(), {}, []


def feature_actions(ops: list[dict], config: AnalysisConfig, rules: Rules, past: Past | None = None):
    """(feature type, action name, action type, operations, WKT, deleted) of one feature's operations in canonical order, which
    follow on ``past``; that is brought up to date."""
    past = past or Past()
    state, folded, tags = past.state, 0, past.tags
    for group, seen in edit_groups(ops, config.action_gap_ms * 1000):
        while folded < seen:
            state.apply(ops[folded])
            folded += 1
        for op in group:
            if op["operation_type"].startswith(_CLEARS):
                tags.clear()
            elif op["operation_type"] in ("OP_ADD_TAG", "OP_MODIFY_TAG_VALUE"):
                tags[op["key"]] = op["value"]
            elif op["operation_type"] == "OP_REMOVE_TAG":
                tags.pop(op["key"], None)
        now = [t for t in config.feature_types if type_matches(t, tags)]
        ordered = sorted(group, key=lambda op: -HIERARCHY.get(op["operation_type"], 0))
        due = [(t, "DELETE") for t in past.types if t not in now] + [(t, "UPDATE" if t in past.types else "CREATE") for t in now]
        shapes = state.shapes(config.short_rings) if due else {}
        for t, kind in due:
            if t.geometry not in shapes:
                continue
            own = ordered
            if config.only_feature_type_tags:
                own = [op for op in own if not op["operation_type"].endswith(("_TAG", "_TAG_VALUE")) or op["key"] in t.properties]
            for name, action_type, taken in rules.actions(own, kind):
                yield t.name, name, action_type, taken, shape_wkt(t.geometry, shapes[t.geometry]), state.deleted
        past.types = now
    for op in ops[folded:]:
        state.apply(op)


_OP_TYPES = {"geometry_type": pa.string(), "oid": pa.int64(), "version": pa.int32(), "seq": pa.int32(), "operation_type": pa.string(), "uid": pa.int32(), "us": pa.int64(), "changeset": pa.int64(), "lon": pa.float64(), "lat": pa.float64(), "key": pa.string(), "value": pa.string(), "ref_id": pa.int64(), "position": pa.int32()}
_OP = pa.struct([(c if c != "ts" else "us", _OP_TYPES[c if c != "ts" else "us"]) for c in OPERATION_COLUMNS])
_SCHEMA = pa.schema(
    [("geometry_type", pa.string()), ("oid", pa.int64()), ("action_no", pa.int32()), ("feature_type", pa.string()), ("action_name", pa.string()), ("action_type", pa.string()), ("operations", pa.list_(_OP)), ("geom_wkt", pa.string()), ("deleted", pa.bool_())]
)
_DDL = "geometry_type string, oid long, action_no int, feature_type string, action_name string, action_type string, operations array<struct<" + ",".join(f"{c if c != 'ts' else 'us'}:{'bigint' if c in ('oid', 'ts', 'changeset', 'ref_id') else 'double' if c in ('lon', 'lat') else 'int' if c in ('version', 'seq', 'uid', 'position') else 'string'}" for c in OPERATION_COLUMNS) + ">>, geom_wkt string, deleted boolean"


def generate_actions(operations: DataFrame, config: AnalysisConfig) -> DataFrame:
    """operations -> ACTIONS, in canonical order within a feature by ``action_no``. Relations never make actions, nor do
    features that never had a key of a feature type: they don't reach Python."""
    rules = Rules(config)

    def run(batches):
        rows = []
        for key, ops in grouped_rows(batches, 2):
            for n, (feature_type, name, kind, taken, wkt, deleted) in enumerate(feature_actions(list(ops), config, rules)):
                rows.append((*key, n, feature_type, name, kind, taken, wkt, deleted))
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    keys = sorted({k for t in config.feature_types for k in t.include})
    typed = F.col("operation_type").isin(*TAG_SET) & F.col("key").isin(*keys)
    rows = by_feature(operations.where("geometry_type != 'RELATION'").withColumn("ts", F.col("ts").cast("timestamp")), only=typed)
    rows = rows.withColumn("ts", F.unix_micros("ts")).withColumnRenamed("ts", "us").withColumn("uid", F.col("uid").cast("int")).withColumn("version", F.col("version").cast("int")).withColumn("seq", F.col("seq").cast("int")).withColumn("position", F.col("position").cast("int"))
    return named_actions(rows.mapInArrow(run, _DDL))


def named_actions(made: DataFrame) -> DataFrame:
    """ACTIONS of rows whose operations have their times in microseconds."""
    timed = F.transform("operations", lambda o: F.struct(*((F.timestamp_micros(o["us"]) if c == "ts" else o[c]).alias(c) for c in OPERATION_COLUMNS)))
    first = lambda c: F.col("operations")[0][c]
    made = made.withColumn("operations", timed)
    return made.select(*FEATURE, "action_no", "feature_type", "action_name", "action_type", first("uid").alias("uid"), first("ts").alias("ts"), first("operation_type").alias("first_operation"), F.size("operations").alias("n_operations"), "operations", "geom_wkt", "deleted").select(*ACTIONS.fieldNames())
