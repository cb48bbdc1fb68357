"""Actions by rules of a stream of operations: the batch's fold, carried on from one micro-batch to the next.

A feature's operations wait until the watermark is more than the gap later than the last of them. Nothing that may still
arrive can belong to their groups then, so they are folded and their actions come out; what stays is the feature's state (tags,
geometry, types, number of actions) and operations that aren't over yet. The result equals ``generate_actions`` of all operations
wherever operations that lie more than the gap apart have their versions in the order of their times, and none is later
than ``late``: such rows are left out, as in every stream with a watermark.

Operations without a time, relations and features without an id make no actions; an operation that arrives twice counts twice.
The state of a feature is one pickle in Spark's state store, so a checkpoint is read by the version of this library that wrote it."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.actions import _DDL, Past, Rules, feature_actions, named_actions
from ..operators.filters import FEATURE
from ..plans.config import AnalysisConfig
from ..plans.schema import HIERARCHY, OPERATION_COLUMNS

_NAMES = ["geometry_type", "oid", "action_no", "feature_type", "action_name", "action_type", "operations", "geom_wkt", "deleted"]
_FIELDS = [c if c != "ts" else "us" for c in OPERATION_COLUMNS]


def _quiet(waiting: list[dict], gap_us: int):
    """Runs of operations, by time, with no gap over ``gap_us`` within."""
    run: list[dict] = []
    for op in sorted(waiting, key=lambda op: op["us"]):
        if run and op["us"] - run[-1]["us"] > gap_us:
            yield run
            run = []
        run.append(op)
    if run:
        yield run


def action_stream(operations: DataFrame, config: AnalysisConfig, late: str = "1 day") -> DataFrame:
    """A stream of OPERATIONS -> a stream of ACTIONS, for append mode."""
    rules, gap_us = Rules(config), config.action_gap_ms * 1000

    def fold(key, frames, state: GroupState):
        past, made, waiting = pickle.loads(state.get[0]) if state.exists else (Past(), 0, [])
        for frame in frames:
            columns = [[None if pd.isna(v) else v for v in frame[c].tolist()] for c in _FIELDS]
            waiting += (dict(zip(_FIELDS, row)) for row in zip(*columns))
        over, rows = state.getCurrentWatermarkMs() * 1000, []
        runs = list(_quiet(waiting, gap_us))
        while runs and runs[0][-1]["us"] + gap_us < over:
            run = sorted(runs.pop(0), key=lambda op: (op["version"], op["us"], -HIERARCHY.get(op["operation_type"], 0), op["seq"]))
            for feature_type, name, kind, taken, wkt, deleted in feature_actions(run, config, rules, past):
                rows.append((*key, made, feature_type, name, kind, taken, wkt, deleted))
                made += 1
        waiting = [op for run in runs for op in run]
        state.update((pickle.dumps((past, made, waiting)),))
        if runs:
            state.setTimeoutTimestamp((runs[0][-1]["us"] + gap_us) // 1000 + 1)
        yield pd.DataFrame(rows, columns=_NAMES)

    rows = operations.where("ts IS NOT NULL AND oid IS NOT NULL AND geometry_type != 'RELATION'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.withColumn("us", F.unix_micros("ts")).select("ts", *_FIELDS)
    return named_actions(rows.groupBy(*FEATURE).applyInPandasWithState(fold, _DDL, "kept binary", "append", GroupStateTimeout.EventTimeTimeout))
