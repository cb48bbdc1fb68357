"""Long histories folded slice by slice, against the plain fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from editlens.operators import fold
from editlens.operators.split_fold import Lengths, SliceChange, changed, with_slices
from editlens.plans.config import default_config
from editlens.plans.schema import OPERATION_COLUMNS, OPERATION_TYPES, OPERATIONS

T0 = dt.datetime(2015, 1, 1)
KINDS = ["OP_ADD_NODE"] * 3 + ["OP_ADD_MEMBER"] * 3 + ["OP_REMOVE_NODE", "OP_REMOVE_MEMBER"] * 2 + ["OP_REORDER_NODE", "OP_REORDER_MEMBER", "OP_MODIFY_WAY_COORDINATE", "OP_MODIFY_ROLE"] * 2 + [n for n, _, _ in OPERATION_TYPES]


def histories(r, sizes):
    """Operations of features in an order of their own, with edits beyond the ends of lists and values that are null."""
    rows = []
    for oid, n in enumerate(sizes):
        geometry, version, hours = r.choice(["POINT", "LINE"]), 1, 0
        for i in range(n):
            kind = r.choice(KINDS)
            version, hours = version + r.randrange(2), hours + r.randrange(3)
            at = (float(r.randrange(5)), float(r.randrange(5))) if r.random() < 0.8 else (None, 1.0)
            value = None if r.random() < 0.1 else f"v{r.randrange(4)}"
            rows.append((geometry, oid, version, i, kind, 1, T0 + dt.timedelta(hours=hours), 1, *at, r.choice(["highway", "building", "n", "w"]), value, r.randrange(6), r.randrange(-1, 9)))
    return rows


def test_lengths_are_those_of_lists():
    r = random.Random(3)
    for _ in range(300):
        edits = [("add" if r.random() < 0.5 else "remove", r.randrange(-1, 9)) for _ in range(r.randrange(40))]
        lengths = Lengths()
        for kind, place in edits:
            lengths.add() if kind == "add" else lengths.remove(place)
        for start in range(25):
            n = start
            for kind, place in edits:
                n += 1 if kind == "add" else -1 if 0 <= place < n else 0
            assert lengths.after(start) == n


def test_changes_of_slices_are_the_fold():
    r = random.Random(4)
    for _ in range(200):
        ops = [dict(zip(OPERATION_COLUMNS, row)) for row in histories(r, [r.randrange(1, 120)])]
        plain, state = fold.FeatureState(), fold.FeatureState()
        while ops:
            n = r.randrange(1, 30)
            now, ops = ops[:n], ops[n:]
            change = SliceChange(len(state.nodes), len(state.members))
            for op in now:
                plain.apply(op)
                change.apply(op)
            state = changed(state, change.row())
            assert (state.point, state.nodes, state.members, state.tags, state.visible) == (plain.point, plain.nodes, plain.members, plain.tags, plain.visible)


@pytest.mark.parametrize("slice_rows", [1, 7, 100])
def test_slices_equal_the_plain_fold(spark, slice_rows):
    rows = histories(random.Random(slice_rows), [1, 0, 3, 900, 40, 40, 2500, 5])
    random.Random(1).shuffle(rows)
    ops = spark.createDataFrame(rows, OPERATIONS)
    held = lambda df: {(r.geometry_type, r.oid): r.asDict(True) for r in df.collect()}
    assert held(fold.elements_at(ops, slice_rows=slice_rows)) == held(fold.elements_at(ops))
    until = T0 + dt.timedelta(hours=300)
    assert held(fold.elements_at(ops, until, slice_rows)) == held(fold.elements_at(ops, until))
    assert held(fold.assembled_features(ops, default_config(), slice_rows)) == held(fold.assembled_features(ops, default_config()))


def test_slices_follow_the_order_and_have_about_the_size_asked_for(spark):
    ops = spark.createDataFrame(histories(random.Random(5), [20_000, 30]), OPERATIONS)
    by_order = with_slices(ops, 500).where("oid = 0").groupBy("slice").agg(F.count("*").alias("n"), F.min("version").alias("a"), F.max("version").alias("b")).orderBy("slice").collect()
    assert 20 <= len(by_order) <= 70 and sum(r.n for r in by_order) == 20_000 and max(r.n for r in by_order) < 5_000
    assert all(x.b <= y.a for x, y in zip(by_order, by_order[1:]))


def test_nothing_gives_nothing(spark):
    assert fold.elements_at(spark.createDataFrame([], OPERATIONS), slice_rows=10).count() == 0


def test_short_slices_share_batches():
    import pyarrow as pa

    from editlens.operators import split_fold

    n, each = 500, 4
    key = {"geometry_type": ["LINE"] * n * each, "oid": [i // each for i in range(n * each)], "slice": [0] * n * each}
    edits = pa.RecordBatch.from_pydict(key | {"operation_type": ["OP_ADD_NODE"] * n * each, "position": [0] * n * each})
    ops = {"operation_type": ["", *["OP_ADD_NODE"] * (each - 1)] * n, "lon": [None] * n * each, "lat": [None] * n * each, "key": [""] * n * each, "value": [""] * n * each, "ref_id": [0, *[7] * (each - 1)] * n, "position": [0] * n * each}
    for run, rows in ((split_fold._lengths, edits), (split_fold._changes, pa.RecordBatch.from_pydict(key | ops))):
        out = list(run(iter([rows])))
        assert sum(b.num_rows for b in out) == n
        assert len(out) == 1
        assert sorted(x for b in out for x in b.column("oid").to_pylist()) == list(range(n))
