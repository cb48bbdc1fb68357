"""Joins of lineitem are dealt to more tasks where there are more rows; results don't depend on it."""

from editlens.operators import enrich
from editlens.plans import adapters, registry

SF = "/root/testdata/sf0.001"


def test_more_rows_more_tasks(spark, monkeypatch):
    names = ("j2_as_of_coordinate", "j3_moves_of_members", "j5_split_and_merged_ways")
    few = {n: sorted(map(tuple, registry.queries()[n](spark, SF).collect())) for n in names}
    monkeypatch.setattr(adapters, "TASK_ROWS", 500)
    assert adapters.line_tasks(spark, SF) > 10
    for n in names:
        rows = registry.queries()[n](spark, SF)
        assert sorted(map(tuple, rows.collect())) == few[n]


def test_ways_of_changesets_without_a_key_are_not_told(spark):
    columns = "geometry_type string, oid long, version int, seq int, operation_type string, uid int, ts timestamp, changeset long, lon double, lat double, key string, value string, ref_id long, position int"
    op = lambda oid, seq, kind, changeset, ref: ("LINE", oid, 1, seq, kind, 1, None, changeset, None, None, "", "", ref, 0)
    rows = [op(1, 0, "OP_CREATE_WAY", c, -1) for c in (5, None)] + [op(1, 1, "OP_ADD_NODE", c, 7) for c in (5, None)] + [op(2, 0, "OP_REMOVE_NODE", c, 7) for c in (5, None)]
    for n in (None, 3):
        found = enrich.split_and_merged_ways(spark.createDataFrame(rows, columns), n).collect()
        assert [(r.oid, r.changeset, r.operation_type) for r in found] == [(1, 5, "OP_SPLIT_WAY")]
