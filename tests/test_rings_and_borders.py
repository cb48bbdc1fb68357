"""Closed ways of few nodes, and geometries that only touch a region."""

import json
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from editlens.functions import geo
from editlens.operators import fold
from editlens.plans import registry


def test_short_rings_are_lines_if_asked_for():
    for size in (2, 3):
        state = fold.FeatureState()
        state.nodes = [[i, at] for i, at in enumerate([(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)] if size == 3 else [(1.0, 1.0)] * 2)]
        assert state.shapes() == {}
        assert set(state.shapes(short_rings=True)) == {"LineString"}


@pytest.mark.parametrize("name", ["f10_exported_features", "f10_exported_features_in_slices", "f3_region_exact", "actions_by_rules", "actions_by_rules_of_lines", "actions_by_rules_only_properties", "a15_batch_general_by_rules"])
def test_a_way_there_and_back_is_as_in_sql(spark, tmp_path, name):
    # a way is made, tagged, and gets the nodes A, B and A again; coordinates repeat after 27,300 events
    kinds = [(1, "view"), (16, "signup"), (31, "signup"), (27316, "signup"), (46, "click"), (27346, "click")]
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=h), 0, kind, json.dumps({"k": 0})) for h, (i, kind) in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.sql(registry.oracle_sql()[name]).select(*(f'"{c}"' for c in found.columns)).fetchall()
    assert want and sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_points_on_borders_are_inside():
    square = [np.array([(9.5, 46.4), (12.3, 46.4), (12.3, 49.0), (9.5, 49.0), (9.5, 46.4)])]
    for i in range(261):
        y = float(f"{46.4 + i / 100:.7f}")
        assert geo.inside((12.3, y), square) and geo.inside((9.5, y), square), y
        assert not geo.inside((12.3000001, y), square) and not geo.inside((9.4999999, y), square), y


def test_lines_through_a_corner_touch():
    box = lambda x, y, u, v: [np.array([(x, y), (u, y), (u, v), (x, v), (x, y)])]
    for line, area in (([(14.72, 47.02), (11.97, 48.67)], box(12.295, 48.475, 13.695, 48.995)), ([(14.5, 48.2), (10.0, 47.7)], box(12.295, 47.435, 13.695, 47.955))):
        line = np.array(line)
        assert geo.intersects("LINESTRING", [line], "POLYGON", area) and geo.distance("LINESTRING", [line], "POLYGON", area) == 0
        found = [geo.intersects("LINESTRING", [line + [0, step]], "POLYGON", area) for step in (-1e-7, 1e-7)]
        assert sorted(found) == [False, True]  # only one of the two ways leads into it


def test_turns_hold_in_decimals():
    rng = np.random.default_rng(3)
    a, d = np.round(rng.uniform(-50, 50, (500, 2)), 2), np.round(rng.uniform(-1, 1, (500, 2)), 2)
    b, c = np.round(a + 3 * d, 2), np.round(a + 7 * d, 2)
    assert not geo.turns(a, b, c).any()
    side = np.round(np.stack([-d[:, 1], d[:, 0]], 1), 2)
    some = (side != 0).any(1)
    assert (geo.turns(a, b, np.round(c + side, 2))[some] == 1).all() and (geo.turns(a, b, np.round(c - side, 2))[some] == -1).all()
