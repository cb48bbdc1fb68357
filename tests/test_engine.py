"""Enrichment, folds, actions, filters, regions, settings, sources and analyzers on worked examples."""

import datetime as dt
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from editlens.functions import geo
from editlens.operators import analyzers, enrich, filters, fold, regions
from editlens.operators.actions import Rules, edit_groups, feature_actions, generate_actions, sessions
from editlens.operators.change_detection import change_detection, edit_distance, edit_distances
from editlens.plans.config import FeatureType, Region, default_config, expand, load_settings
from editlens.plans.schema import OPERATION_COLUMNS, OPERATIONS, OPERATION_TYPES

T0 = dt.datetime(2015, 1, 1)
HOUR = 3600_000_000


def op(kind, oid=1, geom="POINT", version=1, seq=0, uid=1, hours=0.0, at=None, key="", value="", ref=-1, pos=-1, changeset=1):
    return (geom, oid, version, seq, f"OP_{kind}", uid, T0 + dt.timedelta(hours=hours), changeset, at and at[0], at and at[1], key, value, ref, pos)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), OPERATIONS)


def test_operation_dimension():
    assert len(OPERATION_TYPES) == 28 and len({i for _, i, _ in OPERATION_TYPES}) == 28


def test_as_of_takes_the_first_coordinate_where_all_are_later(spark):
    node = [op("CREATE_NODE", 9, at=(1.0, 1.0), hours=9), op("MODIFY_COORDINATE", 9, version=2, at=(2.0, 2.0), hours=12)]
    ways = [op("ADD_NODE", 5, "LINE", hours=h, ref=9, pos=0, version=int(h)) for h in (5, 9, 11, 12, 20)] + [op("ADD_NODE", 5, "LINE", hours=1, ref=77, pos=0, version=99)]
    got = {r.version: r.lon for r in enrich.with_node_coordinates(frame(spark, *node, *ways)).where("operation_type = 'OP_ADD_NODE'").collect()}
    assert got == {5: 1.0, 9: 1.0, 11: 1.0, 12: 2.0, 20: 2.0, 99: None}


def test_moves_reach_ways_even_after_removal(spark):
    rows = [op("CREATE_WAY", 5, "LINE", hours=0), op("ADD_NODE", 5, "LINE", seq=1, hours=1, ref=9, pos=0), op("REMOVE_NODE", 5, "LINE", version=2, hours=2, ref=9, pos=0), op("MODIFY_COORDINATE", 9, version=2, hours=3, at=(4.0, 5.0)), op("MODIFY_COORDINATE", 9, version=1, hours=0.5, at=(3.0, 3.0))]
    got = enrich.way_coordinate_changes(frame(spark, *rows)).collect()
    assert [(r.oid, r.ref_id, r.version, r.lon, r.lat) for r in got] == [(5, 9, 2, 4.0, 5.0)]
    assert enrich.way_coordinate_changes(frame(spark, *rows), respect_removal=True).count() == 0


def test_split_and_merge(spark):
    rows = [op("CREATE_WAY", 2, "LINE"), op("ADD_NODE", 2, "LINE", seq=1, ref=7, pos=0), op("REMOVE_NODE", 1, "LINE", version=2, ref=7, pos=3)]
    rows += [op("DELETE_WAY", 3, "LINE", version=2, seq=1, changeset=8), op("REMOVE_NODE", 3, "LINE", version=2, ref=6, pos=0, changeset=8), op("ADD_NODE", 4, "LINE", version=2, ref=6, pos=1, changeset=8)]
    got = {(r.oid, r.operation_type) for r in enrich.split_and_merged_ways(frame(spark, *rows)).collect()}
    assert got == {(2, "OP_SPLIT_WAY"), (3, "OP_MERGE_WAY")}


@pytest.mark.parametrize(
    "times,want",
    [
        ([(1, 0), (1, 12 * HOUR), (1, 24 * HOUR + 1000)], [[0, 1], [2]]),
        ([(1, 0), (2, HOUR), (1, 2 * HOUR)], [[0, 2], [1]]),
        ([(1, 10 * HOUR), (1, 0), (1, 13 * HOUR)], [[0, 1], [2]]),
    ],
)
def test_groups(times, want):
    ops = [{"uid": u, "us": t, "n": i} for i, (u, t) in enumerate(times)]
    assert [[o["n"] for o in g] for g, _ in edit_groups(ops, 12 * HOUR)] == want


def slow_groups(ops, gap):
    """The grouping as one would do it by hand, crossing off what is done."""
    done, out = set(), []
    while len(done) < len(ops):
        group, last = [], None
        for i, o in enumerate(ops):
            if i in done:
                continue
            if last is not None and o["us"] - last > gap:
                break
            if group and o["uid"] != ops[group[0]]["uid"]:
                continue
            group.append(i)
            last = o["us"]
        done |= set(group)
        out.append(group)
    return out


def rebuilt_groups(ops, gap):
    """The groups and what they have seen, with the list of what is left made anew for each."""
    left, seen, out = list(range(len(ops))), 0, []
    while left:
        last, group = ops[left[0]]["us"], []
        for i in left:
            if ops[i]["us"] - last > gap:
                break
            seen = max(seen, i + 1)
            if ops[i]["uid"] == ops[left[0]]["uid"]:
                group.append(i)
                last = ops[i]["us"]
        left = [i for i in left if i not in group]
        out.append((group, seen))
    return out


@pytest.mark.parametrize("users, span, step", [(1, 3, 2), (3, 40, 0), (4, 5, 3), (9, 200, 0), (3, 12, 6)])
def test_groups_and_what_they_have_seen(users, span, step):
    r = random.Random(users * 100 + span)
    for _ in range(300):
        ops = [{"uid": r.randrange(users), "us": i * step + r.randrange(span), "n": i} for i in range(r.randrange(40))]
        assert [([o["n"] for o in g], seen) for g, seen in edit_groups(ops, 12)] == rebuilt_groups(ops, 12)
        ops = [{**o, "us": t} for o, t in zip(ops, sorted(o["us"] for o in ops))]
        assert [([o["n"] for o in g], seen) for g, seen in edit_groups(ops, 12)] == rebuilt_groups(ops, 12)


@pytest.mark.parametrize("wild", [False, True])
def test_groups_of_many_operations_in_little_time(wild):
    import time

    r, n = random.Random(4), 200_000
    ops = [{"uid": i % 50, "us": r.randrange(n) if wild else 20 * i, "n": i} for i in range(n)]
    began = time.process_time()
    assert sum(len(g) for g, _ in edit_groups(ops, 12)) == n
    assert time.process_time() - began < 30


def test_groups_of_random_histories_and_sessions(spark):
    r = random.Random(0)
    rows, want = [], {}
    for oid in range(60):
        t, ops = 0, []
        for v in range(r.randrange(1, 14)):
            t += r.randrange(0, 16)
            u = r.randrange(3)
            rows.append(op("ADD_TAG", oid, version=v + 1, uid=u, hours=t, key="k", value="v"))
            ops.append({"uid": u, "us": t * HOUR, "n": v})
        assert [[o["n"] for o in g] for g, _ in edit_groups(ops, 12 * HOUR)] == slow_groups(ops, 12 * HOUR)
        want[oid] = sorted(sorted(g) for g in slow_groups(ops, 12 * HOUR))
        back = [{"uid": o["uid"], "us": r.randrange(60) * HOUR, "n": i} for i, o in enumerate(ops)]
        assert [[o["n"] for o in g] for g, _ in edit_groups(back, 12 * HOUR)] == slow_groups(back, 12 * HOUR)
    got = {}
    for x in sessions(frame(spark, *rows), 43_200_000).collect():
        got.setdefault((x.oid, x.uid, x.session), []).append(x.version - 1)
    for oid, groups in want.items():
        assert sorted(sorted(v) for (o, _, _), v in got.items() if o == oid) == groups


def test_actions(spark):
    rows = [op("CREATE_NODE", at=(1.0, 1.0)), op("ADD_TAG", seq=1, key="amenity", value="cafe"), op("MODIFY_TAG_VALUE", version=2, hours=30, key="amenity", value="bar", uid=2), op("REMOVE_TAG", version=3, hours=60, key="amenity"), op("ADD_TAG", version=3, seq=1, hours=60, key="building", value="yes")]
    got = generate_actions(frame(spark, *rows), default_config()).orderBy("action_no").collect()
    assert [(r.action_name, r.feature_type, r.first_operation, r.n_operations) for r in got] == [
        ("AC_CREATE_POINT", "amenity", "OP_CREATE_NODE", 2),
        ("AC_UPDATE_POINT", "amenity", "OP_MODIFY_TAG_VALUE", 1),
        ("AC_DELETE_POINT", "amenity", "OP_REMOVE_TAG", 1),
        ("AC_CREATE_POINT", "buildingPoint", "OP_ADD_TAG", 1),
        ("AC_UPDATE_POINT", "buildingPoint", "OP_REMOVE_TAG", 1),
    ]
    assert got[0].uid == 1 and got[1].uid == 2 and got[0].geom_wkt.startswith("POINT")


def test_levels_are_taken_by_hierarchy():
    config = default_config()
    ops = [dict(zip(OPERATION_COLUMNS, op("CREATE_NODE", at=(1.0, 1.0)))), dict(zip(OPERATION_COLUMNS, op("CREATE_WAY", seq=1)))]
    assert [len(t) for _, _, t in Rules(config).actions(ops, "CREATE")] == [2]


def test_relations_never_make_actions(spark):
    rows = [op("CREATE_RELATION", geom="RELATION"), op("ADD_TAG", geom="RELATION", seq=1, key="building", value="yes")]
    assert generate_actions(frame(spark, *rows), default_config()).count() == 0


def test_nodes_that_stand_more_than_once_move_together():
    from editlens.operators.fold import FeatureState

    r = random.Random(12)
    blank = {"lon": None, "lat": None, "key": "", "value": "", "ref_id": -1, "position": -1}
    for _ in range(300):
        state, plain = FeatureState(), []
        for k in range(60):
            kind = r.choice(["ADD_NODE", "ADD_NODE", "REMOVE_NODE", "REORDER_NODE", "MODIFY_WAY_COORDINATE"])
            ref, place = r.randrange(4), r.randrange(-1, 6)
            state.apply({**blank, "operation_type": f"OP_{kind}", "ref_id": ref, "position": place, "lon": float(k), "lat": 0.0})
            if kind == "ADD_NODE":
                plain.insert(max(place, 0), (ref, (float(k), 0.0)))
            elif kind == "REMOVE_NODE" and 0 <= place < len(plain):
                del plain[place]
            elif kind == "REORDER_NODE" and ref < len(plain):
                plain.insert(max(place, 0), plain.pop(ref))
            elif kind == "MODIFY_WAY_COORDINATE":
                plain = [(n, (float(k), 0.0) if n == ref else c) for n, c in plain]
            assert [tuple(n) for n in state.nodes] == plain


def test_assembly():
    state = fold.FeatureState()
    for i, at in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]):
        state.apply(dict(zip(OPERATION_COLUMNS, op("ADD_NODE", geom="LINE", ref=i % 3, pos=i, at=at))))
    assert set(state.shapes()) == {"LineString", "Polygon"}
    state.apply(dict(zip(OPERATION_COLUMNS, op("MODIFY_WAY_COORDINATE", ref=0, at=(5.0, 5.0)))))
    assert state.shapes()["LineString"][0] == state.shapes()["LineString"][-1] == (5.0, 5.0)
    state.apply(dict(zip(OPERATION_COLUMNS, op("DELETE_WAY"))))
    assert state.deleted and len(state.shapes()["LineString"]) == 4
    state.apply(dict(zip(OPERATION_COLUMNS, op("RECREATE_WAY"))))
    assert not state.deleted
    lone = fold.FeatureState()
    lone.apply(dict(zip(OPERATION_COLUMNS, op("DELETE_NODE"))))
    assert lone.shapes() == {}


def test_tags_and_elements(spark):
    rows = [op("CREATE_NODE", at=(1.0, 2.0)), op("ADD_TAG", seq=1, key="a", value="1"), op("ADD_TAG", seq=2, key="b", value="1"), op("MODIFY_TAG_VALUE", version=2, hours=5, key="a", value="2"), op("REMOVE_TAG", version=3, hours=9, key="b")]
    assert fold.tags_at(frame(spark, *rows)).first().tags == {"a": "2"}
    assert fold.tags_at(frame(spark, *rows), T0 + dt.timedelta(hours=1)).first().tags == {"a": "1", "b": "1"}
    e = fold.elements_at(frame(spark, *rows)).first()
    assert (e.lon, e.lat, e.tags, e.visible) == (1.0, 2.0, {"a": "2"}, True)
    assert fold.all_tag_values(frame(spark, *rows)).where("key = 'a'").first()["values"] == ["1", "2"]


def test_tag_filter(spark):
    rows = frame(spark, op("ADD_TAG", 1, key="highway", value="x"), op("REMOVE_TAG", 1, version=2, key="highway"), op("ADD_TAG", 2, key="building", value="no"))
    ids = lambda t: sorted(r.oid for r in filters.features_with_tags(rows, t).select("oid").distinct().collect())
    assert ids({"highway": ("x",)}) == [1] and ids({"highway": ("y",), "building": ()}) == [2] and ids(None) == ids({}) == [1, 2]


@pytest.mark.parametrize("year,decade,century", [(1999, 1990, 1900), (2000, 2000, 2000), (2009, 2000, 2000)])
def test_time_periods(spark, year, decade, century):
    row = spark.range(1).select(F.lit(dt.datetime(year, 6, 1)).alias("ts")).select(*(filters.time_period("ts", r, T0).alias(r) for r in ("year", "decade", "century", "eternity"))).first()
    assert (row.year.year, row.decade.year, row.century.year, row.eternity) == (year, decade, century, T0.date())


def test_stability_of_single_actions(spark):
    rows = [op("CREATE_NODE", o, at=(1.0, 1.0)) for o in (1, 2)] + [op("ADD_TAG", o, seq=1, key="amenity", value="x") for o in (1, 2)] + [op("MODIFY_TAG_VALUE", 2, version=2, hours=20.5, key="amenity", value="y")]
    acts = generate_actions(frame(spark, *rows), default_config())
    assert {(r.hours_until_edit, r.feature_count) for r in analyzers.feature_stability(acts).collect()} == {(2562047788015, 1), (20, 1)}
    details = analyzers.action_details(acts).collect()
    assert sorted({r.action_id for r in details}) == [1, 2, 3] and len(details) == 5
    assert change_detection(acts).count() == 0


def test_edit_distance():
    assert [edit_distance(*p) for p in (("kitten", "sitting"), ("", "abc"), ("a\U0001f600b", "ab"))] == [3, 3, 2]


def test_edit_distances_of_columns(spark):
    r = random.Random(2)
    pairs = [tuple("".join(r.choices("abß€\U0001f600", k=r.randrange(8))) for _ in range(2)) for _ in range(300)] + [(None, "a"), ("a", None), ("", "")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {x.i: x.n for x in rows.select("i", edit_distances(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: None if a is None or b is None else edit_distance(a, b) for i, (a, b) in enumerate(pairs)}


def test_change_detection(spark):
    line = lambda pts, v0: [op("ADD_NODE", 1, "LINE", seq=i + 1, ref=i, pos=i, at=p) for i, p in enumerate(pts)]
    rows = [op("CREATE_WAY", 1, "LINE"), *line([(13.0, 47.0), (13.01, 47.0)], 0), op("ADD_TAG", 1, "LINE", seq=9, key="highway", value="track"), op("ADD_TAG", 1, "LINE", seq=10, key="name", value="High Street")]
    rows += [op("MODIFY_TAG_VALUE", 1, "LINE", version=2, hours=40, key="name", value="High Streets"), op("MODIFY_TAG_VALUE", 1, "LINE", version=3, hours=80, key="name", value="Other Road"), op("ADD_NODE", 1, "LINE", version=4, hours=120, ref=5, pos=2, at=(13.02, 47.0)), op("MODIFY_WAY_COORDINATE", 1, "LINE", version=5, hours=160, ref=5, at=(13.0101, 47.0))]
    found = change_detection(generate_actions(frame(spark, *rows), default_config())).orderBy("change_no").collect()
    assert [r.status for r in found] == ["CreateGeometry", "StreetNameModifiedLittle", "StreetNameModified", "StreetLengthened", "StreetShortened"]
    assert [r.geometry_diff is None for r in found] == [True] * 4 + [False] and float(found[-1].value_new) < 0.8 * float(found[-1].value_old)
    (x0, _), (x1, _) = (map(float, p.split()) for p in found[-1].geometry_diff[len("LINESTRING (") : -1].split(", "))
    assert abs(x0 - 13.0101) < 1e-6 and x1 == 13.02  # from the new end on
    last = change_detection(generate_actions(frame(spark, *rows), default_config()), round_ends=True).orderBy("change_no").collect()[-1]
    assert 13.0101 + 0.00024 < float(last.geometry_diff[len("LINESTRING (") :].split()[0]) < 13.0101 + 0.00029  # 20 metres behind it


def test_what_lies_outside_a_buffer():
    import numpy as np

    from editlens.functions.geo import outside_buffer, to_segments, within_buffer

    r = np.random.RandomState(4)
    for _ in range(200):
        other = np.cumsum(r.randn(r.randint(1, 6), 2) * 10, 0)
        line = np.cumsum(r.randn(r.randint(2, 5), 2) * 8, 0)
        out = outside_buffer(line, other, 6.0)
        for n, (x, y) in enumerate(zip(line, line[1:])):
            t = r.rand(300)
            far = to_segments(x + (y - x) * t[:, None], other)
            told = np.any([(t > a) & (t < b) for k, a, b in out if k == n] or [np.zeros(300, bool)], 0)
            assert ((far > 6.0) == told)[np.abs(far - 6.0) > 1e-6].all()
        assert within_buffer(line, other, 6.0) == (not out)


def test_geometry():
    square = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]
    assert geo.inside((2, 2), square) and geo.inside((4, 2), square) and not geo.inside((5, 2), square)
    assert geo.intersects("LINESTRING", [[(-1, 2), (5, 2)]], "POLYGON", square) and not geo.intersects("POINT", [[(9, 9)]], "POLYGON", square)
    assert geo.distance("POINT", [[(7, 0)]], "POLYGON", square) == 3 and geo.area(square[0]) == 16 and geo.length([(0, 0), (3, 4)]) == 5
    assert geo.parse_wkt(geo.polygon_wkt(square))[1][0].tolist() == np.array(square[0], float).tolist()
    with pytest.raises(ValueError):
        geo.parse_wkt("POLYGON((0 0, 1 1))")
    x, y = geo.utm33(15.0, 47.0)
    assert abs(x - 500000) < 1e-6 and abs(y - 5205000) < 1000
    x, y = geo.utm33(16.37, 48.21)
    assert abs(x - 601773) < 300 and abs(y - 5340500) < 700
    x, y = geo.gk_central(13.3333, 47.5)
    assert abs(x - 450000) < 300 and 250_000 < y < 275_000


def test_columns_of_geometry(spark):
    one = spark.range(1)
    d = one.select(geo.andoyer(*map(F.lit, (13.0, 47.0, 14.0, 48.0))).alias("d"), geo.andoyer(*map(F.lit, (13.0, 47.0, 13.0, 47.0))).alias("z")).first()
    assert abs(d.d - 134_080) < 500 and d.z == 0
    texts = spark.createDataFrame([(3.0,), (0.25,), (1234567.0,), (0.1234565,)], "x double").select(geo.number_text(F.col("x"))).collect()
    assert [t[0] for t in texts] == ["3.0", "0.25", "1234567.0", "0.123456"]
    path = one.select(geo.quad_path(*map(F.lit, (13.0, 46.0, 13.1, 46.1)), 3)).first()[0]
    assert path == "/NE/NW/SE" or len(path) == 9
    a, b, c, d = geo.quad_box(path)
    assert a < 13.0 and c > 13.1 and b < 46.0 and d > 46.1


def test_hour_of_day_has_a_row_for_every_contributor(spark):
    acts = spark.createDataFrame([("r1", 1, T0), ("r1", 2, T0 + dt.timedelta(hours=7)), ("r2", 1, T0)], "region string, uid int, ts timestamp")
    users = spark.createDataFrame([(1,), (2,), (3,), (3,)], "uid int")
    got = {(r.region, r.uid): (r.h00_06, r.h06_12) for r in analyzers.hour_of_day(acts, users).collect()}
    assert got == {("r1", 1): (1, None), ("r1", 2): (None, 1), ("r1", 3): (None, None), ("r2", 1): (1, None), ("r2", 2): (None, None), ("r2", 3): (None, None)}
    plain = analyzers.hour_of_day(acts.drop("region"), users).collect()
    assert {(r.uid, r.h00_06) for r in plain} == {(1, 2), (2, None), (3, None)}


def test_progress_counts_what_passes(spark):
    from pyspark.sql import Observation

    rows = [op("ADD_TAG", i % 7, version=i, key="k", value="v") for i in range(40)]
    seen = Observation("seen")
    out = analyzers.progress(frame(spark, *rows), seen).groupBy("oid").count()
    assert out.count() == 7 and seen.get == {"operations": 40, "features": 7}


def test_readers_skip_files_by_their_statistics(spark, tmp_path):
    """The index of files is Parquet's own: type and id reach the scan as partition and pushed filters."""
    from editlens.sources.tables import read_operations, write_operations

    write_operations(frame(spark, *(op("ADD_TAG", i, version=1, key="k", value="v") for i in range(500))), f"{tmp_path}/ops")
    some = filters.by_ids(read_operations(spark, f"{tmp_path}/ops").where("geometry_type = 'POINT'"), points=[3, 5])
    plan = some.select("oid", "key")._jdf.queryExecution().executedPlan().toString()
    assert {r.oid for r in some.collect()} == {3, 5}
    assert "PartitionFilters: [isnotnull(geometry_type" in plan and "In(oid, [3,5])" in plan
    assert "ReadSchema: struct<oid:bigint,key:string>" in plan


def test_windows_of_features_and_of_actions(spark):
    """A feature counts with all its actions if its first is within the window; actions count if they are themselves."""
    from editlens.plans.analysis import analyze
    from editlens.plans.config import Analyzer

    rows = []
    for i, hours in enumerate(((0, 100, 300), (200, 320, 350), (290, 400, 500))):
        rows += [op("CREATE_NODE", i, hours=hours[0], at=(10.0 + i, 47.0)), op("ADD_TAG", i, seq=1, hours=hours[0], key="amenity", value="a")]
        rows += [op("MODIFY_TAG_VALUE", i, version=2 + n, hours=h, key="amenity", value=f"b{n}") for n, h in enumerate(hours[1:])]
    config = default_config(analyzers=(Analyzer("FeatureStability"), Analyzer("ActionPerType")), start=T0 + dt.timedelta(hours=150), end=T0 + dt.timedelta(hours=360))
    results = analyze(frame(spark, *rows), config)
    # the first feature begins before the window; of the third the second action lies behind it
    assert {(r.hours_until_edit, r.feature_count) for r in results["FeatureStability"].collect()} == {(120, 1), (110, 1)}
    assert results["ActionPerType"].agg(F.sum("count")).first()[0] == 5
    results.release()


def test_regions_of_many_sizes_by_grid_cells(spark):
    """The equi-join on cells finds exactly what holding every feature against every region finds."""
    import random

    from editlens.functions import geo

    r = random.Random(8)
    rows, lines = [], {}
    for i in range(120):
        x, y, size = r.uniform(-20, 40), r.uniform(-50, 50), r.choice((0.0001, 0.01, 0.5, 8.0))
        points = [(x + r.uniform(-size, size), y + r.uniform(-size, size)) for _ in range(4)]
        lines[i] = points
        rows += [op("CREATE_WAY", i, "LINE", hours=0), op("ADD_TAG", i, "LINE", seq=1, hours=0, key="highway", value="path"), *(op("ADD_NODE", i, "LINE", seq=2 + p, hours=0, at=at, ref=p, pos=p) for p, at in enumerate(points))]
    areas = []
    for n in range(60):
        x, y, size = r.uniform(-20, 40), r.uniform(-50, 50), r.choice((0.001, 0.2, 3.0, 60.0))
        if n % 3 == 0:
            x, y = lines[n][0]
        areas.append(Region(f"a{n}", geo.polygon_wkt([[(x - size, y - size), (x + size, y - size), (x, y + size), (x - size, y - size)]])))
    got = {(x.region, x.oid) for x in regions.features_in_regions(frame(spark, *rows), default_config(), areas).collect()}
    rounded = {i: [tuple(map(float, p.split())) for p in geo.line_wkt(points)[12:-1].split(", ")] for i, points in lines.items()}
    want = {(a.label, i) for a in areas for i, points in rounded.items() if geo.intersects("LINESTRING", [points], *geo.parse_wkt(a.wkt))}
    assert got == want and len(want) > 60
    near = {x.oid for x in regions.near_regions(frame(spark, *rows), areas).select("oid").distinct().collect()}
    boxes = [(*geo.parse_wkt(a.wkt)[1][0].min(0), *geo.parse_wkt(a.wkt)[1][0].max(0)) for a in areas]
    assert near == {i for i, points in lines.items() if any(x0 <= x <= x1 and y0 <= y <= y1 for x0, y0, x1, y1 in boxes for x, y in points)}


def test_a_profile_from_end_to_end(spark, tmp_path):
    from editlens.plans import run
    from editlens.plans.schema import ELEMENT_VERSIONS
    from editlens.sources.tables import read_quadrants, read_regions

    v = lambda i, n, x, **tags: ("NODE", i, n, 1, "u", T0 + dt.timedelta(hours=20 * n), n, True, tags, x, 47.0, None, None)
    versions = spark.createDataFrame([v(i, n, 10.0 + i + n / 100, amenity=f"a{n}") for i in range(8) for n in (1, 2)], ELEMENT_VERSIONS)
    profile = f"""<settings><general settingName="s" pbfDataFolder="{tmp_path}/data" resultFolder="{tmp_path}/out" readQuadtree="true"/>
<analysis temporalResolution="year"><featureType name="amenity" geometryType="Point"><includeTag key="amenity" value=""/></featureType><analysisSubject name="OperationPerType"/><analysisSubject name="FeatureStability"/>
<actionDefinition name="AC_CREATE" actionType="CREATE"><definitionRule operationType="OP_CREATE_NODE"/></actionDefinition><actionDefinition name="AC_UPDATE" actionType="UPDATE"><definitionRule operationType="OP_MODIFY_TAG_VALUE"/></actionDefinition></analysis>
<filterPolygons><polygon label="p" geometry="POLYGON((9.5 46,12.5 46,12.5 48,9.5 48,9.5 46))"/></filterPolygons></settings>"""
    config = load_settings(profile)
    run.import_operations(versions, config)
    run.build_quadtree(spark, config, capacity=2)
    run.write_raster(spark, config, 0.0, 0.0, 50_000.0, 40_000.0)
    took = run.run_analysis(spark, config)
    assert set(took) == {"OperationPerType", "FeatureStability"}
    lines = {r[0] for r in spark.read.text(str(tmp_path / "out" / "feature_stability.csv")).collect()}
    assert "20;3" in lines or any(x.endswith(";3") for x in lines)  # three of eight features lie in the region
    parts = read_quadrants(spark, f"{tmp_path}/data/quadtree", list(config.regions))
    assert {r[0] for r in parts.select("localized").distinct().collect()} <= {"WITHIN", "OVERLAPS", None}
    assert parts.select("oid").distinct().count() < 8
    assert len(read_regions(spark, f"{tmp_path}/data/raster")) > 10


def test_every_analyzer_gives_each_region_what_it_gives_it_alone(spark, monkeypatch):
    from editlens.operators import analyzers, regions
    from editlens.plans.analysis import analyze
    from editlens.plans.config import Analyzer

    monkeypatch.setattr(regions, "BLOCK", 40)  # each region's geometry goes to tasks by itself
    monkeypatch.setattr(analyzers, "ANALYZERS", dict(analyzers.ANALYZERS))

    @analyzers.analyzer("UsersOfTypes")
    def users_of_types(run, settings):
        return run.actions.groupBy(*analyzers.by_region(run.actions, "feature_type")).agg(F.count_distinct("uid").alias(settings.get("column", "users")))

    with pytest.raises(ValueError):
        analyzers.analyzer("UsersOfTypes")(users_of_types)

    rows = []
    for i in range(12):  # three in each overlap
        at = (i + 0.5, 0.5)
        rows += [op("CREATE_NODE", i, hours=i, at=at, changeset=i), op("ADD_TAG", i, seq=1, hours=i, key="building", value="yes", changeset=i), op("MODIFY_TAG_VALUE", i, version=2, hours=i + 50, uid=2 + i % 2, key="building", value="shop", changeset=i + 100), op("MODIFY_COORDINATE", i, version=3, hours=i + 99, at=(i + 0.6, 0.5), changeset=i + 200)]
        rows += [op("CREATE_WAY", i, "LINE", hours=i), op("ADD_TAG", i, "LINE", seq=1, hours=i, key="highway", value="path"), *(op("ADD_NODE", i, "LINE", version=v, seq=2 + p + v, hours=i + v, at=(i + 0.2 + 0.1 * p + 0.01 * v, 0.5), ref=1000 + p, pos=p) for v in (1, 2) for p in (0, 1))]
    ops = frame(spark, *rows)
    squares = [Region(f"r{n}", f"POLYGON (({a} 0, {b} 0, {b} 1, {a} 1, {a} 0))") for n, a, b in ((0, 0, 7), (1, 4, 12))]
    names = ["OperationPerType", "ActionPerType", "ActionPerFeatureType", "UserPerAction", "UserPerOperation", "UserPerTags", "Tags", "HourOfDay", "GeometryType", "ActionDetails", "FeatureStability", "Update", "UpdateGeometry", "ChangeDetection", "BatchGeneral", "BatchContributor", "BatchUserActionType", "UsersOfTypes"]
    config = default_config(analyzers=tuple(Analyzer(n, {"includeOperationDetails": "true"}) for n in names))
    plain = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    together = analyze(ops, config.with_(regions=tuple(squares)))
    for square in squares:
        alone = analyze(ops, config.with_(regions=(square,)))
        for n in names:
            assert "region" in together[n].columns, n
            assert plain(together[n].where(F.col("region") == square.label)) == plain(alone[n]), n
    assert together["ActionPerType"].agg(F.sum("count")).first()[0] > 0 and together["ChangeDetection"].count() > 0


def test_quadtree_and_regions(spark, tmp_path):
    from editlens.sources.tables import read_operations, read_quadrants, write_operations, write_quadtree

    rows = [x for i in range(40) for x in (op("CREATE_NODE", i, at=(10 + i / 4, 47.0 + i / 100)), op("ADD_TAG", i, seq=1, key="amenity", value="x"))]
    ops = frame(spark, *rows)
    paths = regions.adaptive_quadtree(regions.quadtree(ops), capacity=8)
    sizes = paths.groupBy("quadrant").count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) <= 8
    write_quadtree(ops, paths, f"{tmp_path}/qt")
    region = Region("r", "POLYGON ((10 46, 11 46, 11 48, 10 48, 10 46))")
    assert {0, 1, 2, 3, 4} <= {r.oid for r in read_quadrants(spark, f"{tmp_path}/qt", [region]).select("oid").distinct().collect()}
    got = {r.oid for r in regions.features_in_regions(ops, default_config(), [region]).collect()}
    assert got == {0, 1, 2, 3, 4}
    write_operations(ops, f"{tmp_path}/ops")
    back = read_operations(spark, f"{tmp_path}/ops")
    assert back.count() == 80 and back.exceptAll(ops.select(*back.columns)).count() == 0
    grid = regions.hexagon_grid(spark, 0, 0, 30_000, 20_000)
    assert grid.select("id").distinct().count() == grid.count() and grid.where("row = 0 AND col = 0").first().wkt.startswith("POLYGON ((0.0000000 ")


XML = """<settings xmlns="http://example.org"><general settingName="s" pbfDataFolder="%home%/x" filterTimestamp="2016-01-01T00:00:00Z"/>
<filterTags><includeTag key="highway" value=""/><includeTag key="highway" value="a"/><includeTag key="b" value=""/></filterTags>
<analysis analysisStartDate="2014-01-01T00:00:00Z" temporalResolution="month" actionTimeBuffer="1000">
<featureType name="street" geometryType="LineString"><includeTag key="highway" value=""/><excludeTag key="highway" value="no"/><property key="name"/></featureType>{extra}
<analysisSubject name="OperationPerType"/><analysisSubject name="UserPerTags"><analysisSetting key="tagKey" value="k"/></analysisSubject>
<actionDefinition name="A" actionType="CREATE" geometryType="LINE"><definitionRule operationType="OP_CREATE_WAY" entryPoint="YES"/></actionDefinition></analysis>
<filterPolygons><polygon label="p" geometry="POLYGON((0 0,1 0,1 1,0 0))"/></filterPolygons></settings>"""


def test_settings(spark):
    c = load_settings(XML.replace("{extra}", ""), {"home": "/h"})
    assert c.data_folder == "/h/x" and c.filter_tags == {"highway": ("a",), "b": ()} and c.action_gap_ms == 1000 and c.temporal_resolution == "month"
    assert c.feature_types == (FeatureType("street", "LineString", {"highway": ()}, {"highway": ("no",)}, ("name",)),) and c.regions[0].label == "p" and c.analyzers[1].settings == {"tagKey": "k"}
    with pytest.raises(ValueError):
        load_settings(XML.replace("{extra}", '<featureType name="street" geometryType="Point"/>'))
    assert expand("%a%/%b%", {"a": "1"}) == "1/%b%"


def test_analysis_to_files(spark, tmp_path):
    from editlens.plans.analysis import analyze, import_history
    from editlens.plans.config import Analyzer
    from editlens.plans.schema import ELEMENT_VERSIONS
    from editlens.sources.tables import read_regions, write_feature_collection, write_metadata, write_results

    v = lambda kind, i, n, **k: (kind, i, n, 1, "u", T0 + dt.timedelta(hours=n), n, True, k.get("tags", {}), *k.get("at", (None, None)), k.get("nodes"), k.get("members"))
    rows = [v("NODE", 1, 1, at=(13.0, 47.0), tags={"amenity": "cafe"}), v("NODE", 2, 1, at=(13.01, 47.0)), v("WAY", 3, 2, nodes=[1, 2], tags={"highway": "track"}), v("NODE", 2, 40, at=(13.02, 47.0)), v("RELATION", 4, 1, members=[("WAY", 3, "outer")], tags={"building": "yes"})]
    names = ("OperationPerType", "ActionPerType", "ActionPerFeatureType", "UserPerAction", "UserPerOperation", "UserPerTags", "Tags", "HourOfDay", "GeometryType", "ActionDetails", "FeatureStability", "Update", "UpdateGeometry", "ChangeDetection", "BatchGeneral", "BatchContributor", "BatchUserActionType")
    config = default_config(analyzers=tuple(Analyzer(n, {"includeOperationDetails": "true"}) for n in names))
    ops = import_history(spark.createDataFrame(rows, ELEMENT_VERSIONS), config)
    assert ops.where("operation_type = 'OP_MODIFY_WAY_COORDINATE'").count() == 1
    results = analyze(ops, config)
    assert set(results) == set(names)
    took = write_results(results, str(tmp_path / "out"), config)
    write_metadata(spark, config, took, str(tmp_path / "out" / "metadata"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out" / "action_per_type.csv")).collect()]
    assert "action_type;time_period;count;" in lines and "AC_CREATE_LINE;2015-01-01;1;" in lines
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out" / "user_per_action.csv")).collect()]
    assert any(x.split(";")[2:].count("1.0") for x in lines)
    features = fold.assembled_features(ops, config)
    write_feature_collection(features, ["oid", "feature_type"], str(tmp_path / "geom.json"))
    doc = json.loads((tmp_path / "geom.json").read_text())
    assert doc["bbox"] == [13.0, 47.0, 13.02, 47.0]
    assert (tmp_path / "out" / "action_per_type.csv").read_text().startswith("action_type;time_period;count;\n")
    assert json.loads((tmp_path / "out" / "metadata").read_text())["setting"] == config.name
    assert {f["geometry"]["type"] for f in doc["features"]} == {"Point", "LineString"}
    street = fold.with_export_columns(features, config.feature_type("street")).first()
    assert street.highway == "track" and 1400 < street.length < 1700
    (tmp_path / "r.csv").write_text("POLYGON((0 0,1 0,1 1,0 0));a\nnothing;b\n")
    assert [r.label for r in read_regions(spark, str(tmp_path / "r.csv"))] == ["a"]
    west = config.with_(regions=(Region("w", "POLYGON ((12.9 46.9, 13.005 46.9, 13.005 47.1, 12.9 47.1, 12.9 46.9))"),))
    assert {r.region for r in analyze(ops, west)["BatchGeneral"].collect()} == {"w"}


def test_a_store_is_rewritten_in_part(spark, tmp_path):
    from editlens.sources.store import OperationStore

    path = str(tmp_path / "store")
    made = spark.range(20_000).selectExpr("IF(id % 4 = 0, 'LINE', 'POINT') AS geometry_type", "IF(id % 3 = 0, 7, id) AS oid", "CAST(id AS INT) AS version", "0 AS seq", "'OP_ADD_TAG' AS operation_type", "1 AS uid", "timestamp_seconds(id) AS ts", "id AS changeset", "CAST(NULL AS DOUBLE) AS lon", "CAST(NULL AS DOUBLE) AS lat", "'k' AS key", "'v' AS value", "-1L AS ref_id", "-1 AS position", "'x' AS no")
    held = lambda rows: {(r.geometry_type, r.oid, r.version, r.value) for r in rows.collect()}
    want = held(made)
    s = OperationStore(spark, path)
    s.create(made, per_range=500)
    assert held(s.read()) == want and s.read().columns == OPERATION_COLUMNS
    folders = set(s._manifest()[2].folders())
    assert 20 <= len(folders) <= 45  # the feature with a third of all rows is in one range
    assert held(s.read(("LINE",), 100, 900)) == {w for w in want if w[0] == "LINE" and 100 <= w[1] <= 900}
    wanted = spark.createDataFrame([("LINE", 7), ("POINT", 19_999), ("POINT", None), ("AREA", 3), ("POINT", 10**15)], "geometry_type string, oid long")
    rows = s.read_features(wanted)
    assert held(rows) == {w for w in want if w[:2] in (("LINE", 7), ("POINT", 19_999))} and len({f.rsplit("/", 1)[0] for f in rows.inputFiles()}) <= 3
    before = s.read()
    fresh = made.where("geometry_type = 'POINT' AND oid BETWEEN 5000 AND 5200 AND version < 5190").withColumn("value", F.lit("new"))
    replaced = {(w[0], w[1]) for w in held(fresh)}
    n = s.replace(fresh)
    want2 = {w for w in want if w[:2] not in replaced} | held(fresh)
    assert held(s.read()) == want2 and n <= 2 and len(folders - set(s._manifest()[2].folders())) == n
    assert held(before) == want == held(s.read(version=1))
    new = made.where("oid > 19000").withColumn("oid", F.col("oid") + 10_000).withColumn("geometry_type", F.lit("RELATION")).unionByName(made.where("geometry_type = 'POINT'").withColumn("oid", F.col("oid") + 20_000))
    s.replace(new)  # a type that wasn't there, and a last range that is split
    assert held(s.read()) == want2 | held(new) and len(s._manifest()[2].folders()) > len(folders) + 15
    gone = s.read().where("oid >= 20000").select("geometry_type", "oid")
    s.remove(gone)
    assert held(s.read()) == want2 and s.remove(wanted.where("oid IS NULL")) == 0
    assert s.vacuum(1) > 0 and held(s.read()) == want2 and s._versions() == [4] and s.vacuum(1) == 0
    with pytest.raises(ValueError):
        s.replace(made.limit(5).withColumn("oid", F.lit(None).cast("long")))
    with pytest.raises(FileExistsError):
        s.create(made)
    empty = OperationStore(spark, str(tmp_path / "empty"))
    with pytest.raises(FileNotFoundError):
        empty.read()
    empty.create(made.where("false"))
    assert empty.read().count() == 0 and empty.replace(fresh) == 1 and held(empty.read()) == held(fresh)


def test_one_file_of_many_parts(spark, tmp_path):
    from editlens.sources.one_file import write_one_file
    from editlens.sources.tables import write_csv

    path = tmp_path / "x.csv"
    write_csv(spark.range(0, 10_000, 1, 7).withColumn("name", F.concat(F.lit("ü"), "id")), str(path), header=["id", "name"])
    assert path.read_text() == "id;name;\n" + "".join(f"{i};ü{i};\n" for i in range(10_000))
    rows = spark.range(0, 100, 1, 9).where("id % 17 = 3").select(F.when(F.col("id") != 20, F.col("id").cast("string")).alias("value"), F.col("id").cast("double").alias("west"), F.lit(1.0).alias("south"), F.col("id").cast("double").alias("east"), F.lit(2.0).alias("north"))
    write_one_file(rows, f"file://{path}", "{bounds}[", ",", "]")  # in its place; most parts are empty
    assert path.read_text() == "[3.0, 1.0, 88.0, 2.0][3,37,54,71,88]"
    write_one_file(rows.where("false"), str(path), "{bounds}[", ",", "]")
    assert path.read_text() == "null[]"
    for how in (lambda: write_one_file(rows, str(path), overwrite=False), lambda: write_one_file(rows.select(F.raise_error(F.lit("broken")).cast("string").alias("value")), str(path))):
        with pytest.raises(Exception, match="exists|broken"):
            how()
    assert path.read_text() == "null[]" and [p.name for p in tmp_path.iterdir()] == ["x.csv"]
    write_csv(rows, str(tmp_path / "folder"), as_folder=True)
    assert (tmp_path / "folder").is_dir()
    write_csv(rows.select("value"), str(tmp_path / "folder"), trailing=False)
    assert (tmp_path / "folder").read_text() == "3\n\n37\n54\n71\n88\n"


def pbf_field(n, v):
    def varint(x):
        x &= (1 << 64) - 1
        out = b""
        while x > 127:
            out += bytes([x & 127 | 128])
            x >>= 7
        return out + bytes([x])

    if isinstance(v, int):
        return varint(n << 3) + varint(v)
    if isinstance(v, list):
        v = b"".join(varint(x) for x in v)
    return varint(n << 3 | 2) + varint(len(v)) + v


def pbf_blob(kind, raw, packed=True):
    blob = pbf_field(2, len(raw)) + pbf_field(3, zlib.compress(raw)) if packed else pbf_field(1, raw)
    head = pbf_field(1, kind) + pbf_field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def pbf_ways(ids, name=b"bob"):
    """A block of ways, each made a second after the one before; its nodes can't be decoded."""
    zz = lambda x: (x << 1) ^ (x >> 63)
    ways = b"".join(pbf_field(3, pbf_field(1, i) + pbf_field(4, pbf_field(1, 1) + pbf_field(2, i) + pbf_field(3, 9) + pbf_field(4, 3) + pbf_field(5, 1)) + pbf_field(8, [zz(5)])) for i in ids)
    return pbf_field(1, b"".join(pbf_field(1, s) for s in (b"", name))) + pbf_field(2, pbf_field(2, b"\xff")) + pbf_field(2, ways)


def test_tasks_of_a_pbf_file_find_blobs_themselves(spark, tmp_path):
    from editlens.sources.pbf import blobs, read_history

    header = pbf_blob(b"OSMHeader", pbf_field(4, b"DenseNodes"))
    lure = struct.pack(">I", 11) + b"\x0a\x07OSMData\x18\x05" + b"12345"  # a text within a block that looks like a blob
    parts = [header] + [pbf_blob(b"OSMData", pbf_ways(range(n * 50, n * 50 + 50), lure if n % 2 else b"bob"), n % 3 > 0) for n in range(9)] + [header]
    file = b"".join(parts)
    ends = np.cumsum([len(p) for p in parts]).tolist()
    want = list(zip([0, *ends[:-1]], ends))
    read = lambda at, n: file[at : at + n]
    for size in (7, 64, 1000, len(file)):
        got = [b for at in range(0, len(file), size) for b in blobs(read, len(file), at, min(at + size, len(file)))]
        assert [(at, at + n) for _, at, n in got] == [(end - n, end) for (_, end), (_, _, n) in zip(want, got)] and len(got) == len(parts)
    path = str(tmp_path / "y.osh.pbf")
    (tmp_path / "y.osh.pbf").write_bytes(file)
    cut = dt.datetime.fromtimestamp(99, dt.timezone.utc)
    ways = read_history(spark, path, ("WAY",), until=cut, partition_bytes=500)
    assert sorted(r.id for r in ways.where("uid = 3").collect()) == list(range(100))  # nodes would have failed
    assert read_history(spark, path, ("way", "relation"), since=cut).count() == 9 * 50 - 99
    assert read_history(spark, path, ("RELATION",)).count() == 0 and ways.count() == 100
    with pytest.raises(Exception, match="IndexError"):
        read_history(spark, path).collect()
    assert ways.rdd.getNumPartitions() == -(-len(file) // 500)
    with pytest.raises(Exception, match="unknown element types"):
        read_history(spark, path, ("AREA",)).collect()
    cut_off = tmp_path / "z.osh.pbf"
    cut_off.write_bytes(file[:-3])
    with pytest.raises(Exception, match="no whole blob"):
        read_history(spark, str(cut_off), ("WAY",)).collect()
    (tmp_path / "e.osh.pbf").write_bytes(b"")
    assert read_history(spark, str(tmp_path / "e.osh.pbf")).count() == 0


def test_pbf_source(spark, tmp_path):
    from editlens.sources.pbf import HistoryPbf

    zz = lambda x: (x << 1) ^ (x >> 63)
    strings = b"".join(pbf_field(1, s) for s in (b"", b"highway", b"track", b"bob", b"outer"))
    dense = pbf_field(1, [zz(5), zz(0)]) + pbf_field(5, pbf_field(1, [1, 2]) + pbf_field(2, [zz(1000), zz(10)]) + pbf_field(3, [zz(7), zz(1)]) + pbf_field(4, [zz(3), zz(0)]) + pbf_field(5, [zz(3), zz(0)]) + pbf_field(6, [1, 0])) + pbf_field(8, [zz(470000000), zz(0)]) + pbf_field(9, [zz(130000000), zz(0)]) + pbf_field(10, [1, 2, 0, 0])
    info = pbf_field(1, 1) + pbf_field(2, 1000) + pbf_field(3, 9) + pbf_field(4, 3) + pbf_field(5, 3)
    way = pbf_field(1, 11) + pbf_field(2, [1]) + pbf_field(3, [2]) + pbf_field(4, info) + pbf_field(8, [zz(5), zz(1), zz(-1)])
    rel = pbf_field(1, 12) + pbf_field(4, info) + pbf_field(8, [4]) + pbf_field(9, [zz(11)]) + pbf_field(10, [1])
    block = pbf_field(1, strings) + pbf_field(2, pbf_field(2, dense)) + pbf_field(2, pbf_field(3, way) + pbf_field(4, rel))
    out = b""
    for kind, raw in ((b"OSMHeader", pbf_field(4, b"DenseNodes")), (b"OSMData", block)):
        out += pbf_blob(kind, raw)
    (tmp_path / "x.osh.pbf").write_bytes(out)
    spark.dataSource.register(HistoryPbf)
    got = {(r.element_type, r.id, r.version): r for r in spark.read.format("history_pbf").load(str(tmp_path / "x.osh.pbf")).collect()}
    n1, n2, w, m = got["NODE", 5, 1], got["NODE", 5, 2], got["WAY", 11, 1], got["RELATION", 12, 1]
    assert (n1.lon, n1.lat, n1.tags, n1.username, n1.changeset) == (13.0, 47.0, {"highway": "track"}, "bob", 7) and n2.lon is None and not n2.visible
    assert w.nodes == [5, 6, 5] and w.tags == {"highway": "track"} and m.members[0].role == "outer" and m.members[0].element_type == "WAY"


def test_streams(spark, tmp_path):
    from editlens.streaming.counts import edit_sessions, operation_counts

    rows = [op("ADD_TAG", 1, version=i + 1, hours=h, key="k", value="v") for i, h in enumerate((0, 1, 30, 200))]
    frame(spark, *rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    for f, n in ((operation_counts, 2), (edit_sessions, 2)):
        q = f(spark.readStream.schema(OPERATIONS).parquet(f"{tmp_path}/in")).writeStream.outputMode("append").format("memory").queryName(f.__name__).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.sql(f"SELECT * FROM {f.__name__}").count() >= n


def test_actions_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    from editlens.streaming.actions import action_stream

    r, rows = random.Random(5), []
    for oid in range(40):
        t, geom, length = r.randrange(200), ("POINT", "LINE", "RELATION")[oid % 3], 0
        for v in range(1, r.randrange(3, 22)):
            t += r.choice((0, 1, 5, 11, 13, 30, 100))
            how = dict(oid=oid, geom=geom, version=v, uid=r.randrange(2), hours=t)
            if v == 1:
                rows.append(op("CREATE_NODE" if geom == "POINT" else "CREATE_WAY", at=(13.0, 47.0) if geom == "POINT" else None, **how))
            elif geom == "LINE" and r.random() < 0.5:
                if length > 2 and r.random() < 0.3:
                    length -= 1
                    rows.append(op("REMOVE_NODE", pos=r.randrange(length + 1), **how))
                else:
                    rows.append(op("ADD_NODE", pos=r.randrange(length + 1), ref=v, at=(13 + v / 100, 47 + oid / 100), **how))
                    length += 1
            elif r.random() < 0.25:
                rows.append(op("MODIFY_COORDINATE", at=(13 + v / 100, 47.0), **how) if geom == "POINT" else op("MODIFY_WAY_COORDINATE", ref=2, at=(14.0, 47.0), **how))
            else:
                key = r.choice(("building", "amenity", "highway", "name"))
                rows.append(op("REMOVE_TAG", key=key, **how) if r.random() < 0.3 else op("ADD_TAG", key=key, value=r.choice(("track", "yes")), **how))
    want = generate_actions(frame(spark, *rows), default_config())
    rows.sort(key=lambda x: x[6])
    last = rows[-1][6]
    for n in range(4):  # each file is a micro-batch; then two rows move the watermark on
        part = [x for i, x in enumerate(rows) if i * 4 // len(rows) == n]
        r.shuffle(part)
        frame(spark, *part).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    for n in (4, 5):
        frame(spark, op("ADD_TAG", 999, version=n, hours=(last - T0).total_seconds() / 3600 + 100 * n)).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    stream = spark.readStream.schema(OPERATIONS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):  # the second run goes on where the first ended: nothing comes twice
        q = action_stream(stream, default_config(), "2 days").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/kept").trigger(availableNow=True).start()
        assert q.awaitTermination(150) and q.exception() is None
    plain = lambda x: sorted(map(repr, x.select(*want.columns).collect()))
    assert plain(spark.read.parquet(f"{tmp_path}/out")) == plain(want) and want.count() > 60
