"""Comparisons of small geometries in plain numbers, and those that a task keeps."""

import numpy as np

from editlens.functions import geo
from editlens.operators import change_detection as changes


def test_few_points_are_compared_as_many(monkeypatch):
    rng = np.random.default_rng(5)
    for i in range(300):
        step = (1, 10, 0.01)[i % 3]
        p, q = (np.round(rng.uniform(0, 60, (rng.integers(2, 6), 2)) / step) * step for _ in range(2))
        found = []
        for few in (64, 0):
            monkeypatch.setattr(geo, "FEW", few)
            found.append((geo.segments_cross(p, q), geo.distance("LINESTRING", [p], "LINESTRING", [q]), geo.against_flat_buffer(p, q, 20.0, 1.0), geo.against_flat_buffer(p, q, 20.0)))
        assert found[0] == found[1]


def test_shapes_that_come_again_are_compared_once(monkeypatch):
    calls, plain = [], changes.geometry_change
    monkeypatch.setattr(changes, "geometry_change", lambda *a: calls.append(a) or plain(*a))
    op = {"operation_type": "OP_MODIFY_WAY_COORDINATE", "version": 1, "changeset": 1, "us": 0, "key": "", "value": ""}
    wkts = ["LINESTRING (0 0, 100 0)", "LINESTRING (0 42, 100 42)"]
    actions = [{"operations": [op], "action_type": "UPDATE", "geom_wkt": wkts[i // 2 % 2]} for i in range(40)]
    found = list(changes.action_changes("street", actions, changes.planar))
    assert len(found) == 19 and {c[1] for c in found} == {"StreetDisjoint"} and len(calls) == 2
