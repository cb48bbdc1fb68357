"""Geometries that are the same, buffers with flat ends, and ids of hexagons."""

import math
import random

import numpy as np
import pytest

from editlens.functions import geo
from editlens.operators.change_detection import NEAR, geometry_change


def ways_to_write(ring, r):
    """The ring from another corner, the other way round, with nodes on its edges."""
    p = list(ring)
    out = []
    for a, b in zip(p, p[1:] + p[:1]):
        out.append(a)
        for t in sorted(r.sample([0.25, 0.5, 0.75], r.randrange(3))):
            out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    k = r.randrange(len(out))
    out = out[k:] + out[:k]
    out = out[::-1] if r.random() < 0.5 else out
    return [*out, out[0]]


def test_same_geometry():
    r = random.Random(5)
    for _ in range(300):
        corners = sorted(r.sample(range(360), r.randrange(3, 9)))
        ring = [(round(40 * math.cos(math.radians(t))) * 4, round(40 * math.sin(math.radians(t))) * 4) for t in corners]
        if len(set(ring)) < len(ring) or geo.area([*ring, ring[0]]) == 0:
            continue
        a, b = (np.array(ways_to_write(ring, r), float) for _ in range(2))
        assert geo.same_geometry("POLYGON", [a], "POLYGON", [b])
        assert geometry_change("building", ("POLYGON", [a]), ("POLYGON", [b])) is None
        other = b.copy()
        other[other == other.max()] += 4
        assert not geo.same_geometry("POLYGON", [a], "POLYGON", [other])
    line = np.array([(0, 0), (4, 0), (4, 4), (9, 4)], float)
    longer = np.array([(9, 4), (6, 4), (4, 4), (4, 4), (4, 1), (4, 0), (2, 0), (1, 0), (0, 0)], float)
    assert geo.same_geometry("LINESTRING", [line], "LINESTRING", [longer]) and not geo.same_geometry("LINESTRING", [line], "POLYGON", [line])
    back = np.array([(0, 0), (9, 0), (4, 0)], float)  # goes back on itself: its turn is no node on the way
    assert not geo.same_geometry("LINESTRING", [back], "LINESTRING", [np.array([(0, 0), (4, 0)], float)])
    holes = [np.array(x, float) for x in ([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)], [(5, 5), (6, 5), (6, 6), (5, 5)])]
    assert geo.same_geometry("POLYGON", holes, "POLYGON", [holes[0], holes[2], holes[1][::-1]])


def within_flat_buffer(p, line, radius, grown):
    """Whether a point is in the grown flat-ended buffer, from the distances to its rectangles and to its sectors by steps."""
    q = np.array(line, float)
    for a, b in zip(q, q[1:]):
        u = (b - a) / np.hypot(*(b - a))
        far, wide = (p - a) @ u, abs(u[0] * (p - a)[1] - u[1] * (p - a)[0])
        if math.hypot(max(0, -far, far - np.hypot(*(b - a))), max(0, wide - radius)) <= grown:
            return True
    for a, v, b in zip(q, q[1:], q[2:]):
        s, t = (v - a) / np.hypot(*(v - a)), (b - v) / np.hypot(*(b - v))
        angle = math.atan2(s[0] * t[1] - s[1] * t[0], s @ t)
        side = -1 if angle > 0 else 1  # the outer side
        start = math.atan2(side * s[0], -side * s[1])
        for k in range(201):
            edge = v + radius * np.array([math.cos(start + angle * k / 200), math.sin(start + angle * k / 200)])
            share = np.clip(((p - v) @ (edge - v)) / (radius * radius), 0, 1)
            if np.hypot(*(p - v - share * (edge - v))) <= grown + radius * abs(angle) / 390:
                return True
    return False


def test_flat_buffers_by_sampling():
    r = random.Random(6)
    seen = {True: 0, False: 0}
    for _ in range(120):
        other = [(r.randrange(-60, 60), r.randrange(-60, 60)) for _ in range(r.randrange(2, 5))]
        other = [p for i, p in enumerate(other) if not i or p != other[i - 1]]
        line = [(r.randrange(-80, 80), r.randrange(-80, 80)) for _ in range(r.randrange(2, 4))]
        if len(other) < 2:
            continue
        grown = r.choice([0.0, 1.0])
        out, met = geo.against_flat_buffer(line, other, NEAR, grown)
        inside_any = False
        for n, (a, b) in enumerate(zip(np.array(line, float), np.array(line[1:], float))):
            for t in np.linspace(0.003, 0.997, 60):
                stretches = [(x, y) for k, x, y in out if k == n]
                if any(abs(t - e) < 2e-3 for x in stretches for e in x):
                    continue  # at a border
                told = not any(x <= t <= y for x, y in stretches)
                assert told == within_flat_buffer(a + t * (b - a), other, NEAR, grown) or min(abs(t - e) for x in [*stretches, (0, 1)] for e in x) < 0.02
                seen[told] += 1
                inside_any |= told
        assert met or not inside_any
    assert min(seen.values()) > 500


@pytest.mark.parametrize("beyond, status", [(15, "StreetLengthened"), (1, "StreetWithinBuffer"), (2, "StreetLengthened")])
def test_streets_beyond_flat_ends(beyond, status):
    """A street that goes on past the ends by more than the growth isn't within the buffer of the other."""
    old, new = np.array([(0, 0), (10 * beyond, 0)], float), np.array([(-beyond, 3), (11 * beyond + (beyond == 2) * 20, 3)], float)
    found = geometry_change("street", ("LINESTRING", [old]), ("LINESTRING", [new]))
    assert found[0] == (status if beyond != 15 else "StreetWithinBuffer")
    if beyond == 15:  # the old one lies within the buffer of the new one, which is no fifth longer
        assert geo.against_flat_buffer(new, old, NEAR, 1.0)[0] and not geo.against_flat_buffer(old, new, NEAR, 1.0)[0]
    shifted = np.array([(15, 0), (10 * beyond + 15, 0)], float)
    crossing = geometry_change("street", ("LINESTRING", [old]), ("LINESTRING", [shifted]))
    assert crossing is None or crossing[0] in ("StreetCrossesBuffer", "StreetDisjoint")
    assert geometry_change("street", ("LINESTRING", [old]), ("LINESTRING", [old + [0, 21]])) is None
    assert geometry_change("street", ("LINESTRING", [old]), ("LINESTRING", [old + [0, 21.1]]))[0] == "StreetDisjoint"
    assert geometry_change("street", ("LINESTRING", [old]), ("LINESTRING", [old + [0, 20.5]]), round_ends=True)[0] == "StreetDisjoint"


def test_hexagon_ids_beyond_three_digits(spark):
    from editlens.operators.regions import hexagon_grid

    cells = hexagon_grid(spark, 0.0, 0.0, 16_000.0, 1100 * 4.33, 10.0).where("row < 2 or col < 2").select("id", "row", "col").collect()
    assert max(c.row for c in cells) > 1000 and max(c.col for c in cells) > 1000
    assert all(c.id == f"1{c.row:03d}{c.col:03d}" for c in cells) and len({c.id for c in cells if c.row < 1000}) == sum(c.row < 1000 for c in cells)
