"""Planar and ellipsoidal geometry without a geometry library: numpy for exact predicates, columns for formulas."""

from __future__ import annotations

import math
import re
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- WKT


def point_wkt(x: float, y: float) -> str:
    return f"POINT ({x:.7f} {y:.7f})"


def line_wkt(points) -> str:
    return "LINESTRING (" + ", ".join(f"{x:.7f} {y:.7f}" for x, y in points) + ")"


def polygon_wkt(rings) -> str:
    if rings and not isinstance(rings[0][0], (tuple, list, np.ndarray)):
        rings = [rings]
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x:.7f} {y:.7f}" for x, y in r) + ")" for r in rings) + ")"


def parse_wkt(text: str) -> tuple[str, list[np.ndarray]]:
    """(POINT, LINESTRING or POLYGON, list of rings or one list of points); ValueError otherwise."""
    m = re.fullmatch(r"\s*(POINT|LINESTRING|POLYGON)\s*\((.*)\)\s*", text or "", re.S | re.I)
    if not m:
        raise ValueError(f"not a point, line or polygon: {text!r}")
    kind, body = m[1].upper(), m[2]
    parts = re.findall(r"\(([^()]*)\)", body) if kind == "POLYGON" else [body]
    rings = [np.array([[float(v) for v in p.split()[:2]] for p in r.split(",")]) for r in parts]
    if not rings or any(r.ndim != 2 or r.shape[1] != 2 for r in rings) or kind == "POLYGON" and any(len(r) < 4 or (r[0] != r[-1]).any() for r in rings):
        raise ValueError(f"broken geometry: {text!r}")
    return kind, rings


# ---------------------------------------------------------------- predicates


def length(points) -> float:
    p = np.asarray(points, float)
    return float(np.hypot(*np.diff(p, axis=0).T).sum()) if len(p) > 1 else 0.0


def area(ring) -> float:
    p = np.asarray(ring, float)
    x, y = p[:, 0], p[:, 1]
    return float(abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2)


def to_segments(points, line) -> np.ndarray:
    """Distance of each point to a line."""
    p, q = np.atleast_2d(np.asarray(points, float)), np.asarray(line, float)
    if len(q) == 1:
        return np.hypot(*(q[0] - p).T)
    a, d = q[:-1], np.diff(q, axis=0)
    n = (d * d).sum(1)
    n[n == 0] = 1
    out = np.empty(len(p))
    for at in range(0, len(p), 256):
        away = p[at : at + 256, None] - a
        t = np.clip((away * d).sum(2) / n, 0, 1)
        away -= t[:, :, None] * d
        out[at : at + 256] = np.sqrt((away * away).sum(2).min(1))
    return out


def point_to_segments(point, points) -> float:
    return float(to_segments(point, points)[0])


def turns(a, b, c) -> np.ndarray:
    """1 where c lies left of the way from a to b, -1 where right, 0 where on one line with it, for rows of (x, y).

    Exact for coordinates as they are written down in decimals: what floating point can't tell for sure is told in whole numbers."""
    u, v = b - a, c - a
    det = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    most = np.maximum.reduce([np.abs(x).max(1) for x in (a, b, c)])
    unsure = np.abs(det) <= 2e-15 * most * (np.abs(u).sum(1) + np.abs(v).sum(1)) + 1e-30 * most * most
    out = np.sign(det).astype(np.int8)
    whole = most < 1 << 24
    for x in (a, b, c):
        whole &= (x == np.rint(x)).all(1)
    same = (u == 0).all(1) | (v == 0).all(1) | (b == c).all(1)
    out[same] = 0
    for i in np.flatnonzero(unsure & ~whole & ~same):
        (ax, ay), (bx, by), (cx, cy) = ([Fraction(repr(t)) for t in x[i].tolist()] for x in (a, b, c))
        exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        out[i] = (exact > 0) - (exact < 0)
    return out


#: Products of points from which on numpy is worth its calls; below, plain numbers take the same steps.
FEW = 64


def _turn(ax, ay, bx, by, cx, cy) -> int:
    """``turns`` of one triple."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - ax, cy - ay
    if ux == 0 == uy or vx == 0 == vy or bx == cx and by == cy:
        return 0
    det = ux * vy - uy * vx
    every = (ax, ay, bx, by, cx, cy)
    most = max(map(abs, every))
    if abs(det) <= 2e-15 * most * (abs(ux) + abs(uy) + abs(vx) + abs(vy)) + 1e-30 * most * most and not (most < 1 << 24 and all(map(float.is_integer, every))):
        ax, ay, bx, by, cx, cy = (Fraction(repr(t)) for t in every)
        det = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (det > 0) - (det < 0)


def _few_cross(a: list, b: list) -> bool:
    """``segments_cross`` of lists of points."""
    for (px, py), (qx, qy) in zip(a, a[1:]):
        for (rx, ry), (sx, sy) in zip(b, b[1:]):
            if min(px, qx) > max(rx, sx) or max(px, qx) < min(rx, sx) or min(py, qy) > max(ry, sy) or max(py, qy) < min(ry, sy):
                continue
            if _turn(px, py, qx, qy, rx, ry) * _turn(px, py, qx, qy, sx, sy) <= 0 and _turn(rx, ry, sx, sy, px, py) * _turn(rx, ry, sx, sy, qx, qy) <= 0:
                return True
    return False


def nearest(points, line) -> float:
    """The least distance of some points to a line."""
    if len(line) == 1 or len(points) * len(line) > FEW:
        return float(to_segments(points, line).min())
    best, q = math.inf, np.asarray(line, float).tolist()
    for x, y in np.asarray(points, float).tolist():
        for (ax, ay), (bx, by) in zip(q, q[1:]):
            dx, dy = bx - ax, by - ay
            ox, oy = x - ax, y - ay
            t = min(max((ox * dx + oy * dy) / (dx * dx + dy * dy or 1.0), 0.0), 1.0)
            ox, oy = ox - t * dx, oy - t * dy
            best = min(best, ox * ox + oy * oy)
    return math.sqrt(best)


def inside(point, rings) -> bool:
    """Whether a polygon (outer ring and holes) holds a point; its border counts."""
    p = np.asarray(point, float)
    odd = False
    for ring in rings:
        r = np.asarray(ring, float)
        a, b = r[:-1], r[1:]
        beside = (np.minimum(a, b)[:, 1] <= p[1]) & (p[1] <= np.maximum(a, b)[:, 1])  # of edges on the point's height
        a, b = a[beside], b[beside]
        side = turns(a, b, np.broadcast_to(p, a.shape))
        if ((side == 0) & (np.minimum(a, b)[:, 0] <= p[0]) & (p[0] <= np.maximum(a, b)[:, 0])).any():
            return True
        up = b[:, 1] > p[1]
        odd ^= bool((((a[:, 1] > p[1]) != up) & (side == np.where(up, 1, -1))).sum() % 2)
    return odd


def segments_cross(a, b) -> bool:
    """Whether two lines share a point."""
    a, b = (x if len(x) > 1 else np.repeat(x, 2, 0) for x in (np.asarray(a, float), np.asarray(b, float)))
    if len(a) * len(b) <= FEW:
        return _few_cross(a.tolist(), b.tolist())
    low, high = np.minimum(b[:-1], b[1:]), np.maximum(b[:-1], b[1:])
    for at in range(0, len(a) - 1, 256):
        p, q = a[at : at + 257][:-1], a[at : at + 257][1:]
        i, j = np.nonzero(((np.minimum(p, q)[:, None] <= high) & (np.maximum(p, q)[:, None] >= low)).all(2))
        p, q, r, s = p[i], q[i], b[j], b[j + 1]
        if ((turns(p, q, r) * turns(p, q, s) <= 0) & (turns(r, s, p) * turns(r, s, q) <= 0)).any():
            return True
    return False


def intersects(kind_a: str, a, kind_b: str, b) -> bool:
    """Whether two geometries share a point."""
    outer = lambda g: np.asarray(g[0], float)
    if kind_a == "POINT" and kind_b == "POINT":
        return bool((outer(a)[0] == outer(b)[0]).all())
    if kind_a == "POLYGON" and any(inside(p, a) for p in outer(b)[:1]) or kind_b == "POLYGON" and any(inside(p, b) for p in outer(a)[:1]):
        return True
    return any(segments_cross(x, y) for x in a for y in b)


def distance(kind_a: str, a, kind_b: str, b) -> float:
    if intersects(kind_a, a, kind_b, b):
        return 0.0
    return min(min(nearest(x, y), nearest(y, x)) for x in a for y in b)


def _between(start, slope, least, most) -> tuple[np.ndarray, np.ndarray]:
    """Where ``least <= start + t * slope <= most``: from t to t (from inf to -inf where nowhere)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (least - start) / slope, (most - start) / slope
    flat = slope == 0
    held = (start >= least) & (start <= most)
    return np.where(flat, np.where(held, -np.inf, np.inf), np.minimum(a, b)), np.where(flat, np.where(held, np.inf, -np.inf), np.maximum(a, b))


def outside_buffer(line, other, radius: float) -> list[tuple[int, float, float]]:
    """The stretches of a line that are more than ``radius`` from another one: (segment, from and to as shares of it).

    What lies within ``radius`` of one segment is convex, two discs and a rectangle, so a segment of the line has one stretch there;
    what the stretches of all segments don't cover is outside."""
    p, q = np.asarray(line, float), np.asarray(other, float)
    a, d = (q[:-1], np.diff(q, axis=0)) if len(q) > 1 else (q, np.zeros((1, 2)))
    size = np.hypot(*d.T)
    along = np.where(size[:, None] > 0, d / np.where(size > 0, size, 1)[:, None], [1.0, 0.0])
    across = np.stack([-along[:, 1], along[:, 0]], 1)
    out = []
    for n, (x, u) in enumerate(zip(p, np.diff(p, axis=0))):
        square = float(u @ u)
        if square == 0:
            out += [(n, 0.0, 1.0)] if to_segments(x, q)[0] > radius else []
            continue
        away = x - q
        half, rest = away @ u, (away * away).sum(1) - radius * radius
        root = half * half - square * rest
        reach = np.sqrt(np.maximum(root, 0))
        lo, hi = np.where(root >= 0, (-half - reach) / square, np.inf), np.where(root >= 0, (-half + reach) / square, -np.inf)
        if len(q) > 1:
            lo, hi = np.minimum(lo[:-1], lo[1:]), np.maximum(hi[:-1], hi[1:])
            from_a = x - a
            l1, h1 = _between((from_a * along).sum(1), along @ u, 0.0, size)
            l2, h2 = _between((from_a * across).sum(1), across @ u, -radius, radius)
            l3, h3 = np.maximum(l1, l2), np.minimum(h1, h2)
            some = l3 <= h3
            lo, hi = np.where(some, np.minimum(lo, l3), lo), np.where(some, np.maximum(hi, h3), hi)
        covered = 0.0
        for k in np.argsort(lo):
            if lo[k] >= 1 or hi[k] <= covered:
                continue
            if lo[k] > covered + 1e-9:
                out.append((n, covered, float(lo[k])))
            covered = float(hi[k])
        if covered < 1 - 1e-9:
            out.append((n, covered, 1.0))
    return out


def within_buffer(line, other, radius: float) -> bool:
    """Whether all of a line is at most ``radius`` from another one."""
    return not (to_segments(line, other) > radius).any() and not outside_buffer(line, other, radius)


def _disc(x, u, centres, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Where x + t * u lies within ``radius`` of each centre."""
    square = (u * u).sum(-1)
    away = x - centres
    half, rest = (away * u).sum(-1), (away * away).sum(-1) - radius * radius
    root = half * half - square * rest
    reach = np.sqrt(np.maximum(root, 0))
    return np.where(root >= 0, (-half - reach) / square, np.inf), np.where(root >= 0, (-half + reach) / square, -np.inf)


def _flat_stretches(x, u, q, radius: float, grown: float) -> tuple[np.ndarray, np.ndarray]:
    """From where to where each x + t * u lies in each convex part of the grown buffer of q with flat ends."""
    d = np.diff(q, axis=0)
    size = np.hypot(*d.T)
    along = d / size[:, None]
    across = np.stack([-along[:, 1], along[:, 0]], 1)
    dot = lambda v, w: (v * w).sum(-1)
    far, wide, ahead, aside = dot(x - q[:-1], along), dot(x - q[:-1], across), dot(u, along), dot(u, across)
    parts = []
    for e, f in ((grown, 0.0), (0.0, grown)) if grown else ((0.0, 0.0),):
        (l1, h1), (l2, h2) = _between(far, ahead, -e, size + e), _between(wide, aside, -radius - f, radius + f)
        parts.append((np.maximum(l1, l2), np.minimum(h1, h2)))
    if grown:
        parts += [_disc(x, u, q[:-1] + s * d + t * radius * across, grown) for s in (0, 1) for t in (-1, 1)]
    lo = np.minimum.reduce([np.where(a <= b, a, np.inf) for a, b in parts])
    hi = np.maximum.reduce([np.where(a <= b, b, -np.inf) for a, b in parts])
    if len(d) > 1:  # sectors: beyond the end of one segment, before the start of the next
        v = q[1:-1]
        a, b = _disc(x, u, v, radius + grown)
        for side, sign in ((along[:-1], 1.0), (along[1:], -1.0)):
            l, h = _between(sign * dot(x - v, side), sign * dot(u, side), 0.0, np.inf)
            a, b = np.maximum(a, l), np.minimum(b, h)
        lo, hi = np.concatenate((lo, np.where(a <= b, a, np.inf)), 1), np.concatenate((hi, np.where(a <= b, b, -np.inf)), 1)
    return lo, hi


def _few_between(start: float, slope: float, least: float, most: float) -> tuple[float, float]:
    if slope == 0:
        return (-math.inf, math.inf) if least <= start <= most else (math.inf, -math.inf)
    a, b = (least - start) / slope, (most - start) / slope
    return (a, b) if a <= b else (b, a)


def _few_stretches(x: list, u: list, q: list, radius: float, grown: float) -> list[tuple[float, float]]:
    """``_flat_stretches`` of one segment of a line, those that there are."""
    (x0, x1), (u0, u1), out, ways = x, u, [], []
    square = u0 * u0 + u1 * u1

    def disc(c0, c1, r):
        w0, w1 = x0 - c0, x1 - c1
        half = w0 * u0 + w1 * u1
        root = half * half - square * (w0 * w0 + w1 * w1 - r * r)
        if root < 0:
            return math.inf, -math.inf
        reach = math.sqrt(root)
        return (-half - reach) / square, (-half + reach) / square

    for (q0, q1), (r0, r1) in zip(q, q[1:]):
        d0, d1 = r0 - q0, r1 - q1
        size = float(np.hypot(d0, d1))
        a0, a1 = d0 / size, d1 / size
        ways.append((a0, a1))
        w0, w1 = x0 - q0, x1 - q1
        far, wide, ahead, aside = w0 * a0 + w1 * a1, w0 * -a1 + w1 * a0, u0 * a0 + u1 * a1, u0 * -a1 + u1 * a0
        parts = []
        for e, f in ((grown, 0.0), (0.0, grown)) if grown else ((0.0, 0.0),):
            (l1, h1), (l2, h2) = _few_between(far, ahead, -e, size + e), _few_between(wide, aside, -radius - f, radius + f)
            parts.append((max(l1, l2), min(h1, h2)))
        if grown:
            parts += [disc(q0 + s * d0 + t * radius * -a1, q1 + s * d1 + t * radius * a0, grown) for s in (0, 1) for t in (-1, 1)]
        parts = [(a, b) for a, b in parts if a <= b]
        if parts:
            out.append((min(a for a, _ in parts), max(b for _, b in parts)))
    for (v0, v1), (a0, a1), (b0, b1) in zip(q[1:-1], ways, ways[1:]):
        a, b = disc(v0, v1, radius + grown)
        for s0, s1, sign in ((a0, a1, 1.0), (b0, b1, -1.0)):
            l, h = _few_between(sign * ((x0 - v0) * s0 + (x1 - v1) * s1), sign * (u0 * s0 + u1 * s1), 0.0, math.inf)
            a, b = max(a, l), min(b, h)
        if a <= b:
            out.append((a, b))
    return out


def _outside(n: int, stretches) -> list[tuple[int, float, float]]:
    """What stretches in order of their starts leave of segment n."""
    out, covered = [], 0.0
    for a, b in stretches:
        if a >= 1:
            break
        if b <= covered:
            continue
        if a > covered + 1e-9:
            out.append((n, covered, a))
        covered = b
    return out + [(n, covered, 1.0)] if covered < 1 - 1e-9 else out


def against_flat_buffer(line, other, radius: float, grown: float = 0.0) -> tuple[list[tuple[int, float, float]], bool]:
    """A line against the buffer of another one with flat ends and round joins, which is then grown on all sides: the stretches
    outside as (segment, from and to as shares of it), and whether any point of the line is within or on the border.

    The buffer is made of a rectangle for each segment and, where two meet, of the sector between their ends. Grown, a rectangle is
    two crossing rectangles and four discs, whose union is convex, and a sector is one of a larger radius (its straight sides
    lie within the grown rectangles); so each has one stretch of a segment of the line."""
    p, q = np.asarray(line, float), np.asarray(other, float)
    q = q[np.concatenate(([True], (np.diff(q, axis=0) != 0).any(1)))]
    if len(q) < 2:
        return [(n, 0.0, 1.0) for n in range(len(p) - 1)], False
    out, met = [], False
    if len(p) * len(q) <= FEW:
        p, q = p.tolist(), q.tolist()
        for n, (x, y) in enumerate(zip(p, p[1:])):
            u = [y[0] - x[0], y[1] - x[1]]
            held = _few_stretches(x, u if any(u) else [1e-9, 0.0], q, radius, grown)
            met = met or any(a <= 1 and b >= 0 for a, b in held)
            out += _outside(n, sorted(held))
        return out, met
    for first in range(0, len(p) - 1, 256):
        x, u = p[first : first + 257][:-1, None], np.diff(p[first : first + 257], axis=0)[:, None]
        u = np.where((u == 0).all(2, keepdims=True), [1e-9, 0.0], u)  # one point
        lo, hi = _flat_stretches(x, u, q, radius, grown)
        met = met or bool(((lo <= hi) & (lo <= 1) & (hi >= 0)).any())
        order = np.argsort(lo, 1)
        for n, (los, his) in enumerate(zip(np.take_along_axis(lo, order, 1).tolist(), np.take_along_axis(hi, order, 1).tolist()), first):
            out += _outside(n, zip(los, his))
    return out, met


def _needed(p: np.ndarray, ring: bool, near: float) -> np.ndarray:
    """Corners without those that repeat the one before or lie on the way from it to the next. A ring isn't closed here."""
    while True:
        before, behind = np.roll(p, 1, 0), np.roll(p, -1, 0)
        keep = (p != before).any(1)
        if not ring:
            keep[0] = True
        if keep.all():
            chord, part = behind - before, p - before
            size = (chord * chord).sum(1)
            share = (part * chord).sum(1)
            off = np.abs(chord[:, 0] * part[:, 1] - chord[:, 1] * part[:, 0])
            keep = ~((off <= near * np.sqrt(size)) & (share > 0) & (share < size))
            if not ring:
                keep[0] = keep[-1] = True
            drop = np.flatnonzero(~keep)
            keep[drop[1:][np.diff(drop) == 1]] = True  # neighbours one after the other
        if keep.all() or len(p) <= 2:
            return p
        p = p[keep]


def normal_form(kind: str, rings, near: float = 1e-6) -> list[np.ndarray]:
    """The same for all ways to write a geometry down: rings from their smallest corner on, counter-clockwise, lines from their
    smaller end, holes in order, without repeated corners and those that lie on an edge (but for ``near``)."""
    out = []
    for r in rings:
        p = np.asarray(r, float)
        closed = len(p) > 2 and bool((p[0] == p[-1]).all())
        if kind == "POINT" or len(p) < 2:
            out.append(p)
        elif kind == "POLYGON" or closed:
            p = _needed(p[:-1] if closed else p, True, near)
            x, y = p.T
            if kind == "POLYGON" and (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0:
                p = p[::-1]
            p = np.roll(p, -np.lexsort((p[:, 1], p[:, 0]))[0], 0)
            if kind != "POLYGON" and len(p) > 2 and tuple(p[-1]) < tuple(p[1]):
                p = np.roll(p[::-1], 1, 0)
            out.append(p)
        else:
            p = _needed(p, False, near)
            out.append(p[::-1] if tuple(p[-1]) < tuple(p[0]) else p)
    return out[:1] + sorted(out[1:], key=lambda p: p.tolist())


def same_geometry(kind_a: str, a, kind_b: str, b, near: float = 1e-6) -> bool:
    """Whether two geometries are made of the same points, however they are written down."""
    if kind_a != kind_b or len(a) != len(b) or any(np.abs(f(a[0]) - f(b[0])).max() > near for f in (lambda r: r.min(0), lambda r: r.max(0))):
        return False
    return all(x.shape == y.shape and np.allclose(x, y, rtol=0, atol=near) for x, y in zip(normal_form(kind_a, a, near), normal_form(kind_b, b, near)))


def pieces_wkt(line, stretches: list[tuple[int, float, float]]) -> str | None:
    """Stretches of a line's segments as lines; those that go on from one segment to the next are one."""
    p, lines, last = np.asarray(line, float), [], None
    for n, a, b in stretches:
        start, end = (tuple(p[n] + t * (p[n + 1] - p[n])) for t in (a, b))
        if last == n - 1 and a == 0:
            lines[-1].append(end)
        else:
            lines.append([start, end])
        last = n if b == 1 else None
    texts = [line_wkt(x)[len("LINESTRING ") :] for x in lines]
    return None if not texts else f"LINESTRING {texts[0]}" if len(texts) == 1 else f"MULTILINESTRING ({', '.join(texts)})"


# ---------------------------------------------------------------- projections

#: Semi-major axis and inverse flattening of the ellipsoids.
WGS84 = (6378137.0, 298.257223563)
BESSEL = (6377397.155, 299.1528128)
#: Shift from MGI to WGS 84 (metres, arc seconds, parts per million), position vector.
MGI_SHIFT = (577.326, 90.129, 463.919, 5.137, 1.474, 5.297, 2.4232)


def transverse_mercator(lon, lat, lon0, scale, east, north, ellipsoid):
    """Eastings and northings by the usual series."""
    a, inverse = ellipsoid
    f = 1 / inverse
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    phi, lam = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float) - lon0)
    n = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    t, c, x = np.tan(phi) ** 2, ep * np.cos(phi) ** 2, lam * np.cos(phi)
    series = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024), 15 * e2**2 / 256 + 45 * e2**3 / 1024, -35 * e2**3 / 3072)
    arc = a * (series[0] * phi + series[1] * np.sin(2 * phi) + series[2] * np.sin(4 * phi) + series[3] * np.sin(6 * phi))
    e = n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep) * x**5 / 120)
    v = arc + n * np.tan(phi) * (x**2 / 2 + (5 - t + 9 * c + 4 * c**2) * x**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep) * x**6 / 720)
    return east + scale * e, north + scale * v


def utm33(lon, lat):
    """EPSG:4326 to EPSG:32633."""
    return transverse_mercator(lon, lat, 15.0, 0.9996, 500000.0, 0.0, WGS84)


def to_mgi(lon, lat):
    """WGS 84 to MGI geographic coordinates through geocentric ones (heights of zero)."""
    tx, ty, tz, rx, ry, rz, ppm = MGI_SHIFT
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    k = 1 + ppm * 1e-6
    a, inverse = WGS84
    e2 = (2 - 1 / inverse) / inverse
    phi, lam = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    n = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    x, y, z = n * np.cos(phi) * np.cos(lam), n * np.cos(phi) * np.sin(lam), n * (1 - e2) * np.sin(phi)
    x, y, z = (x - tx) / k, (y - ty) / k, (z - tz) / k
    u, v, w = x + rz * y - ry * z, -rz * x + y + rx * z, ry * x - rx * y + z
    a, inverse = BESSEL
    e2 = (2 - 1 / inverse) / inverse
    p, b = np.hypot(u, v), a * math.sqrt(1 - e2)
    theta = np.arctan2(w * a, p * b)
    return np.degrees(np.arctan2(v, u)), np.degrees(np.arctan2(w + e2 / (1 - e2) * b * np.sin(theta) ** 3, p - e2 * a * np.cos(theta) ** 3))


def gk_central(lon, lat):
    """EPSG:4326 to EPSG:31258 (metres)."""
    return transverse_mercator(*to_mgi(lon, lat), 13.0 + 20.0 / 60.0, 1.0, 450000.0, -5000000.0, BESSEL)


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def _gk_central(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip("xy", gk_central(lon.to_numpy(float), lat.to_numpy(float)))))


def austria_gk_central(lon, lat) -> Column:
    """A struct of x and y; in numpy, as one expression of this depth would be planned for longer than it runs."""
    return _gk_central(lon, lat)


def andoyer(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Ellipsoidal distance in metres by Andoyer's formula; equal points are 0, antipodes null."""
    a, b = 6378137.0, 6356752.314
    f = (a - b) / a
    half_sum, half_lat, half_lon = F.radians((lat1 + lat2) / 2), F.radians((lat1 - lat2) / 2), F.radians((lon1 - lon2) / 2)
    sq = lambda c: c * c
    s = sq(F.sin(half_lat)) * sq(F.cos(half_lon)) + sq(F.cos(half_sum)) * sq(F.sin(half_lon))
    c = sq(F.cos(half_lat)) * sq(F.cos(half_lon)) + sq(F.sin(half_sum)) * sq(F.sin(half_lon))
    w = F.atan(F.sqrt(s / c))
    r = F.sqrt(s * c) / w
    out = 2 * w * a * (1 + f * ((3 * r - 1) / (2 * c)) * sq(F.sin(half_sum)) * sq(F.cos(half_lat)) - f * ((3 * r + 1) / (2 * s)) * sq(F.cos(half_sum)) * sq(F.sin(half_lat)))
    return F.when((lon1 == lon2) & (lat1 == lat2), F.lit(0.0)).otherwise(F.nanvl(out, F.lit(None).cast("double")))


def andoyer_length(points: Column) -> Column:
    """Length in metres of an array of structs (x, y)."""
    step = lambda i: andoyer(points[i]["x"], points[i]["y"], points[i + 1]["x"], points[i + 1]["y"])
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(points) - 2, F.lit(0))), F.lit(0.0), lambda t, i: t + step(i)))


def coordinate_code(c: Column) -> Column:
    """A coordinate as the whole number of 1e-7 degrees that it is stored as."""
    return F.floor(c * 1e7 + 0.5).cast("long")


def coordinate_value(code: Column) -> Column:
    return code / F.lit(1e7)


def number_text(c: Column) -> Column:
    """At least one and at most six decimals, as 3.0 or 0.25; halves go to the even neighbour."""
    text = F.regexp_replace(F.bround(c.cast("decimal(38,12)"), 6).cast("decimal(38,6)").cast("string"), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def clean_text(c: Column) -> Column:
    """Semicolons as commas and line breaks as blanks, for lines of fields."""
    return F.translate(c, ";\n\r", ",  ")


# ---------------------------------------------------------------- spatial keys


def quad_path(xmin: Column, ymin: Column, xmax: Column, ymax: Column, levels: int = 10) -> Column:
    """Path of the deepest quadrant (of the world, at most ``levels`` down) that strictly holds a box, as /NW/SE."""
    start = F.struct(F.lit("").alias("path"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(True).alias("go"))

    def down(at, level):
        w, h = F.lit(180.0) / F.pow(F.lit(2.0), level), F.lit(90.0) / F.pow(F.lit(2.0), level)
        west, east = (xmin > at["x"] - w) & (xmax < at["x"]), (xmin > at["x"]) & (xmax < at["x"] + w)
        south, north = (ymin > at["y"] - h) & (ymax < at["y"]), (ymin > at["y"]) & (ymax < at["y"] + h)
        go = at["go"] & (west | east) & (south | north)
        name = F.concat(F.lit("/"), F.when(north, "N").otherwise("S"), F.when(west, "W").otherwise("E"))
        x = F.when(west, at["x"] - w / 2).otherwise(at["x"] + w / 2)
        y = F.when(south, at["y"] - h / 2).otherwise(at["y"] + h / 2)
        return F.struct(F.when(go, F.concat(at["path"], name)).otherwise(at["path"]).alias("path"), F.when(go, x).otherwise(at["x"]).alias("x"), F.when(go, y).otherwise(at["y"]).alias("y"), go.alias("go"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, down, lambda s: s["path"])


def quad_box(path: str) -> tuple[float, float, float, float]:
    """(xmin, ymin, xmax, ymax) of a quadrant."""
    x, y, w, h = 0.0, 0.0, 180.0, 90.0
    for step in filter(None, path.split("/")):
        w, h = w / 2, h / 2
        x += w if step[1] == "E" else -w
        y += h if step[0] == "N" else -h
    return x - w, y - h, x + w, y + h
