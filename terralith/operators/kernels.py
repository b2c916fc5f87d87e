"""Line and polygon kernels over arrays of points, as Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[int, int]
POINTS = "array<struct<lat:int,lon:int>>"


def simplified(points: list[Point], error: float) -> list[Point]:
    """Douglas-Peucker without recursion; distances in map units, longitudes scaled."""
    if len(points) < 3:
        return points
    keep, work = {0, len(points) - 1}, [(0, len(points) - 1)]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        ay, ax = points[a]
        scale = math.cos(math.radians(ay * 360 / (1 << 24)))
        dy, dx = points[b][0] - ay, (points[b][1] - ax) * scale
        size = math.hypot(dx, dy)
        far, at = error, None
        for i in range(a + 1, b):
            y, x = points[i]
            y, x = y - ay, (x - ax) * scale
            d = abs(dx * y - dy * x) / size if size else math.hypot(x, y)
            if d > far:
                far, at = d, i
        if at is not None:
            keep.add(at)
            work += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def without_obsolete(points: list[Point]) -> list[Point]:
    """Drops equal neighbours, points on a straight line and spikes."""
    out: list[Point] = []
    for p in points:
        if out and p == out[-1]:
            continue
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) == (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
            out.pop()
            if out[-1] == p:
                break
        if not out or out[-1] != p:
            out.append(p)
    return out


def clipped_segment(box: tuple[int, int, int, int], a: Point, b: Point) -> tuple[Point, Point] | None:
    """The part of a segment within (min_lat, min_lon, max_lat, max_lon), or None."""
    t0, t1 = 0.0, 1.0
    dy, dx = b[0] - a[0], b[1] - a[1]
    for step, room in ((-dx, a[1] - box[1]), (dx, box[3] - a[1]), (-dy, a[0] - box[0]), (dy, box[2] - a[0])):
        if step == 0:
            if room < 0:
                return None
        elif step < 0:
            t0 = max(t0, room / step)
        else:
            t1 = min(t1, room / step)
    if t0 > t1:
        return None
    at = lambda t: (int(a[0] + t * dy + 0.5), int(a[1] + t * dx + 0.5))
    return (a if t0 == 0 else at(t0)), (b if t1 == 1 else at(t1))


def clipped_line(box: tuple[int, int, int, int], points: list[Point]) -> list[list[Point]]:
    """The pieces of a line within a box."""
    out: list[list[Point]] = []
    for a, b in zip(points, points[1:]):
        if (part := clipped_segment(box, a, b)) is None:
            continue
        if out and out[-1][-1] == part[0] and part[0] == a:
            if part[1] != part[0]:
                out[-1].append(part[1])
        elif part[0] != part[1]:
            out.append([part[0], part[1]])
    return out


def clipped_ring(box: tuple[int, int, int, int], ring: list[Point]) -> list[Point]:
    """Sutherland-Hodgman against the four sides of a box; the ring is open."""
    sides = [(0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)]
    for axis, limit, sign in sides:
        inside = [(p[axis] - limit) * sign >= 0 for p in ring]
        if all(inside):
            continue
        out: list[Point] = []
        if any(inside):
            a, a_in = ring[-1], inside[-1]
            for b, b_in in zip(ring, inside):
                if a_in != b_in:
                    t = (limit - a[axis]) / (b[axis] - a[axis])
                    cut = [round(a[0] + t * (b[0] - a[0])), round(a[1] + t * (b[1] - a[1]))]
                    cut[axis] = limit
                    out.append((cut[0], cut[1]))
                if b_in:
                    out.append(b)
                a, a_in = b, b_in
        ring = out
    return ring


def joined_rings(ways: list[list[int]]) -> list[list[int]]:
    """Rings and open chains of node ids, by joining ways at equal ends, the first ways first."""
    rest, out = [list(w) for w in ways if len(w) > 1], []
    while rest:
        chain = rest.pop(0)
        grown = True
        while grown and chain[0] != chain[-1]:
            grown = False
            for i, w in enumerate(rest):
                if w[0] == chain[-1] or w[-1] == chain[-1]:
                    chain += (w if w[0] == chain[-1] else w[::-1])[1:]
                    rest.pop(i)
                    grown = True
                    break
        out.append(chain)
    return out


def contains(ring: list[Point], p: Point) -> bool:
    """Whether a point is in a ring, by crossings."""
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]):
        if (y1 > p[0]) != (y2 > p[0]) and p[1] < (x2 - x1) * (p[0] - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def lists_of_points(lines: pa.Array) -> list[list[Point] | None]:
    """The (lat, lon) lists of an Arrow array of lists of such structs; no object is made for a struct."""
    flat = lines.flatten()
    lat, lon = flat.field("lat").to_pylist(), flat.field("lon").to_pylist()
    pairs, out, at = list(zip(lat, lon)), [], 0
    for n in lines.value_lengths().to_pylist():
        out.append(None if n is None else pairs[at : at + n])
        at += n or 0
    return out


def points_of_lists(lines: list[list[Point] | None]) -> pa.Array:
    """The other way round."""
    offsets, at = [], 0
    for line in lines:
        offsets.append(None if line is None else at)
        at += len(line or ())
    y, x = ([int(p[i]) for line in lines if line is not None for p in line] for i in (0, 1))
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), pa.StructArray.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.int32())], ["lat", "lon"]))


def on_points(kernel: Callable[[list[Point]], list[Point]]) -> Callable[[Column], Column]:
    """A column function over arrays of (lat, lon) structs."""

    @F.arrow_udf(POINTS)
    def run(lines: pa.Array) -> pa.Array:
        return points_of_lists([None if line is None else kernel(line) for line in lists_of_points(lines)])

    return run
