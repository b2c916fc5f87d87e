"""Segments met in groups, against plain loops over all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

from terralith.operators import places, spatial, sweep


def lines(rng, n, wide, short=False):
    """Rows of (road, pos, lat, lon, to_lat, to_lon): long, short, level, upright and empty ones, some of them twice."""
    out = []
    for i in range(n):
        y, x = rng.randrange(-wide, wide), rng.randrange(-wide, wide)
        reach = wide // 20 if short or i % 3 == 0 else wide
        y2, x2 = y + rng.randrange(-reach, reach), x + rng.randrange(-reach, reach)
        out.append((i, i % 4, y, x, y if i % 11 == 0 else y2, x if i % 13 == 0 else x2))
        if i % 17 == 0:
            out.append((i + 10_000, 0, *out[-1][2:]))
    return out


def squared_distance(y, x, y1, x1, y2, x2):
    size = (y2 - y1) ** 2 + (x2 - x1) ** 2
    share = max(0.0, min(1.0, ((y - y1) * (y2 - y1) + (x - x1) * (x2 - x1)) / size)) if size else 0.0
    dy, dx = y - (y1 + share * (y2 - y1)), x - (x1 + share * (x2 - x1))
    return dy * dy + dx * dx


@pytest.mark.parametrize("per_group", [200_000, 40])
def test_nearest_segment(spark, monkeypatch, per_group):
    monkeypatch.setattr(sweep, "PER_GROUP", per_group)
    monkeypatch.setattr(sweep, "PARTS", 3)
    rng = random.Random(per_group)
    segs = [(*s, rng.choice(["a", "b", None])) for s in lines(rng, 150, 5_000)]
    # Two heaps of points, one of them in a single place, and some alone.
    spots = [(rng.randrange(-5_000, 5_000), rng.randrange(-5_000, 5_000)) for _ in range(200)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(150)] + [(77, 77)] * 120 + [(900_000, 5)]
    points = [(i, y, x, rng.choice(["a", "b", "c", None])) for i, (y, x) in enumerate(spots)] + [(9_999, None, 3, "a")]
    p = spark.createDataFrame(points, "id long, lat int, lon int, name string")
    s = spark.createDataFrame([*segs, (1, 1, None, 1, 1, 1, "a")], "road long, pos int, lat int, lon int, to_lat int, to_lon int, name string")
    for named in (False, True):
        got = {r.id: (r.d2, r.road, r.pos) for r in spatial.nearest_segment(p, s, 700, named=named).collect()}
        want = {}
        for i, y, x, name in points[:-1]:
            near = [(squared_distance(y, x, *q[2:6]), q[0], q[1]) for q in segs if not named or (name is not None and q[6] == name)]
            near = [c for c in near if c[0] <= 700 * 700]
            if near:
                want[i] = min(near)
        assert want and got == want


def test_nearest_rows_on_many_points():
    rng = np.random.default_rng(5)
    y, x = rng.integers(0, 20_000, 3_000).astype(float), rng.integers(0, 300, 3_000).astype(float)
    y1, x1, y2, x2 = (rng.integers(-2_000, 22_000, 900).astype(float) for _ in range(4))
    found, d2, _ = sweep.nearest_rows(y, x, y1, x1, y2, x2, 1_000)
    size = (y2 - y1) ** 2 + (x2 - x1) ** 2
    share = np.clip(((y[:, None] - y1) * (y2 - y1) + (x[:, None] - x1) * (x2 - x1)) / size, 0, 1)
    dy, dx = y[:, None] - (y1 + share * (y2 - y1)), x[:, None] - (x1 + share * (x2 - x1))
    every = dy * dy + dx * dx
    least = every.min(axis=1)
    assert np.array_equal(found >= 0, least <= 1_000_000) and np.array_equal(d2[found >= 0], least[found >= 0])


def plain_crossings(segs, edges, snap):
    out = set()
    for road, pos, ya, xa, yb, xb in segs:
        for border, b_pos, yc, xc, yd, xd in edges:
            by = (yb - ya) * (xd - xc) - (yd - yc) * (xb - xa)
            if not by:
                continue
            h = Fraction((yd - yc) * (xa - xd) - (ya - yd) * (xd - xc), by)
            g = Fraction((yb - ya) * (xa - xc) - (ya - yc) * (xb - xa), by)
            if not (0 <= h <= 1 and 0 <= g <= 1):
                continue
            share = ((yd - yc) * (xa - xd) - (ya - yd) * (xd - xc)) / by
            y, x = int(np.floor(ya + share * (yb - ya) + 0.5)), int(np.floor(xa + share * (xb - xa) + 0.5))
            d1, d2 = (y - ya) ** 2 + (x - xa) ** 2, (y - yb) ** 2 + (x - xb) ** 2
            out.add((road, pos, border, b_pos, y, x, "start" if d1 <= d2 and d1 <= snap * snap else "end" if d2 <= snap * snap else "between"))
    return out


@pytest.mark.parametrize("per_group, wide", [(200_000, 3_000), (30, 3_000), (200_000, 900_000_000)])
def test_crossings(spark, monkeypatch, per_group, wide):
    monkeypatch.setattr(sweep, "PER_GROUP", per_group)
    monkeypatch.setattr(sweep, "PARTS", 3)
    rng = random.Random(wide)
    segs, edges = lines(rng, 120, wide), lines(rng, 60, wide, short=True) + lines(rng, 30, wide)
    edges += [(500 + i, 9, *s[2:4], s[2] + 1, s[3] + wide // 9) for i, s in enumerate(segs[:20])]
    # A row that stands there twice counts once.
    a = spark.createDataFrame(segs + segs[:5], "road long, pos int, lat int, lon int, to_lat int, to_lon int")
    b = spark.createDataFrame(edges + edges[:5], "border long, pos int, lat int, lon int, to_lat int, to_lon int")
    snap = wide // 30
    want = plain_crossings(segs, edges, snap)
    got = [tuple(r) for r in spatial.crossings(a, b, snap).collect()]
    assert {w[6] for w in want} == {"start", "end", "between"}
    assert sorted(set(got)) == sorted(want)
    counts = {(r.border, r.at): r.n for r in spatial.crossing_counts(a, b, snap).collect()}
    tally: dict = {}
    for r in got:
        tally[r[2], r[6]] = tally.get((r[2], r[6]), 0) + 1
    assert counts == tally


def test_cost_of_nearest_follows_the_columns(monkeypatch):
    """Few of all pairs of a point and a segment are looked at, though every distance is within ``most``."""
    seen = []
    pairs = sweep._Columns.pairs
    monkeypatch.setattr(sweep._Columns, "pairs", lambda self, *a: (seen.append(len(s)) or (s, p) for s, p in pairs(self, *a)))
    rng = np.random.default_rng(1)
    y, x, y1, x1, y2, x2 = (rng.integers(0, 1_000_000, n).astype(float) for n in (4_000, 4_000, 5_000, 5_000, 5_000, 5_000))
    sweep.nearest_rows(y, x, y1, x1, y2, x2, 2_000_000)
    assert sum(seen) < 4_000 * 5_000 / 20


def test_matched_houses_by_name(spark):
    s = spark.createDataFrame([(1, "x", 0, 0, 0, 0, 100), (2, "y", 0, 5, 0, 5, 100)], "road long, name string, pos int, lat int, lon int, to_lat int, to_lon int")
    h = spark.createDataFrame([(1, 7, "y", 1, 50), (2, 8, None, 1, 50), (3, 9, "z", 4, 50)], "id long, number int, street string, lat int, lon int")
    assert {r.id: r.road for r in places.matched_houses(h, s, 40).collect()} == {1: 2, 2: 1, 3: 2}
