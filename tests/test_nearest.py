"""Nearest places against all pairs, on heaps and in the open."""

import random

from terralith.operators import spatial


def spots(rng, n):
    """Half of them in a heap 60 wide, some in one spot, the rest far apart."""
    return [(rng.randrange(60), rng.randrange(60)) if i % 2 else (7, 7) if i % 6 == 0 else (rng.randrange(-(10**6), 10**6), rng.randrange(-(10**6), 10**6)) for i in range(n)]


def least(y, x, others):
    return min(((y - v) ** 2 + (x - u) ** 2, o) for o, v, u in others)


def test_nearest_on_heaps(spark):
    rng = random.Random(4)
    others = [(i, *s) for i, s in enumerate(spots(rng, 300))]
    points = [(i, *s) for i, s in enumerate(spots(rng, 300))] + [(900, 2**30, -(2**30))]
    p = spark.createDataFrame([*points, (999, None, 1)], "id long, lat int, lon int")
    o = spark.createDataFrame([*others, (998, 1, None)], "other_id long, lat int, lon int")
    got = {r.id: (r.d2, r.other_id) for r in spatial.nearest(p, o, 100_000).collect()}
    assert got.pop(999) == (None, None) and got == {i: least(y, x, others) for i, y, x in points}
    assert {tuple(r) for r in spatial.nearest(p.limit(3), o.limit(0), 100).collect()} == {(i, None, None) for i in range(3)}


def test_nearest_named_on_heaps(spark):
    rng = random.Random(5)
    # A common name, a rare one and one that no city bears; a point may look for several names.
    cities = [(i, "rare" if i % 50 == 0 else "common", *s) for i, s in enumerate(spots(rng, 300))]
    points = [(i % 250, rng.choice(["rare", "common", "none", None]), *s) for i, s in enumerate(spots(rng, 300))]
    p, c = spark.createDataFrame(points, "id long, name string, lat int, lon int"), spark.createDataFrame([*cities, (999, None, 1, 1)], "city long, name string, lat int, lon int")
    for most in (50, 300_000):
        want: dict = {}
        for i, name, y, x in points:
            near = [v for v in (((y - q[2]) ** 2 + (x - q[3]) ** 2, q[0]) for q in cities if q[1] == name) if v[0] <= most * most]
            if near:
                want[i] = min([*near, *([want[i]] if i in want else [])])
        assert {r.id: (r.d2, r.city) for r in spatial.nearest_named(p, c, most).collect()} == want


def test_pairs_stay_few(spark, monkeypatch):
    """A search begins in squares of few places, however wide it may become."""
    seen = []
    rng = random.Random(6)
    at = [(i, rng.randrange(1000), rng.randrange(1000)) for i in range(2000)]
    monkeypatch.setattr(spatial, "cut", lambda df: seen.append(df) or df.localCheckpoint())
    spatial.nearest(spark.createDataFrame(at, "id long, lat int, lon int"), spark.createDataFrame(at, "other_id long, lat int, lon int"), 1_000_000).count()
    sides = {r.e for r in seen[1].select("e").distinct().collect()}
    assert len(sides) == 1 and 4 ** max(sides) <= 64
