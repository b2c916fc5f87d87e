"""Kernels and roads against plain versions of themselves."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from terralith.functions import geo
from terralith.operators import areas, lines, roads, ways

POINT = "array<struct<lat:int,lon:int,node_id:long>>"


def way(*points):
    return [{"lat": y, "lon": x, "node_id": n} for n, y, x in points]


def plain_simplified(points, error):
    """Recursion over indices, as the textbook has it."""

    def metres(p, a, b):
        return float(lines.segment_metres(np.array([p[0]]), np.array([p[1]]), *a, *b)[0])

    if len(points) < 3:
        return points
    far = [metres(p, points[0], points[-1]) for p in points[1:-1]]
    most = max(far)
    if most <= error:
        return [points[0], points[-1]]
    at = max(i for i, d in enumerate(far) if d == most) + 1
    return plain_simplified(points[: at + 1], error)[:-1] + plain_simplified(points[at:], error)


def test_simplified_in_metres(spark):
    rng = random.Random(3)
    cases = [[(i * 20 + rng.randrange(9), rng.randrange(300)) for i in range(rng.randrange(2, 60))] for _ in range(40)]
    df = spark.createDataFrame([(i, [{"lat": y, "lon": x} for y, x in c]) for i, c in enumerate(cases)] + [(99, None), (98, [])], "id int, points array<struct<lat:int,lon:int>>")
    got = {r.id: r.p for r in df.select("id", lines.simplified(150.0)("points").alias("p")).collect()}
    assert got[99] is None and got[98] == []
    for i, c in enumerate(cases):
        assert [tuple(p) for p in got[i]] == plain_simplified(c, 150.0)
    # A detour of some 240 metres is more than 200 metres and less than 300.
    bent = spark.createDataFrame([([{"lat": 0, "lon": 0}, {"lat": 100, "lon": 500}, {"lat": 0, "lon": 1000}],)], "points array<struct<lat:int,lon:int>>")
    assert [bent.select(F.size(lines.simplified(e)("points"))).first()[0] for e in (200.0, 300.0)] == [3, 2]


def test_preserved_points_stay(spark):
    t = "array<struct<lat:int,lon:int,preserved:boolean>>"
    line = [{"lat": i, "lon": i * 10, "preserved": i == 4} for i in range(9)]
    got = spark.createDataFrame([(line,)], f"points {t}").select(lines.simplified(1e6, t)("points").alias("p")).first().p
    assert [p.lat for p in got] == [0, 4, 8]


def test_obsolete_points():
    def left(points, shape=False):
        y, x = np.array([p[0] for p in points]), np.array([p[1] for p in points])
        return [p for p, k in zip(points, lines.obsolete_mask(y, x, shape)) if k]

    assert left([(0, 0), (0, 0), (1, 1), (2, 2), (5, 0)]) == [(0, 0), (2, 2), (5, 0)]
    assert left([(0, 0), (0, 5), (0, 2), (3, 2)]) == [(0, 0), (0, 2), (3, 2)]
    assert left([(i, i) for i in range(20)]) == [(0, 0), (19, 19)]
    square = [(0, 0), (0, 2), (0, 4), (2, 4), (4, 4), (4, 0), (2, 0)]
    assert left(square, shape=True) == [(0, 0), (0, 4), (4, 4), (4, 0)]
    assert left([(3, 3), (3, 3)]) == [(3, 3)]
    rng = random.Random(1)
    for _ in range(200):
        line = [(rng.randrange(3), rng.randrange(3)) for _ in range(rng.randrange(1, 15))]
        out = left(line)
        assert out[0] == line[0] and (len(out) < 2 or out[-1] == line[-1])
        for a, b, c in zip(out, out[1:], out[2:]):
            assert (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])


def test_chained_rings():
    rings, open_ = areas.chained([[1, 2], [3, 2], [3, 1], [7, 8], [8, 9], [5]])
    assert rings == [[1, 2, 3, 1]] and open_ == [[9, 8, 7]] or open_ == [[7, 8, 9]]
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randrange(4, 40)
        ring = list(range(n))
        cuts = sorted(rng.sample(range(n), rng.randrange(2, min(n, 6))))
        parts = [(ring * 2)[a : (b if b > a else b + n) + 1] for a, b in zip(cuts, cuts[1:] + cuts[:1])]
        parts = [p[::-1] if rng.random() < 0.5 else p for p in parts]
        rng.shuffle(parts)
        found, rest = areas.chained(parts)
        assert not rest and len(found) == 1 and sorted(found[0][:-1]) == ring and found[0][0] == found[0][-1]


def test_nesting_and_gaps():
    square = lambda a, b: [(a, a), (a, b), (b, b), (b, a)]
    assert areas.nested([square(0, 100), square(10, 50), square(20, 30), square(60, 90), square(200, 300)]) == [(0, None), (1, 0), (2, 1), (1, 0), (0, None)]
    assert areas.closed_gaps([[(0, 0), (0, 10), (10, 10)], [(10, 12), (10, 20), (-1, 1)]], 3) != []
    assert areas.closed_gaps([[(0, 0), (0, 10), (10, 10)]], 3) == []


def test_union_area():
    square = lambda y, x, s: [(y, x), (y, x + s), (y + s, x + s), (y + s, x)]
    assert areas.union_area([square(0, 0, 10), square(5, 5, 10)]) == 175
    assert areas.union_area([square(0, 0, 10), square(0, 0, 10), square(20, 20, 2)]) == 104
    assert math.isclose(areas.union_area([[(0, 0), (10, 5), (0, 10)], [(10, 0), (0, 5), (10, 10)]]), 50 + 50 - 25)


def test_merged_and_split_shapes():
    square = lambda y, x, s: [(y, x), (y + s, x), (y + s, x + s), (y, x + s)]
    merged = areas.joined_shapes([square(0, 0, 4), square(0, 4, 4), square(20, 20, 2)])
    assert sorted(abs(areas.signed_area(r)) for r in merged) == [8, 64]
    parts = areas.split_ring([(0, 0), (1000, 0), (1000, 100), (0, 100)], 250, 128)
    assert sum(abs(areas.signed_area(p)) for p in parts) == 200_000 and all(max(y for y, _ in p) - min(y for y, _ in p) <= 128 for p in parts)


def test_sea():
    box = (0, 0, 100, 100)
    # The coast runs north in the middle with land to its left, so the east is sea.
    sea, islands = areas.sea_rings([[(0, 50), (100, 50)]], box)
    assert islands == [] and [abs(areas.signed_area(r)) for r in sea] == [2 * 50 * 100]
    assert all(x >= 50 for r in sea for _, x in r)
    sea, islands = areas.sea_rings([[(10, 10), (10, 20), (20, 20), (20, 10), (10, 10)]], box)
    assert len(islands) == 1 and [abs(areas.signed_area(r)) for r in sea] == [20_000]
    assert areas.sea_rings([], box) == ([], [])


def test_lines_in_a_box(spark):
    df = spark.createDataFrame([([{"lat": 50, "lon": 50}, {"lat": 50, "lon": 150}, {"lat": 150, "lon": 150}, {"lat": 150, "lon": 50}, {"lat": 50, "lon": 50}],)], "points array<struct<lat:int,lon:int>>")
    box = (0, 0, 100, 100)
    got = df.select(areas.clip_lines(box)("points").alias("p"), areas.with_edge_points(box)("points").alias("e")).first()
    assert [[tuple(p) for p in line] for line in got.p] == [[(100, 50), (50, 50), (50, 100)]]
    assert [tuple(p) for p in got.e[0]] == [(50, 50), (50, 100), (50, 150), (150, 150), (150, 50), (100, 50), (50, 50)]


def test_crossing(spark):
    p = lambda y, x: F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon"))
    at = lambda *c: spark.range(1).select(geo.crossing(*c).alias("c")).first().c
    assert tuple(at(p(0, 0), p(10, 10), p(0, 10), p(10, 0))) == (5, 5)
    assert at(p(0, 0), p(10, 10), p(0, 30), p(10, 20)) is None
    assert at(p(0, 0), p(10, 10), p(1, 0), p(11, 10)) is None
    assert tuple(at(p(0, 0), p(0, 10), p(-4, 10), p(4, 10))) == (0, 10)


def test_roundabouts(spark):
    n = 24
    ring = [(i, int(1000 * math.sin(2 * math.pi * i / n)), int(1000 * math.cos(2 * math.pi * i / n))) for i in range(n)]
    ring.append(ring[0])
    df = spark.createDataFrame([(1, way(*ring)), (2, way(*ring[::-1])), (3, way(*ring[:2]))], f"id int, points {POINT}")
    got = {r.id: r.v for r in df.select("id", roads.roundabout_direction(F.col("points")).alias("v")).collect()}
    assert got[1] == -got[2] != 0 and got[3] == 0


def test_merged_roads(spark):
    """Straight chains, a fork that takes the smaller turn, a ring, and a road that must not be merged."""
    rows = [
        (1, "a", way((1, 0, 0), (2, 0, 1000))), (2, "a", way((2, 0, 1000), (3, 0, 2000))), (3, "a", way((3, 0, 2000), (4, 900, 2100))), (4, "a", way((3, 0, 2000), (5, 50, 3000))),
        (5, "b", way((5, 50, 3000), (6, 50, 4000))), (6, "c", way((7, 5000, 0), (8, 5000, 1000), (9, 6000, 1000))), (7, "c", way((9, 6000, 1000), (10, 6000, 0), (7, 5000, 0))),
        (8, "a", way((5, 50, 3000), (20, 50, 4000))),
    ]
    df = spark.createDataFrame(rows, f"way_id long, name string, points {POINT}")
    got = {r.way_id: [p.node_id for p in r.points] for r in roads.merged(df, ["name"]).collect()}
    assert got[1] == [1, 2, 3, 5, 20] and got[3] == [3, 4] and got[5] == [5, 6]
    assert len(got) == 4 and sorted(len(v) for k, v in got.items() if k in (6, 7)) == [5]
    closed = spark.createDataFrame([(5, 8)], "node_id long, way_id long")
    got = {r.way_id: [p.node_id for p in r.points] for r in roads.merged(df, ["name"], closed).collect()}
    assert got[1] == [1, 2, 3, 5] and got[8] == [5, 20]


def test_chains_of_any_length(spark):
    rng = random.Random(5)
    ids = list(range(100, 160))
    rng.shuffle(ids)
    parts = [ids[:33], ids[33:40], ids[40:41], ids[41:60]]
    pairs = [(a, b) for p in parts for a, b in zip(p, p[1:])] + [(parts[1][-1], parts[1][0])]
    got = roads.chains(spark.createDataFrame(pairs, "first long, second long"), spark.createDataFrame([(i,) for i in ids], "way_id long"))
    found = {r.way_id: (r.head, r.place) for r in got.collect()}
    for p in (parts[0], parts[2], parts[3]):
        assert [found[i] for i in p] == [(p[0], k) for k in range(len(p))]
    ring, start = parts[1], parts[1].index(min(parts[1]))
    assert [found[i] for i in ring[start:] + ring[:start]] == [(min(ring), k) for k in range(len(ring))]


def test_split_by_nodes(spark):
    rows = [(1, i, i) for i in range(150)] + [(2, i, n) for i, n in enumerate([1, 2, 3, 4, 2, 5])] + [(3, 0, 8), (3, 1, 9)]
    df = spark.createDataFrame(rows, "way_id long, pos int, node_id long")
    got = sorted(tuple(r) for r in roads.split_by_nodes(df, F.lit(True)).collect())
    assert got == [(1, 0, 0, 63), (1, 1, 63, 126), (1, 2, 126, 149), (2, 0, 0, 3), (2, 1, 3, 5), (3, 0, 0, 1)]


def test_major_arcs(spark):
    arcs = spark.createDataFrame([(1, 1, 10, 11, 100.0), (1, 2, 11, 12, 200.0), (1, 3, 12, 13, 50.0)], "way_id long, arc long, from_node long, to_node long, metres double")
    classes = spark.createDataFrame([(11, 1), (12, 0), (13, 4)], "node_id long, class int")
    got = roads.major_arcs(arcs, classes, spark.createDataFrame([(1, 3)], "way_id long, class int"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10, 13, 350.0, 2), (1, 11, 13, 250.0, 1)]


def test_arcs_have_bearings(spark):
    nodes = spark.createDataFrame([(1, 0, 0), (2, 0, 1000), (3, 1000, 1000)], "node_id long, lat int, lon int")
    way_nodes = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (7, 2, 3)], "way_id long, pos int, node_id long")
    rows = {r.forward: r for r in ways.both_directions(ways.arcs(way_nodes, nodes)).collect()}
    assert [round(rows[True][c]) for c in ("heading", "end_heading", "direct")] == [90, 0, 45]
    assert [round(rows[False][c]) for c in ("heading", "end_heading", "direct")] == [180, -90, -135]
    turned = roads.widened(ways.both_directions(ways.arcs(way_nodes, nodes)))
    assert turned.count() == 2


def test_sharp_angles(spark):
    rows = [(9, 1, k, True, float(h)) for k, h in enumerate((0, 3, 90, 91))]
    df = spark.createDataFrame(rows, "from_node long, way_id long, arc long, forward boolean, heading double")
    got = [r.heading_byte for r in roads.widened(df).orderBy("arc").collect()]
    assert got == [0, 16, 64, 80]


def test_lines_merged_at_places(spark):
    rows = [(1, 5, [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 9}]), (2, 5, [{"lat": 0, "lon": 9}, {"lat": 9, "lon": 1}]), (3, 6, [{"lat": 9, "lon": 1}, {"lat": 20, "lon": 1}])]
    df = spark.createDataFrame(rows, "way_id long, type int, points array<struct<lat:int,lon:int>>")
    assert sorted((r.way_id, r.n_ways, len(r.points)) for r in roads.merged_lines(df, ["type"]).collect()) == [(1, 2, 3), (3, 1, 2)]


def test_smoothed():
    line = [(0, 0), (4, 1), (0, 2), (4, 3), (0, 4), (4, 40), (0, 80)]
    out = lines.smoothed(line, 5)
    assert out[0] == line[0] and out[-1] == line[-1] and len(out) < len(line) and lines.smoothed(line, 0) == line


def test_flares(spark):
    rows = [(1, 2, 10, True, 5.0), (1, 2, 11, True, 30.0), (1, 2, 12, True, 90.0), (1, 3, 13, True, 6.0)]
    both = spark.createDataFrame(rows, "from_node long, to_node long, way_id long, forward boolean, heading double")
    got = roads.flares(both, spark.createDataFrame([(10,), (11,), (12,), (13,)], "way_id long")).collect()
    assert [tuple(r) for r in got] == [(1, 10, 11, 25.0)]


def test_options_and_stages(spark, tmp_path):
    from terralith.operators.hooks import Options, Stages, chain, parse_options

    (tmp_path / "tags").write_text("note=* # all\nfixme=yes\n")
    got = parse_options(["--levels=0=24", "--style-option=a=1;b=2", "--housenumbers", f"--delete-tags-file={tmp_path / 'tags'}", "--unknown=x", "--no-transparent", "--name-tag-list=name:en,name"])
    assert got.levels == "0=24" and got.style_option == {"a": "1", "b": "2"} and got.housenumbers and got.other == {"unknown": "x"} and not got.transparent
    assert got.delete_tags == (("note", "*"), ("fixme", "yes")) and got.name_tag_list == ("name:en", "name")
    assert parse_options("min-size-polygon: 4\n# c\nmerge-lines\n").min_size_polygon == 4
    seen = []
    stages = Stages().add("poi", lambda t, o: seen.append("poi") or {}).add("sea", lambda t, o: seen.append("sea") or {"x": t["nodes"]}).add("location", lambda t, o: {}, lambda o: o.housenumbers and seen.append("no"))
    out = stages.run({"nodes": spark.range(3)}, Options())
    assert seen == ["sea", "poi"] and set(out) == {"nodes", "x"}
    assert chain(lambda d: d.where("id > 0"), lambda d: d.union(d))(spark.range(3)).count() == 4
