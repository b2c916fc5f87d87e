"""Rings, shapes and centres over many groups at once."""

import math
import random

from pyspark.sql import functions as F

from terralith.operators import areas, kernels, roads, tiles, ways, work

POINT = "array<struct<node_id:long,lat:int,lon:int>>"


def test_rings_of_many_relations(spark):
    """1,200 relations: a square of two ways, every third with a hole and an island in it; none has a worker call of its own."""
    square = lambda k, a, b: [{"node_id": k * 100 + a * 10 + i, "lat": y, "lon": x} for i, (y, x) in enumerate([(a, a), (a, b), (b, b), (b, a)])]
    rows = []
    for k in range(1200):
        rings = [square(k, 0, 90), square(k, 1, 60), square(k, 2, 30)] if k % 3 == 0 else [square(k, 0, 90)]
        for i, r in enumerate(rings):
            rows += [(k, 2 * i, r[:3]), (k, 2 * i + 1, [r[0], r[3], r[2]])]
    random.Random(1).shuffle(rows)
    found = areas.assembled_rings(spark.createDataFrame(rows, f"rel_id long, pos int, points {POINT}"))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = {(r.rel_id, r.ring): (r.depth, r.parent, r.outer, abs(r.area2)) for r in found.collect()}
    assert len(got) == 400 * 3 + 800 and got[3, 2] == (2, 1, True, 2 * 28 * 28) and got[4, 0] == (0, None, True, 16200)
    tags = spark.range(1200).select(F.col("id").alias("rel_id"), F.create_map(F.lit("type"), F.lit("x")).alias("tags"))
    whole = {(r.rel_id, r.ring): (r.area2, len(r.holes)) for r in areas.polygons_of(found, tags).collect()}
    assert len(whole) == 400 * 2 + 800 and whole[3, 0] == (16200 - 2 * 59 * 59, 1) and whole[3, 2] == (2 * 28 * 28, 0)


def test_shapes_of_many_kinds(spark):
    square = lambda y, x: [{"lat": y, "lon": x}, {"lat": y + 1, "lon": x}, {"lat": y + 1, "lon": x + 1}, {"lat": y, "lon": x + 1}]
    rows = [(k * 10 + i, f"k{k}", square(k, i)) for k in range(300) for i in range(k % 4 + 1)]
    merged = areas.merge_shapes(spark.createDataFrame(rows, "id long, kind string, points array<struct<lat:int,lon:int>>"), ["kind"], 1 << 20)
    assert "FlatMapGroupsInPandas" not in merged._jdf.queryExecution().toString()
    assert {r.kind: len(r.points) for r in merged.collect()} == {f"k{k}": 2 * (k % 4 + 1) + 2 for k in range(300)}


def test_lists_of_points_keep_nulls_and_empty_ones(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [(1, 2), (3, 4)])], "id int, points array<struct<lat:int,lon:int>>")
    turned = kernels.on_points(lambda p: p[::-1])
    assert {r.id: r.p and [tuple(x) for x in r.p] for r in df.select("id", turned("points").alias("p")).collect()} == {1: None, 2: [], 3: [(3, 4), (1, 2)]}
    box = areas.clip_rings((0, 0, 9, 9))
    assert {r.id: r.p for r in df.select("id", box("points").alias("p")).collect()} == {1: None, 2: [], 3: []}


def test_spread_gives_work_to_all(spark):
    assert work.spread(spark.range(1000).coalesce(1), "id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_centres_by_roads_and_outside(spark):
    """Counts of roads and of nodes outside still halve a box; a limit that the arcs cannot reach asks for no count."""
    nodes = spark.createDataFrame([(i, i, 0, 1) for i in range(16)], "node_id long, lat int, lon int, bytes int")
    arcs = spark.createDataFrame([(i, i + 1, i) for i in range(15)], "from_node long, to_node long, way_id long")
    deal = lambda roads, outside: {r.node_id: r.centre for r in tiles.route_centres(nodes, arcs, 1 << 20, roads, outside, 1 << 20).collect()}
    assert set(deal(100, 100).values()) == {""}
    # Each eight of them start eight or seven ways, so boxes of four are the first with less than five.
    by_roads = deal(5, 100)
    assert sorted(list(by_roads.values()).count(c) for c in set(by_roads.values())) == [4, 4, 4, 4]
    # The lower half leads to a node of the upper one, and so do all its parts down to single nodes.
    outside = list(deal(9, 1).values())
    assert sorted(outside.count(c) for c in set(outside)) == [1] * 8 + [8]


def test_restrictions_read_the_lines_once(spark):
    """The roads behind the restrictions are written, so the last step scans no table of lines again."""
    from terralith import plans

    for name in ("road_restrictions", "road_forbidden_arcs"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan


def test_turns_of_many_nodes(spark):
    """Nodes have no worker call of their own; each still takes its smallest turns first."""
    rng = random.Random(7)
    spot = lambda n: (n, n * 7919 % 1009, n * 104729 % 2003)
    ends = {i: (rng.randrange(40), rng.randrange(40, 80)) if i % 2 else (rng.randrange(40, 80), rng.randrange(40)) for i in range(400)}
    df = spark.createDataFrame([(i, i % 3, [spot(a), spot(b)]) for i, (a, b) in ends.items()], f"way_id long, kind int, points {POINT}")
    pairs = roads.merge_pairs(df, ["kind"])
    assert "FlatMapGroupsInPandas" not in pairs._jdf.queryExecution().toString()
    every = roads.merge_pairs(df, ["kind"], most=180.0)
    for got, most in ((pairs, 130.0), (every, 180.0)):
        rows = [tuple(r) for r in got.collect()]
        into, out = {}, {}
        for n, a, b, turn in rows:
            assert ends[a][1] == ends[b][0] == n and a % 3 == b % 3 and turn <= most
            assert (into.setdefault(a, turn), out.setdefault(b, turn)) == (turn, turn)
        turn = {(a, b): t for _, a, b, t in rows}
        assert len(turn) == len(rows) == len(into) == len(out) > 40
        if most == 180.0:
            # No two ways that go on in one another are left over on both sides.
            assert not [1 for a in ends for b in ends if a != b and a not in into and b not in out and ends[a][1] == ends[b][0] and a % 3 == b % 3]


def test_a_ring_costs_no_rounds_by_the_number_of_ways(spark, monkeypatch):
    pairs = [(10, 11), (11, 12), (12, 10), (20, 21), (21, 20), (30, 31), (31, 32)]
    written = []
    monkeypatch.setattr(roads, "cut", lambda df: written.append(1) or df.localCheckpoint())
    got = roads.chains(spark.createDataFrame(pairs, "first long, second long"), spark.range(1 << 14).withColumnRenamed("id", "way_id"))
    found = {r.way_id: (r.head, r.place) for r in got.collect()}
    assert len(found) == 1 << 14 and len(written) < 14
    assert [found[i] for i in (10, 11, 12, 20, 21, 30, 31, 32, 40)] == [(10, 0), (10, 1), (10, 2), (20, 0), (20, 1), (30, 0), (30, 1), (30, 2), (40, 0)]


def test_filters_of_values_have_all_tasks(spark):
    """The rows of one small file are dealt out, and signs of six bits are packed without a loop over an array."""
    from terralith import plans
    from terralith.functions import text

    assert plans.QUERIES["value_filters_more"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    names = [None, "", "a", "ab", "Straße 12", "zZ-9 日", "0123456789", "  "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(names)], "id int, v string").select("id", text.encoded6(F.col("v")).alias("x"))
    assert "transform" not in df._jdf.queryExecution().optimizedPlan().toString().lower()

    def plain(v):
        signs = [c for c in v.replace("ß", "ss").upper() if c in " ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
        bits = "".join(f"{32 + int(c) if c.isdigit() else 0 if c == ' ' else ord(c) - 64:06b}" for c in signs) + "111111"
        bits += "0" * (-len(bits) % 8)
        return "".join(f"{int(bits[i : i + 8], 2):02X}" for i in range(0, len(bits), 8))

    assert {r.id: r.x for r in df.collect()} == {i: None if v is None else plain(v) for i, v in enumerate(names)}


def test_paths_at_closed_nodes_are_counted_not_made(spark, monkeypatch):
    rng = random.Random(8)
    refs = [(w, i, rng.randrange(30)) for w in range(600) for i in range(rng.randrange(2, 6))]
    way_nodes = spark.createDataFrame(refs, "way_id long, pos int, node_id long")
    nodes = spark.createDataFrame([(n, n * 7919 % 1009, n * 104729 % 2003) for n in range(30)], "node_id long, lat int, lon int")
    via = spark.createDataFrame([(3, 129), (4, 0), (5, 6), (5, 6), (6, None), (90, 0)], "node_id long, except_mask int")
    access = spark.createDataFrame([(w, rng.choice([129, 255, 6, 1, 256, None])) for w in range(550)], "way_id long, mask int")
    every, some = ways.arcs(way_nodes, nodes), ways.arcs(ways.passing(way_nodes, via), nodes, ways.degrees(way_nodes))
    passed = {w for w, _, n in refs if n in (3, 4, 5, 6)}
    plain = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert 0 < len(passed) < 600 and plain(some) == plain(every.where(F.col("way_id").isin(passed)))
    want = {r.node_id: r.n for r in ways.no_through_routes(every, via, access).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(want) == {3, 4, 5} and {r.node_id: r.n for r in ways.no_through_counts(some, via, access).collect()} == want
    # No step holds a row for each path: what is written has one for each end of an arc at most.
    written = []
    monkeypatch.setattr(ways, "cut", lambda df: written.append(df.localCheckpoint()) or written[-1])
    ways.no_through_counts(some, via, access).collect()
    assert [w.count() <= 2 * some.count() and 4 * w.count() < sum(want.values()) for w in written] == [True]


def test_length_of_a_way_computes_each_term_once(spark):
    """Functions over arrays are interpreted and share nothing, so what a step uses twice must have a name."""
    from terralith.functions import element

    rng = random.Random(9)
    lines = {i: [(rng.randrange(-(4 << 20), 4 << 20), rng.randrange(-(8 << 20), 8 << 20)) for _ in range(i % 6)] for i in range(40)}
    lines |= {50: None, 51: [(5, 5), (5, 900)], 52: [(0, 8 << 20), (90_000, -(8 << 20) + 1)], 53: [(7, 7), (7, 7)], 54: [(1, 1), (None, 2)]}
    df = spark.createDataFrame([(i, p) for i, p in lines.items()], "id int, points array<struct<lat:int,lon:int>>")
    df = df.select("id", element.way_length(F.col("points")).alias("m"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("TAN(") == 2 and plan.upper().count("SQRT(") == 2

    def metres(a, b):
        (y1, x1), (y2, x2) = ([math.radians(v * 360 / (1 << 24)) for v in p] for p in (a, b))
        near = math.hypot((x2 - x1) * math.cos((y1 + y2) / 2), y2 - y1) * 6378137.0
        turn = x2 - x1 - 2 * math.pi * (x2 - x1 > math.pi) + 2 * math.pi * (x2 - x1 < -math.pi)
        up = math.log(math.tan(y2 / 2 + math.pi / 4) / math.tan(y1 / 2 + math.pi / 4))
        return near if near < 10_000 else math.hypot(y2 - y1, turn * ((y2 - y1) / up if abs(up) > 1e-10 else math.cos(y1))) * 6378137.0

    got = {r.id: r.m for r in df.collect()}
    assert got.pop(54) is None
    for i, m in got.items():
        assert math.isclose(m, sum(metres(a, b) for a, b in zip(lines[i] or [], (lines[i] or [])[1:])), rel_tol=1e-9, abs_tol=1e-6)
