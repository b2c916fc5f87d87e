"""Geometry functions, ways, the network and spatial joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import kernels, spatial, ways
from . import tables as t
from .tables import SQL_NODES, SQL_SEGMENTS, SQL_STOP_NODES, SQL_WAY_NODES, read, sql_point


def units(spark, sf_dir):
    deg = F.col("c_acctbal") / 100
    hp = geo.map_units(deg, geo.UNITS_30)
    low = geo.low_precision(hp)
    return read(spark, sf_dir, "customer").select("c_custkey", geo.map_units(deg).alias("u24"), hp.alias("u30"), low.alias("low"), geo.rounded_units(low, 6).alias("rounded"), geo.point_key(low, hp).alias("key"), geo.heading_byte(deg).alias("heading"))


_U = "CAST(trunc((d + CASE WHEN d > 0 THEN 180.0::DOUBLE / {n} ELSE -180.0::DOUBLE / {n} END) * {n} / 360.0::DOUBLE) AS INT)"
UNITS_SQL = f"""
WITH a AS (SELECT c_custkey, c_acctbal / 100 AS d FROM customer),
b AS (SELECT *, {_U.format(n=1 << 24)} AS u24, {_U.format(n=1 << 30)} AS u30 FROM a),
c AS (SELECT *, (u30 + 32) >> 6 AS low FROM b)
SELECT c_custkey, u24, u30, low, ((low + 32) >> 6) * 64 AS rounded, CAST(low AS BIGINT) * 4294967296 + (CAST(u30 AS BIGINT) & 4294967295) AS key,
  CAST(((CAST(floor(d * 256.0::DOUBLE / 360.0::DOUBLE + 0.5) AS INT) % 256) + 256) % 256 AS INT) AS heading FROM c
"""


def measures(spark, sf_dir):
    at = lambda c: geo.degrees(F.col(c))
    a = t.points(spark, sf_dir, "part", "p_partkey")
    b = a.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    four = [at("lat"), at("lon"), at("lat2"), at("lon2")]
    return a.join(b, "id").select("id", F.round(geo.equirectangular(*four), 2).alias("flat"), F.round(geo.haversine(*four), 2).alias("great"), F.round(geo.rhumb(*four), 2).alias("rhumb"), F.round(geo.bearing(*four), 6).alias("bearing"))


MEASURES_SQL = f"""
WITH p AS (SELECT p_partkey AS id, {sql_point('p_partkey')} FROM part),
q AS (SELECT a.id, radians(a.lat * 360.0::DOUBLE / 16777216) AS y1, radians(a.lon * 360.0::DOUBLE / 16777216) AS x1, radians(b.lat * 360.0::DOUBLE / 16777216) AS y2, radians(b.lon * 360.0::DOUBLE / 16777216) AS x2
      FROM p a JOIN p b ON b.id = a.id + 1),
r AS (SELECT *, ln(tan(y2 / 2 + pi() / 4) / tan(y1 / 2 + pi() / 4)) AS s FROM q)
SELECT id, round(6378137.0::DOUBLE * sqrt(pow((x2 - x1) * cos((y1 + y2) / 2), 2) + pow(y2 - y1, 2)), 2) AS flat,
  round(2 * 6378137.0::DOUBLE * asin(sqrt(pow(sin((y2 - y1) / 2), 2) + cos(y1) * cos(y2) * pow(sin((x2 - x1) / 2), 2))), 2) AS great,
  round(6378137.0::DOUBLE * sqrt(pow(y2 - y1, 2) + pow(CASE WHEN abs(s) > 1e-10 THEN (y2 - y1) / s ELSE cos(y1) END * (x2 - x1), 2)), 2) AS rhumb,
  round(degrees(atan2(sin(x2 - x1) * cos(y2), cos(y1) * sin(y2) - sin(y1) * cos(y2) * cos(x2 - x1))), 6) AS bearing
FROM r
"""


def assembled(spark, sf_dir):
    out = ways.assembled(t.way_nodes(spark, sf_dir), t.nodes(spark, sf_dir))
    size = F.size("points")
    return out.select("way_id", size.alias("n"), "complete", F.element_at("points", 1)["node_id"].alias("first_node"), F.element_at("points", -1)["node_id"].alias("last_node"), geo.signed_area(F.col("points")).alias("area2"), (F.element_at("points", 1)["node_id"].eqNullSafe(F.element_at("points", -1)["node_id"]) & (size > 2)).alias("closed"))


ASSEMBLED_SQL = f"""
WITH {SQL_NODES}, {SQL_WAY_NODES},
p AS (SELECT way_id, pos, node_id, CAST(lat AS BIGINT) AS lat, CAST(lon AS BIGINT) AS lon, count(*) OVER (PARTITION BY way_id) AS n FROM way_nodes JOIN nodes USING (node_id)),
s AS (SELECT a.way_id, CAST(sum((b.lon - a.lon) * (a.lat + b.lat)) AS BIGINT) AS area2 FROM p a JOIN p b ON a.way_id = b.way_id AND b.pos = (a.pos + 1) % a.n GROUP BY 1)
SELECT way_id, CAST(count(*) AS INT) AS n, true AS complete, min_by(node_id, pos) AS first_node, max_by(node_id, pos) AS last_node, any_value(area2) AS area2,
  count(*) > 2 AND min_by(node_id, pos) = max_by(node_id, pos) AS closed
FROM p JOIN s USING (way_id) GROUP BY way_id
"""


def straightness(spark, sf_dir):
    s = ways.segments(t.way_nodes(spark, sf_dir), t.nodes(spark, sf_dir))
    after = s.select("way_id", (F.col("pos") - 1).alias("pos"), F.col("to_lat").alias("lat3"), F.col("to_lon").alias("lon3"))
    kind = geo.straightness(*[F.col(c) for c in ("lat", "lon", "to_lat", "to_lon", "lat3", "lon3")])
    return s.join(after, ["way_id", "pos"]).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


STRAIGHTNESS_SQL = f"""
WITH {SQL_NODES}, {SQL_WAY_NODES}, {SQL_SEGMENTS},
x AS (SELECT CAST(a.lat2 - a.lat1 AS BIGINT) AS dy1, CAST(a.lon2 - a.lon1 AS BIGINT) AS dx1, CAST(b.lat2 - b.lat1 AS BIGINT) AS dy2, CAST(b.lon2 - b.lon1 AS BIGINT) AS dx2
      FROM segments a JOIN segments b ON a.way_id = b.way_id AND b.pos = a.pos + 1)
SELECT CASE WHEN dy1 * dx2 <> dx1 * dy2 THEN 'bent' WHEN dy1 * dy2 + dx1 * dx2 < 0 THEN 'spike' ELSE 'straight' END AS kind, count(*) AS n FROM x GROUP BY 1
"""


def degree(spark, sf_dir):
    return ways.degrees(t.way_nodes(spark, sf_dir)).groupBy(F.col("degree").cast("long").alias("degree")).agg(F.count(F.lit(1)).alias("n"))


DEGREE_SQL = "SELECT d AS degree, count(*) AS n FROM (SELECT least(count(*), 127) AS d FROM lineitem GROUP BY l_partkey) GROUP BY 1"


def lengths(spark, sf_dir):
    return ways.segments(t.way_nodes(spark, sf_dir), t.nodes(spark, sf_dir)).groupBy("way_id").agg(F.round(F.sum("metres"), 1).alias("metres"), F.min("lat").alias("min_lat"), F.max("to_lon").alias("max_to_lon"))


LENGTHS_SQL = f"WITH {SQL_NODES}, {SQL_WAY_NODES}, {SQL_SEGMENTS} SELECT way_id, round(sum(metres), 1) AS metres, min(lat1) AS min_lat, max(lon2) AS max_to_lon FROM segments GROUP BY 1"


def arcs(spark, sf_dir):
    out = ways.both_directions(ways.arcs(t.way_nodes(spark, sf_dir), t.nodes(spark, sf_dir)))
    return out.select("way_id", F.col("arc").cast("long").alias("arc"), "from_node", "to_node", F.round("metres", 1).alias("metres"), "n_segments", "forward")


_ARCS = f"""WITH {SQL_NODES}, {SQL_WAY_NODES}, {SQL_SEGMENTS},
degree AS (SELECT node_id, count(*) AS d FROM way_nodes GROUP BY 1),
marked AS (SELECT way_id, pos, sum(CASE WHEN pos = 0 OR d > 1 OR pos = last THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos) AS arc
  FROM (SELECT *, max(pos) OVER (PARTITION BY way_id) AS last FROM way_nodes) JOIN degree USING (node_id)),
arcs AS (SELECT way_id, CAST(arc AS BIGINT) AS arc, min_by(from_node, pos) AS from_node, max_by(to_node, pos) AS to_node, round(sum(metres), 1) AS metres, count(*) AS n_segments
  FROM segments JOIN marked USING (way_id, pos) GROUP BY way_id, arc)"""
ARCS_SQL = f"{_ARCS} SELECT *, true AS forward FROM arcs UNION ALL SELECT way_id, arc, to_node, from_node, metres, n_segments, false FROM arcs"


def dead_ends(spark, sf_dir):
    return ways.dead_ends(t.stop_nodes(spark, sf_dir))


DEAD_ENDS_SQL = f"""WITH {SQL_STOP_NODES},
e AS (SELECT way_id, min_by(node_id, pos) AS node_id FROM stop_nodes GROUP BY 1 UNION SELECT way_id, max_by(node_id, pos) FROM stop_nodes GROUP BY 1)
SELECT way_id, node_id FROM e WHERE node_id IN (SELECT node_id FROM stop_nodes GROUP BY 1 HAVING count(*) = 1)"""


def unconnected(spark, sf_dir):
    return ways.unconnected(t.stop_nodes(spark, sf_dir))


UNCONNECTED_SQL = """WITH w AS (SELECT DISTINCT l_orderkey AS way_id, l_partkey * 1000000 + l_suppkey AS node_id FROM lineitem)
SELECT DISTINCT way_id FROM w WHERE way_id NOT IN (SELECT a.way_id FROM w a JOIN w b ON a.node_id = b.node_id AND a.way_id <> b.way_id)"""


def through(spark, sf_dir):
    via = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("node_id"))
    a = ways.arcs(t.way_nodes(spark, sf_dir), t.nodes(spark, sf_dir))
    return ways.through_route_counts(a, via)


THROUGH_SQL = f"""{_ARCS}, u AS (SELECT way_id, from_node AS node_id FROM arcs UNION SELECT way_id, to_node FROM arcs),
v AS (SELECT * FROM u WHERE node_id IN (SELECT s_suppkey * 20 FROM supplier))
SELECT node_id, count(*) AS n_pairs FROM v a JOIN v b USING (node_id) WHERE a.way_id <> b.way_id GROUP BY 1"""


def node_class(spark, sf_dir):
    classes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("road_class"))
    return ways.node_class(t.way_nodes(spark, sf_dir), classes)


NODE_CLASS_SQL = f"""WITH c AS (SELECT DISTINCT l_partkey AS node_id, l_orderkey AS way_id, CAST(substring(o_orderpriority, 1, 1) AS INT) - 1 AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT node_id, k, count(*) AS n FROM c GROUP BY 1, 2)
SELECT node_id, CAST(coalesce(max(k) FILTER (n > 1), CASE WHEN count(*) = 1 THEN max(k) ELSE (list(k ORDER BY k DESC))[2] END) AS INT) AS class FROM n GROUP BY 1"""

VEHICLES = {"car": 1, "bus": 2, "bike": 4, "foot": 8}


def access(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    tags = {"car": F.when(F.col("o_orderstatus") == "O", F.lit("no")), "bus": F.when(F.col("o_orderstatus") == "F", F.lit("yes")).otherwise(F.lit("0")), "bike": F.lit(None).cast("string"), "foot": F.when(F.col("o_orderkey") % 3 == 0, F.lit("false"))}
    return o.select("o_orderkey", ways.access_mask(tags, VEHICLES).alias("mask"))


ACCESS_SQL = "SELECT o_orderkey, CAST((CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END) + (CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END) + 4 + (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 8 END) AS INT) AS mask FROM orders"


def chunks(spark, sf_dir):
    return ways.chunked(t.way_nodes(spark, sf_dir), 3).select("way_id", F.col("chunk").cast("long").alias("chunk"), "first", F.col("last").cast("int").alias("last"), F.col("n").cast("int").alias("n"))


CHUNKS_SQL = f"""WITH {SQL_WAY_NODES}, s AS (SELECT *, count(*) OVER (PARTITION BY way_id) AS size FROM way_nodes)
SELECT way_id, CAST(pos // 2 AS BIGINT) AS chunk, min(pos) AS first, CAST(least(min(pos) + 2, max(size) - 1) AS INT) AS last, CAST(least(min(pos) + 2, max(size) - 1) - min(pos) + 1 AS INT) AS n
FROM s WHERE pos < size - 1 OR size = 1 GROUP BY 1, 2"""


def in_boxes(spark, sf_dir):
    k = F.col("n_nationkey")
    boxes = read(spark, sf_dir, "nation").select("n_name", (k * 70000 - 900000).alias("min_lat"), (k * 70000 - 700000).alias("max_lat"), (k * 150000 - 2000000).alias("min_lon"), (k * 150000 - 1200000).alias("max_lon"))
    return spatial.points_in_boxes(t.points(spark, sf_dir, "customer", "c_custkey"), boxes, 200_000).select("id", "n_name")


IN_BOXES_SQL = f"""WITH p AS (SELECT c_custkey AS id, {sql_point('c_custkey')} FROM customer)
SELECT id, n_name FROM p JOIN nation ON lat BETWEEN n_nationkey * 70000 - 900000 AND n_nationkey * 70000 - 700000 AND lon BETWEEN n_nationkey * 150000 - 2000000 AND n_nationkey * 150000 - 1200000"""


def nearest(spark, sf_dir):
    cities = t.points(spark, sf_dir, "supplier", "s_suppkey").select((F.col("id") * 1).alias("other_id"), F.col("lat"), F.col("lon"))
    return spatial.nearest(t.points(spark, sf_dir, "customer", "c_custkey"), cities, 100_000)


_D2 = "CAST(p.lat - c.lat AS BIGINT) * (p.lat - c.lat) + CAST(p.lon - c.lon AS BIGINT) * (p.lon - c.lon)"
_CITIES = f"WITH p AS (SELECT c_custkey AS id, {sql_point('c_custkey')} FROM customer), c AS (SELECT s_suppkey AS other_id, {sql_point('s_suppkey')} FROM supplier)"
NEAREST_SQL = f"{_CITIES} SELECT id, other_id, d2 FROM (SELECT id, other_id, {_D2} AS d2, row_number() OVER (PARTITION BY id ORDER BY {_D2}, other_id) AS r FROM p, c) WHERE r = 1"


def radius(spark, sf_dir):
    cities = t.points(spark, sf_dir, "supplier", "s_suppkey").withColumnRenamed("id", "other_id")
    return spatial.within_radius(t.points(spark, sf_dir, "customer", "c_custkey"), cities, 60_000)


RADIUS_SQL = f"{_CITIES} SELECT id, other_id, {_D2} AS d2 FROM p, c WHERE {_D2} <= 3600000000"


def by_name(spark, sf_dir):
    cities = t.points(spark, sf_dir, "supplier", "s_suppkey").join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("name")), "id")
    points = t.points(spark, sf_dir, "customer", "c_custkey").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("name")), "id")
    return spatial.nearest_named(points, cities.withColumnRenamed("id", "city"), 600_000)


BY_NAME_SQL = f"""WITH p AS (SELECT c_custkey AS id, c_nationkey AS name, {sql_point('c_custkey')} FROM customer), c AS (SELECT s_suppkey AS city, s_nationkey AS name, {sql_point('s_suppkey')} FROM supplier)
SELECT id, city, d2 FROM (SELECT id, city, {_D2} AS d2, row_number() OVER (PARTITION BY id ORDER BY {_D2}, city) AS r FROM p JOIN c USING (name)) WHERE r = 1 AND d2 <= 360000000000"""


def pyramid(spark, sf_dir):
    return spatial.subdivided(t.points(spark, sf_dir, "customer", "c_custkey"), 60, 1 << 20, 1 << 15)


_LEVELS = ", ".join(f"l{i} AS (SELECT lat, lon FROM ({'p' if i == 0 else f'l{i - 1}'}) QUALIFY count(*) OVER (PARTITION BY floor(lon / {(1 << 20) >> (i - 1)}.0), floor(lat / {(1 << 20) >> (i - 1)}.0)) > 60)" if i else "l0 AS (SELECT lat, lon FROM p)" for i in range(6))
PYRAMID_SQL = f"WITH p AS (SELECT {sql_point('c_custkey')} FROM customer), {_LEVELS} " + " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS depth, CAST(floor(lon / {(1 << 20) >> i}.0) AS BIGINT) AS cx, CAST(floor(lat / {(1 << 20) >> i}.0) AS BIGINT) AS cy, count(*) AS n FROM l{i} GROUP BY ALL" + (" HAVING count(*) <= 60" if i < 5 else "") for i in range(6)
)


def simplified(spark, sf_dir):
    """Rows only: the kernel is compared with a brute-force version in the tests."""
    lines = ways.assembled(t.way_nodes(spark, sf_dir), t.nodes(spark, sf_dir))
    points = F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    thin = kernels.on_points(lambda line: kernels.simplified(kernels.without_obsolete(line), 200_000.0))
    clip = kernels.on_points(lambda line: kernels.clipped_ring((-500_000, -1_000_000, 500_000, 1_000_000), line))
    return lines.select("way_id", F.size(thin(points)).alias("n_simplified"), F.size(clip(points)).alias("n_clipped"))


QUERIES = {
    "geo_units": (units, UNITS_SQL),
    "geo_measures": (measures, MEASURES_SQL),
    "way_assembly": (assembled, ASSEMBLED_SQL),
    "way_straightness": (straightness, STRAIGHTNESS_SQL),
    "way_lengths": (lengths, LENGTHS_SQL),
    "way_chunks": (chunks, CHUNKS_SQL),
    "way_kernels": (simplified, None),
    "junction_degree": (degree, DEGREE_SQL),
    "network_arcs": (arcs, ARCS_SQL),
    "network_dead_ends": (dead_ends, DEAD_ENDS_SQL),
    "network_unconnected": (unconnected, UNCONNECTED_SQL),
    "network_through_routes": (through, THROUGH_SQL),
    "network_node_class": (node_class, NODE_CLASS_SQL),
    "network_access_mask": (access, ACCESS_SQL),
    "spatial_point_in_box": (in_boxes, IN_BOXES_SQL),
    "spatial_nearest": (nearest, NEAREST_SQL),
    "spatial_radius": (radius, RADIUS_SQL),
    "spatial_nearby_by_name": (by_name, BY_NAME_SQL),
    "spatial_subdivision": (pyramid, PYRAMID_SQL),
}
