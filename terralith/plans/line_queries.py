"""Filters and splitters of lines over tracks made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import lines
from . import tables as t
from .tables import SQL_TRACKS


def _tracks(spark, sf_dir):
    return t.track_lines(spark, sf_dir)


def rounded(spark, sf_dir):
    p = lines.rounded(F.col("points"), 6)
    out = _tracks(spark, sf_dir).withColumn("p", p)
    total = lambda axis: F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x[axis])
    return out.select("way_id", F.size("p").alias("n"), total("lat").alias("lats"), total("lon").alias("lons"), lines.predicted_points(F.col("points"), 18).alias("predicted"), lines.estimated_size("line", F.col("points"), 18).alias("size"))


ROUNDED_SQL = f"""WITH {SQL_TRACKS}, r AS (SELECT way_id, pos, ((lat + 32) >> 6) * 64 AS lat, ((lon + 32) >> 6) * 64 AS lon FROM tracks),
k AS (SELECT *, lag(lat) OVER w IS NULL OR lag(lat) OVER w <> lat OR lag(lon) OVER w <> lon AS keep FROM r WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
g AS (SELECT way_id, CAST(count(*) AS INT) AS n, CAST(sum(lat) AS BIGINT) AS lats, CAST(sum(lon) AS BIGINT) AS lons FROM k WHERE keep GROUP BY 1)
SELECT *, n AS predicted, CAST(CASE WHEN n <= 1 THEN 0 ELSE ((n - 1) // 250 + 1) * 11 + n * 4 END AS INT) AS size FROM g"""


def by_count(spark, sf_dir):
    parts = _tracks(spark, sf_dir).select("way_id", F.posexplode(lines.split_by_count(F.col("points"), 20)).alias("piece", "p"))
    return parts.select("way_id", "piece", F.size("p").alias("n"), F.element_at("p", 1)["lat"].alias("first_lat"), F.element_at("p", -1)["lon"].alias("last_lon"))


BY_COUNT_SQL = f"""WITH RECURSIVE {SQL_TRACKS}, n AS (SELECT way_id, CAST(count(*) AS INT) AS n FROM tracks GROUP BY 1),
cuts(way_id, n, piece, pos, size) AS (
  SELECT way_id, n, 0, 0, CASE WHEN n <= 20 THEN n WHEN n < 40 THEN n // 2 + 1 ELSE 20 END FROM n
  UNION ALL
  SELECT way_id, n, piece + 1, pos + size - 1, CASE WHEN n - (pos + size - 1) <= 20 THEN n - (pos + size - 1) WHEN n - (pos + size - 1) < 40 THEN (n - (pos + size - 1)) // 2 + 1 ELSE 20 END
  FROM cuts WHERE pos + size < n)
SELECT c.way_id, CAST(piece AS INT) AS piece, CAST(size AS INT) AS n, a.lat AS first_lat, b.lon AS last_lon
FROM cuts c JOIN tracks a ON a.way_id = c.way_id AND a.pos = c.pos JOIN tracks b ON b.way_id = c.way_id AND b.pos = c.pos + size - 1"""


def by_length(spark, sf_dir):
    parts = _tracks(spark, sf_dir).select("way_id", F.posexplode(lines.split_by_length(F.col("points"), 1500.0)).alias("piece", "p"))
    return parts.select("way_id", "piece", F.size("p").alias("n"), F.element_at("p", 1)["lat"].alias("first_lat"))


BY_LENGTH_SQL = f"""WITH RECURSIVE {SQL_TRACKS},
s AS (SELECT *, 6378137.0::DOUBLE * sqrt(pow(radians((x - lon) * 360.0::DOUBLE / 16777216) * cos(radians((y + lat) * 360.0::DOUBLE / 16777216 / 2)), 2) + pow(radians((y - lat) * 360.0::DOUBLE / 16777216), 2)) AS d
  FROM (SELECT way_id, pos, lat, lon, lead(lat) OVER w AS y, lead(lon) OVER w AS x FROM tracks WINDOW w AS (PARTITION BY way_id ORDER BY pos)) WHERE y IS NOT NULL),
f(way_id, pos, run, piece, cut) AS (
  SELECT way_id, pos, CASE WHEN d >= 1500 THEN 0 ELSE d END, 0, d >= 1500 FROM s WHERE pos = 0
  UNION ALL
  SELECT s.way_id, s.pos, CASE WHEN f.run + s.d >= 1500 THEN 0 ELSE f.run + s.d END, f.piece + CASE WHEN f.cut THEN 1 ELSE 0 END, f.run + s.d >= 1500
  FROM f JOIN s ON s.way_id = f.way_id AND s.pos = f.pos + 1),
g AS (SELECT way_id, piece, min(pos) AS pos, count(*) + 1 AS n FROM f GROUP BY 1, 2)
SELECT g.way_id, CAST(piece AS INT) AS piece, CAST(n AS INT) AS n, lat AS first_lat FROM g JOIN tracks t ON t.way_id = g.way_id AND t.pos = g.pos"""


def chain(spark, sf_dir):
    """The native part of the chain at a low resolution: rounding, size, emptiness; then the length left."""
    p = lines.rounded(F.col("points"), 9)
    out = _tracks(spark, sf_dir).withColumn("p", p).where(lines.not_empty(F.col("p"), "line")).where(lines.large_enough(F.col("p"), 3, 9, F.col("way_id") % 10 == 0))
    return out.select("way_id", F.size("p").alias("n"), lines.dimension(F.col("p")).alias("dimension"))


CHAIN_SQL = f"""WITH {SQL_TRACKS}, r AS (SELECT way_id, pos, ((lat + 256) >> 9) * 512 AS lat, ((lon + 256) >> 9) * 512 AS lon FROM tracks),
k AS (SELECT *, lag(lat) OVER w IS NULL OR lag(lat) OVER w <> lat OR lag(lon) OVER w <> lon AS keep FROM r WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
g AS (SELECT way_id, CAST(count(*) AS INT) AS n, CAST(greatest(max(lat) - min(lat), max(lon) - min(lon)) AS INT) AS dimension FROM k WHERE keep GROUP BY 1)
SELECT * FROM g WHERE n > 1 AND (dimension >= 3 * 512 OR way_id % 10 = 0)"""


def simplified(spark, sf_dir):
    """Every point that stays must be kept by plain recursion too: that is tested; here its number and the ends."""
    out = _tracks(spark, sf_dir).withColumn("p", lines.without_obsolete()(lines.simplified(60.0)("points")))
    return out.select("way_id", F.size("p").alias("n"), F.element_at("p", 1)["lat"].alias("first_lat"), F.element_at("p", -1)["lon"].alias("last_lon"))


def edges(spark, sf_dir):
    box = (37 * 4, -10, 37 * 400, 53 * 9)
    marked = _tracks(spark, sf_dir).select("way_id", F.explode(lines.on_box_edge(F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), (F.col("way_id") % 53 * 0 + p["lon"] - p["lon"] % 53).cast("int").alias("lon"))), box)).alias("p"))
    return marked.where("p.preserved").groupBy("way_id").agg(F.count(F.lit(1)).alias("n"))


EDGES_SQL = f"""WITH {SQL_TRACKS} SELECT way_id, count(*) AS n FROM tracks WHERE lat IN (148, 14800) OR lon - lon % 53 IN (-10, 477) GROUP BY 1"""


def by_size(spark, sf_dir):
    parts = _tracks(spark, sf_dir).select("way_id", F.posexplode(lines.split_by_size(700)("points")).alias("piece", "p"))
    return parts.select("way_id", "piece", F.size("p").alias("n"), lines.dimension(F.col("p")).alias("dimension"))


BY_SIZE_SQL = f"""WITH RECURSIVE {SQL_TRACKS},
f(way_id, pos, piece, low_y, high_y, low_x, high_x) AS (
  SELECT way_id, pos, 0, lat, lat, lon, lon FROM tracks WHERE pos = 0
  UNION ALL
  SELECT t.way_id, t.pos, f.piece + w, CASE w WHEN 1 THEN least(p.lat, t.lat) ELSE least(low_y, t.lat) END, CASE w WHEN 1 THEN greatest(p.lat, t.lat) ELSE greatest(high_y, t.lat) END,
    CASE w WHEN 1 THEN least(p.lon, t.lon) ELSE least(low_x, t.lon) END, CASE w WHEN 1 THEN greatest(p.lon, t.lon) ELSE greatest(high_x, t.lon) END
  FROM f JOIN tracks t ON t.way_id = f.way_id AND t.pos = f.pos + 1 JOIN tracks p ON p.way_id = f.way_id AND p.pos = f.pos,
  LATERAL (SELECT CASE WHEN greatest(greatest(high_y, t.lat) - least(low_y, t.lat), greatest(high_x, t.lon) - least(low_x, t.lon)) > 700 THEN 1 ELSE 0 END AS w))
SELECT way_id, CAST(piece AS INT) AS piece, CAST(count(*) + CASE WHEN piece > 0 THEN 1 ELSE 0 END AS INT) AS n, CAST(greatest(max(high_y) - min(low_y), max(high_x) - min(low_x)) AS INT) AS dimension FROM f GROUP BY way_id, piece"""


def previous(spark, sf_dir):
    """Tracks without points that repeat the place before, at a coarse grid."""
    grid = F.transform("points", lambda p: F.struct(F.floor(p["lat"] / 100).alias("lat"), F.floor(p["lon"] / 100).alias("lon")))
    return _tracks(spark, sf_dir).select("way_id", F.size(lines.without_doubles(grid)).alias("n"), F.size("points").alias("of"))


PREVIOUS_SQL = f"""WITH {SQL_TRACKS}, g AS (SELECT way_id, pos, floor(lat / 100.0) AS y, floor(lon / 100.0) AS x FROM tracks),
k AS (SELECT way_id, lag(y) OVER w IS NULL OR lag(y) OVER w <> y OR lag(x) OVER w <> x AS keep FROM g WINDOW w AS (PARTITION BY way_id ORDER BY pos))
SELECT way_id, CAST(count(*) FILTER (keep) AS INT) AS n, CAST(count(*) AS INT) AS of FROM k GROUP BY 1"""


def measured(spark, sf_dir):
    """Box, points hash and length of tracks, by aggregates over points."""
    p = t.tracks(spark, sf_dir)
    h = F.sum((F.col("lon") * 31 + F.col("lat")).cast("long"))
    wrapped = F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return p.groupBy("way_id").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), wrapped.cast("int").alias("points_hash"))


MEASURED_SQL = f"""WITH {SQL_TRACKS} SELECT way_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon,
  CAST((sum(CAST(lon * 31 + lat AS BIGINT)) + 2147483648) % 4294967296 - 2147483648 AS INT) AS points_hash FROM tracks GROUP BY 1"""

QUERIES = {
    "line_rounded": (rounded, ROUNDED_SQL),
    "line_split_by_count": (by_count, BY_COUNT_SQL),
    "line_split_by_length": (by_length, BY_LENGTH_SQL),
    "line_split_by_size": (by_size, BY_SIZE_SQL),
    "line_filter_chain": (chain, CHAIN_SQL),
    "line_simplified": (simplified, None),
    "line_box_edges": (edges, EDGES_SQL),
    "line_previous_point": (previous, PREVIOUS_SQL),
    "line_bounds_and_hash": (measured, MEASURED_SQL),
}
