"""The driver's tables seen as nodes, ways and boundaries; the same formulas as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ways


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lat(key: str) -> F.Column:
    return (F.col(key).cast("long") * 7919 % 2000003 - 1000000).cast("int")


def lon(key: str) -> F.Column:
    return (F.col(key).cast("long") * 104729 % 4000037 - 2000000).cast("int")


def points(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """(id, lat, lon) of a table's rows."""
    return read(spark, sf_dir, table).select(F.col(key).alias("id"), lat(key).alias("lat"), lon(key).alias("lon"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "part", "p_partkey").withColumnRenamed("id", "node_id")


def way_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("node_id"), "l_linenumber", "l_suppkey", "l_extendedprice")


def way_nodes(spark: SparkSession, sf_dir: str, refs: DataFrame | None = None) -> DataFrame:
    """The refs of all ways, or of those given, with their places."""
    return ways.ordered(way_refs(spark, sf_dir) if refs is None else refs, ["l_linenumber", "node_id", "l_suppkey", "l_extendedprice"])


def stop_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_nodes whose nodes are pairs of part and supplier: most of them are on one way alone."""
    refs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("node_id"), "l_linenumber", "l_extendedprice")
    return ways.ordered(refs, ["l_linenumber", "node_id", "l_extendedprice"])


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, pos, lat, lon): the events of each user as a line that goes north-east in small steps."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    p = read(spark, sf_dir, "events").select(F.col("user_id").alias("way_id"), pos.alias("pos"), "event_id")
    y = F.col("way_id") * 1000 + F.col("pos") * 37 + F.col("event_id") * 7919 % 61
    x = F.col("pos") * 53 + F.col("event_id") * 104729 % 47
    return p.select("way_id", "pos", y.cast("int").alias("lat"), x.cast("int").alias("lon"))


def track_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, points) of tracks."""
    points = F.sort_array(F.collect_list(F.struct("pos", "lat", "lon")))
    return tracks(spark, sf_dir).groupBy("way_id").agg(F.transform(points, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, points with node_id, status, priority) of orders, as ways over parts."""
    lines = ways.assembled(way_nodes(spark, sf_dir), nodes(spark, sf_dir)).select("way_id", F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), p["node_id"].alias("node_id"))).alias("points"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))
    return lines.join(orders, "way_id")


def sql_point(key: str) -> str:
    return f"CAST({key} * 7919 % 2000003 - 1000000 AS INT) AS lat, CAST({key} * 104729 % 4000037 - 2000000 AS INT) AS lon"


SQL_NODES = f"nodes AS (SELECT p_partkey AS node_id, {sql_point('p_partkey')} FROM part)"
SQL_WAY_NODES = """way_nodes AS (
  SELECT l_orderkey AS way_id, l_partkey AS node_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS pos
  FROM lineitem)"""
SQL_STOP_NODES = """stop_nodes AS (
  SELECT l_orderkey AS way_id, l_partkey * 1000000 + l_suppkey AS node_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey * 1000000 + l_suppkey, l_extendedprice) - 1 AS pos
  FROM lineitem)"""
SQL_TRACKS = """tracks AS (
  SELECT way_id, pos, CAST(way_id * 1000 + pos * 37 + event_id * 7919 % 61 AS INT) AS lat, CAST(pos * 53 + event_id * 104729 % 47 AS INT) AS lon
  FROM (SELECT user_id AS way_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, event_id FROM events))"""
SQL_ROADS = """ends AS (SELECT way_id, min_by(node_id, pos) AS first_node, max_by(node_id, pos) AS last_node, CAST(count(*) AS INT) AS n FROM way_nodes GROUP BY 1),
roads AS (SELECT way_id, first_node, last_node, n, o_orderstatus AS status, CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority FROM ends JOIN orders ON o_orderkey = way_id)"""
SQL_METRES = "6378137.0 * sqrt(pow(radians((lon2 - lon1) * 360.0 / 16777216) * cos(radians((lat1 + lat2) * 360.0 / 16777216 / 2)), 2) + pow(radians((lat2 - lat1) * 360.0 / 16777216), 2))"
SQL_SEGMENTS = f"""segments AS (
  SELECT *, {SQL_METRES} AS metres FROM (
    SELECT way_id, pos, node_id AS from_node, lat AS lat1, lon AS lon1,
           lead(node_id) OVER w AS to_node, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2
    FROM way_nodes JOIN nodes USING (node_id) WINDOW w AS (PARTITION BY way_id ORDER BY pos))
  WHERE to_node IS NOT NULL)"""
