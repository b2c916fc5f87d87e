"""Name indexes, aggregates and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import names, ways
from .tables import read


def _streets(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("street_id"), F.col("p_name").alias("name"), "p_brand", "p_size")


def words(spark, sf_dir):
    return names.street_words(_streets(spark, sf_dir)).groupBy("partial").agg(F.countDistinct("street_id").alias("n"), F.min("place").alias("place"))


WORDS_SQL = r"""
WITH s AS (SELECT p_partkey, regexp_split_to_array(trim(p_name), '\s+') AS w FROM part WHERE trim(p_name) <> ''),
x AS (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM s)
SELECT array_to_string(w[i:], ' ') AS partial, count(DISTINCT p_partkey) AS n, CAST(min(i) - 1 AS INT) AS place FROM x GROUP BY 1
"""


def prefixes(spark, sf_dir):
    return names.prefix_index(_streets(spark, sf_dir).select("name"), 4)


PREFIXES_SQL = "SELECT lower(rpad(p_name, 4, ' ')) AS prefix, (min({'a': lower(p_name), 'b': p_name})).b AS first_name, count(*) AS n FROM part GROUP BY 1"


def ranks(spark, sf_dir):
    out = names.ranked_by(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")
    return out.select("c_custkey", "c_nationkey", "place")


RANKS_SQL = "SELECT c_custkey, c_nationkey, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INT) AS place FROM customer"


def sort_keys(spark, sf_dir):
    d = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("É")).otherwise(F.lit("e")), F.col("p_name")).alias("name"))
    return d.select("p_partkey", F.hex(F.encode(names.sort_key(F.col("name")), "UTF-8")).alias("sort_key"))


SORT_KEYS_SQL = """WITH n AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'É' ELSE 'e' END || p_name AS name FROM part)
SELECT p_partkey, hex(encode(lower(replace(name, 'É', 'E')))) || '00' || hex(encode(name)) AS sort_key FROM n"""


def labels(spark, sf_dir):
    return names.label_table(read(spark, sf_dir, "part").select(F.col("p_type").alias("name")))


LABELS_SQL = "SELECT p_type AS name, count(*) AS uses FROM part GROUP BY 1"


def overview(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.groupBy("p_type").agg(F.min(24 - F.col("p_size") % 8).alias("min_res"), F.min("p_partkey").alias("first_id"))


OVERVIEW_SQL = "SELECT p_type, CAST(min(24 - p_size % 8) AS INT) AS min_res, min(p_partkey) AS first_id FROM part GROUP BY 1"


def duplicates(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    return ways.first_of_duplicates(p, ["p_type", "p_brand"], ["p_partkey"])


DUPLICATES_SQL = "SELECT p_partkey, p_type, p_brand, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) = 1"


def ranges(spark, sf_dir):
    h = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("road"), F.col("o_orderstatus").alias("side"), F.col("o_orderkey").alias("number"))
    return ways.number_ranges(h)


RANGES_SQL = """SELECT o_custkey AS road, o_orderstatus AS side, CASE WHEN sum(o_orderkey % 2) = 0 THEN 'E' WHEN sum(o_orderkey % 2) = count(*) THEN 'O' ELSE 'B' END AS style,
  min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders GROUP BY 1, 2"""


def interpolation(spark, sf_dir):
    ends = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("road"), F.col("s_nationkey").alias("low"), (F.col("s_nationkey") + 10).alias("high"), F.when(F.col("s_suppkey") % 3 == 0, "B").otherwise("E").alias("style"))
    return ways.interpolated(ends)


INTERPOLATION_SQL = "SELECT s_suppkey AS road, CAST(unnest(range(s_nationkey, s_nationkey + 11, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END)) AS BIGINT) AS number FROM supplier"


def side(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return ways.driving_side(o.select(F.when(F.col("o_orderstatus") == "O", "left").when(F.col("o_orderstatus") == "F", "right").alias("side")))


SIDE_SQL = "SELECT l AS n_left, r AS n_right, u AS n_unknown, CASE WHEN l > r + u THEN 'left' WHEN r > l + u THEN 'right' ELSE 'right' END AS side FROM (SELECT count(*) FILTER (o_orderstatus = 'O') AS l, count(*) FILTER (o_orderstatus = 'F') AS r, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS u FROM orders)"


def places(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    c = c.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.min("c_name").alias("first_name"))


PLACES_SQL = "SELECT r_name, n_name, count(*) AS n, min(c_name) AS first_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"


def boundary_sets(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_acctbal < -600").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k", "full_outer").select("k", "a", "b", F.when(F.col("b").isNull(), "first").when(F.col("a").isNull(), "second").otherwise("both").alias("found_in"))


BOUNDARY_SETS_SQL = """WITH a AS (SELECT c_nationkey AS k, count(*) AS a FROM customer WHERE c_acctbal < -600 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS b FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT k, a, b, CASE WHEN b IS NULL THEN 'first' WHEN a IS NULL THEN 'second' ELSE 'both' END AS found_in FROM a FULL OUTER JOIN b USING (k)"""


def overlays(spark, sf_dir):
    table = F.create_map(F.lit("O"), F.array(F.lit(1), F.lit(33)), F.lit("F"), F.array(F.lit(2)))
    kinds = F.coalesce(F.try_element_at(table, F.col("o_orderstatus")), F.array(F.lit(9)))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode(kinds).alias("type"))


OVERLAYS_SQL = "SELECT o_orderkey, CAST(unnest(CASE o_orderstatus WHEN 'O' THEN [1, 33] WHEN 'F' THEN [2] ELSE [9] END) AS INT) AS type FROM orders"


def catalogue(spark, sf_dir):
    """Partial results of each tile, summed over tiles, as combiners do."""
    tiles = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 16).alias("tile"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last"))
    return tiles.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("n"), F.max("last").alias("last"))


CATALOGUE_SQL = "SELECT l_returnflag, count(DISTINCT l_partkey % 16) AS tiles, CAST(count(*) AS BIGINT) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1"

QUERIES = {
    "index_street_words": (words, WORDS_SQL),
    "index_prefixes": (prefixes, PREFIXES_SQL),
    "index_ranks": (ranks, RANKS_SQL),
    "index_sort_keys": (sort_keys, SORT_KEYS_SQL),
    "index_labels": (labels, LABELS_SQL),
    "index_places": (places, PLACES_SQL),
    "overview_resolutions": (overview, OVERVIEW_SQL),
    "duplicate_points": (duplicates, DUPLICATES_SQL),
    "house_number_ranges": (ranges, RANGES_SQL),
    "house_interpolation": (interpolation, INTERPOLATION_SQL),
    "driving_side_vote": (side, SIDE_SQL),
    "boundary_sets": (boundary_sets, BOUNDARY_SETS_SQL),
    "line_overlays": (overlays, OVERLAYS_SQL),
    "tile_catalogue": (catalogue, CATALOGUE_SQL),
}
