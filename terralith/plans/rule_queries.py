"""Rules, predicates, actions and value filters over part and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators.rules import classify, compiled, parse_expression, without_not, Tokens
from .tables import read

PART_TAGS = {"brand": "p_brand", "type": "p_type", "size": "p_size", "name": "p_name"}


def part_tag(key: str):
    return F.col(PART_TAGS[key]).cast("string") if key in PART_TAGS else F.lit(None).cast("string")


FLAGSHIP = """
# large parts are major features
size>=40 & type~'.*BRASS.*' [0x01 road_class=4 road_speed=6 resolution 16]
size>=40 [0x02 road_class=3 road_speed=5 resolution 18]
size>=20 | brand='Brand#11' {set kind=middle} [0x03 road_class=2 road_speed=3 resolution 20 continue with_actions]
kind=middle & !(size<30) [0x04 resolution 22]
kind!=* & size>5 [0x05 resolution 23]
size=* [0x06]
"""


def flagship(spark, sf_dir):
    return classify(read(spark, sf_dir, "part"), FLAGSHIP, part_tag).groupBy("type", "min_res").agg(F.count(F.lit(1)).alias("n"))


FLAGSHIP_SQL = """
WITH m AS (
  SELECT p_size >= 40 AND p_type LIKE '%BRASS%' AS a, p_size >= 40 AS b,
         p_size >= 20 OR coalesce(p_brand = 'Brand#11', false) AS mid, p_size FROM part),
e AS (
  SELECT unnest(CASE WHEN a THEN [1] WHEN b THEN [2]
                     WHEN mid THEN list_concat([3], CASE WHEN p_size >= 30 THEN [4] ELSE [6] END)
                     WHEN p_size > 5 THEN [5] WHEN p_size IS NOT NULL THEN [6] ELSE [] END) AS type FROM m)
SELECT CAST(type AS INT) AS type, CAST(CASE type WHEN 1 THEN 16 WHEN 2 THEN 18 WHEN 3 THEN 20 WHEN 4 THEN 22 WHEN 5 THEN 23 ELSE 24 END AS INT) AS min_res, count(*) AS n
FROM e GROUP BY ALL
"""

PREDICATES = {
    "p_eq": "size=10", "p_ne": "size!=10", "p_exists": "size=*", "p_missing": "nothing!=*", "p_ne_missing": "nothing!=a",
    "p_lt": "size<25", "p_le": "size<=25", "p_gt": "size>25", "p_ge": "size>=25", "p_lt_text": "brand<12", "p_not_lt_name": "!(name<5)",
    "p_match": "type~'.*STEEL'", "p_no_match": "!(type~'.*STEEL')", "p_and": "size>10 & type~'.*STEEL'", "p_or": "size=1 | size=2 | size=3",
    "p_not_or": "!(size<10 | size>40)", "p_brackets": "(size=1 | size=2) & brand!='Brand#11'", "p_tags": "type!=$brand", "p_not_missing_lt": "!(nothing<5)",
}


def predicates(spark, sf_dir):
    columns = [compiled(without_not(parse_expression(Tokens(e))), part_tag).alias(n) for n, e in PREDICATES.items()]
    return read(spark, sf_dir, "part").select("p_partkey", *columns)


_NUM = "try_cast(nullif(regexp_extract({0}, '[ \\t]*(-?[0-9.]+)', 1), '') AS DOUBLE)"
PREDICATES_SQL = f"""
SELECT p_partkey, p_size = 10 AS p_eq, p_size <> 10 AS p_ne, p_size IS NOT NULL AS p_exists, true AS p_missing, true AS p_ne_missing,
  p_size < 25 AS p_lt, p_size <= 25 AS p_le, p_size > 25 AS p_gt, p_size >= 25 AS p_ge,
  coalesce({_NUM.format('p_brand')} < 12, false) AS p_lt_text, coalesce({_NUM.format('p_name')} >= 5, false) AS p_not_lt_name,
  coalesce(regexp_full_match(p_type, '.*STEEL'), false) AS p_match, NOT coalesce(regexp_full_match(p_type, '.*STEEL'), false) AS p_no_match,
  p_size > 10 AND regexp_full_match(p_type, '.*STEEL') AS p_and, p_size IN (1, 2, 3) AS p_or,
  p_size >= 10 AND p_size <= 40 AS p_not_or, p_size IN (1, 2) AND p_brand <> 'Brand#11' AS p_brackets, p_type <> p_brand AS p_tags, true AS p_not_missing_lt
FROM part
"""

ACTIONS = """
size>30 {set kind=large; add kind=never; set both='${kind}-${size}'}
size<=30 {add kind=small; rename kind size_kind}
size_kind=small {set both='${size_kind}/${nothing}' | '${size_kind}/${brand}'}
both=* {name '${both}'; addlabel '${brand}'; addlabel '${both}'; delete kind}
kind=* [0x01]
brand=* [0x02 default_name 'none']
"""


def actions(spark, sf_dir):
    out = classify(read(spark, sf_dir, "part"), ACTIONS, part_tag)
    return out.select("p_partkey", "ordinal", "type", F.array_join("labels", "|").alias("labels"))


ACTIONS_SQL = """
SELECT p_partkey, CAST(0 AS INT) AS ordinal, CAST(2 AS INT) AS type,
       CASE WHEN p_size > 30 THEN 'large-' || p_size ELSE 'small/' || p_brand END || '|' || p_brand AS labels
FROM part
"""

CONTINUE = """
size>45 [0x10 continue] [0x11 level 1-2]
if (size>20)
then
  size=* {set size=1} [0x12 continue with_actions]
  size<20 [0x13 continue]
else
  size>10 {name '${size|def:x}'} [0x14 continue]
end
brand='Brand#11' {name 'eleven'} [0x15 road_class=2]
type=* [0x16]
<finalize>
brand=* {addlabel '${brand|subst:Brand=>B}'}
"""


def continued(spark, sf_dir):
    out = classify(read(spark, sf_dir, "part"), CONTINUE, part_tag)
    return out.select("p_partkey", "ordinal", "type", "min_res", "max_res", F.array_join("labels", "|").alias("labels"))


CONTINUE_SQL = """
WITH e AS (
  SELECT p_partkey, p_size, p_brand, replace(p_brand, 'Brand', 'B') AS short,
    CASE WHEN p_size > 45 THEN [16, 17] ELSE
      list_concat(CASE WHEN p_size > 20 THEN [18, 19] WHEN p_size > 10 THEN [20] ELSE [] END,
                  CASE WHEN p_brand = 'Brand#11' THEN [21] ELSE [22] END) END AS types FROM part),
x AS (SELECT *, unnest(types) AS type, generate_subscripts(types, 1) - 1 AS ordinal FROM e)
SELECT p_partkey, CAST(ordinal AS INT) AS ordinal, CAST(type AS INT) AS type,
  CAST(CASE WHEN type = 17 THEN 20 ELSE 24 END AS INT) AS min_res, CAST(CASE WHEN type = 17 THEN 22 ELSE 24 END AS INT) AS max_res,
  CASE type WHEN 20 THEN p_size || '|' || short WHEN 21 THEN 'eleven|' || short ELSE short END AS labels
FROM x
"""


def value_filters(spark, sf_dir):
    name, size, brand, kind = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_brand"), F.col("p_type")
    items = F.replace(kind, F.lit(" "), F.lit("; "))
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        text.default(F.nullif(size, F.lit("7")), "seven").alias("f_def"),
        text.converted(size, "m", "ft").alias("f_conv"),
        text.converted(F.concat(size, F.lit(" km")), "m", "mi").alias("f_conv_unit"),
        text.substituted(brand, "Brand", "B").alias("f_subst"),
        text.substituted(brand, "[0-9]", "n", pattern=True).alias("f_regex"),
        text.substring(name, 2, 6).alias("f_substring"),
        text.substring(size, 2).alias("f_too_short"),
        text.part(items, 1).alias("f_part"),
        text.part(items, -1).alias("f_last"),
        text.part(items, 9).alias("f_none"),
        text.parts_before(items, 3).alias("f_before"),
        F.concat(F.lit("#"), brand).alias("f_prefix"),
        text.not_equal(brand, F.lit("Brand#11")).alias("f_not_equal"),
        text.not_contained(F.lit("STEEL"), F.replace(kind, F.lit(" "), F.lit(";"))).alias("f_not_contained"),
        text.highway_symbol(F.concat(F.lit("A "), size), "!").alias("f_symbol"),
        text.squashed(F.concat(F.lit("  "), name, F.lit("   x "))).alias("f_squashed"),
        text.house_number(F.concat(F.lit("No "), size, F.lit("b"))).alias("f_house"),
        text.speed_kmh(F.concat(size, F.lit(" mph"))).alias("f_speed"),
        text.transliterated(F.concat(name, F.lit("éß日")), {"é": "e", "ß": "ss"}).alias("f_ascii"),
    )


VALUE_FILTERS_SQL = r"""
WITH t AS (SELECT *, CAST(p_size AS VARCHAR) AS s, string_split(p_type, ' ') AS items FROM part)
SELECT p_partkey, CASE WHEN s = '7' THEN 'seven' ELSE s END AS f_def,
  CAST(CAST(floor(p_size * (1.0::DOUBLE / 0.3048::DOUBLE) + 0.5) AS BIGINT) AS VARCHAR) AS f_conv,
  CAST(CAST(floor(p_size * (1000.0::DOUBLE / 1609.344::DOUBLE) + 0.5) AS BIGINT) AS VARCHAR) AS f_conv_unit,
  replace(p_brand, 'Brand', 'B') AS f_subst, regexp_replace(p_brand, '[0-9]', 'n', 'g') AS f_regex,
  CASE WHEN length(p_name) >= 2 THEN substring(p_name, 3, 4) END AS f_substring,
  CASE WHEN length(s) >= 2 THEN substring(s, 3) END AS f_too_short,
  items[1] AS f_part, items[-1] AS f_last, items[9] AS f_none,
  CASE WHEN len(items) >= 3 THEN array_to_string(list_transform(items[1:2], lambda x: x || ';'), '') END AS f_before, '#' || p_brand AS f_prefix,
  nullif(p_brand, 'Brand#11') AS f_not_equal, CASE WHEN list_contains(items, 'STEEL') THEN NULL ELSE 'STEEL' END AS f_not_contained,
  '[!]A' || s AS f_symbol, trim(p_name) || ' x' AS f_squashed, CAST(p_size AS BIGINT) AS f_house, p_size * 1.61::DOUBLE AS f_speed, p_name || 'ess?' AS f_ascii
FROM t
"""


def delete_tags(spark, sf_dir):
    from ..sources.osm import keep_tags

    tags = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("note"), F.when(F.col("p_size") % 2 == 0, F.lit("Fix me")).otherwise(F.lit("ok")))
    kept = keep_tags(tags, [("brand", "Brand#11"), ("size", "*")], ignore_fixme=True)
    pairs = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(pairs, ";").alias("tags"))


DELETE_TAGS_SQL = """
SELECT p_partkey, concat_ws(';', CASE WHEN p_brand <> 'Brand#11' THEN 'brand=' || p_brand END, CASE WHEN p_size % 2 <> 0 THEN 'note=ok' END) AS tags FROM part
"""

QUERIES = {
    "rules_flagship": (flagship, FLAGSHIP_SQL),
    "rules_predicates": (predicates, PREDICATES_SQL),
    "rules_actions": (actions, ACTIONS_SQL),
    "rules_continue_if_finalize": (continued, CONTINUE_SQL),
    "value_filters": (value_filters, VALUE_FILTERS_SQL),
    "scan_delete_tags": (delete_tags, DELETE_TAGS_SQL),
}
