"""Name indexes: words of streets, prefixes, sort keys and ranks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import cut


def sort_key(name: Column) -> Column:
    """Letters without accents and case first, then as they are."""
    accents = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1)
    plain = "".join(unicodedata.normalize("NFD", c)[0] for c in accents)
    return F.concat(F.lower(F.translate(name, accents, plain)), F.lit("\x00"), name)


def street_words(streets: DataFrame) -> DataFrame:
    """(street_id, place, partial): the name from each of its words on."""
    words = F.split(F.trim("name"), r"\s+")
    tails = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    return streets.where("name is not null and trim(name) <> ''").select("street_id", F.posexplode(tails).alias("place", "partial"))


def prefix_index(names: DataFrame, length: int) -> DataFrame:
    """(prefix, first_name, n): the first name of each prefix in sort order."""
    key = F.lower(F.rpad("name", length, " "))
    return names.groupBy(key.alias("prefix")).agg(F.min(F.struct(F.lower("name"), "name"))["name"].alias("first_name"), F.count(F.lit(1)).alias("n"))


def ranked_by(names: DataFrame, group: str, name: str) -> DataFrame:
    """Adds ``place``, the dense rank of a name within its group.

    Distinct names are ranked and joined back, so a window holds the names of a group, not its rows.
    """
    distinct = names.select(group, name).distinct()
    places = distinct.withColumn("place", F.dense_rank().over(Window.partitionBy(group).orderBy(name)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (group, name)]
    return names.alias("a").join(places.alias("b"), same).select("a.*", "b.place")


def global_rank(rows: DataFrame, order: list[Column], name: str = "place", dense: bool = False) -> DataFrame:
    """Adds the rank of each row in a total order, from 1, without a window over all rows.

    Rows are sorted by range into partitions; each ranks its own, and the partitions' sizes, one
    number each, are summed up to what comes before. A dense rank is one for each distinct key.
    """
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = rows.repartitionByRange(int(parts), *order).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt)
    within = Window.partitionBy("_part").orderBy(*order)
    ranked = dealt.withColumn("_in", F.dense_rank().over(within) if dense else F.row_number().over(within))
    sizes = ranked.groupBy("_part").agg(F.max("_in").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # One row a partition.
    return ranked.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).drop("_part", "_in", "_before")


def label_table(names: DataFrame) -> DataFrame:
    """Distinct names with the number of uses."""
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("uses"))


#: Street names whose plain words are not indexed. A parameter of ``street_index``.
EXCLUDED: tuple[str, ...] = ()


def collation_keys(name: Column) -> Column:
    """The struct (primary, secondary, tertiary) of a name: letters without accents and case, then accents, then case.

    A strength compares the fields up to its own: PRIMARY the first, SECONDARY two, TERTIARY all.
    """
    bare = F.lower(name)
    return F.struct(plain(bare).alias("primary"), bare.alias("secondary"), name.alias("tertiary"))


def plain(name: Column) -> Column:
    accents = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1)
    return F.translate(name, accents, "".join(unicodedata.normalize("NFD", c)[0] for c in accents))


def compared(a: Column, b: Column, strength: str = "TERTIARY") -> Column:
    """-1, 0 or 1 for two names at a strength: PRIMARY, SECONDARY or TERTIARY."""
    fields = ("primary", "secondary", "tertiary")[: ("PRIMARY", "SECONDARY", "TERTIARY").index(strength) + 1]
    one, two = (F.struct(*[collation_keys(c)[f] for f in fields]) for c in (a, b))
    return F.when(one < two, -1).when(one > two, 1).otherwise(0)


def sorted_table(rows: DataFrame, keys: list[Column], path: str, by: list[str] | None = None) -> None:
    """Writes rows in a total order over several keys of any types; Spark's own external sort takes any size."""
    writer = rows.orderBy(*keys).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def street_index(streets: DataFrame, split: bool = True, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(map_id, name, partial, place, city, n): streets by their names from each word on, one row a map, name, city and word.

    streets has map_id, name and city. Empty names are left out; words listed as excluded start no entry.
    """
    named = streets.where(F.length(F.trim("name")) > 0).groupBy("map_id", "name", "city").agg(F.count(F.lit(1)).alias("n"))
    if not split:
        return named.select("map_id", "name", F.col("name").alias("partial"), F.lit(0).alias("place"), "city", "n")
    words = F.split(F.trim("name"), r"\s+")
    tails = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    out = named.select("map_id", "name", F.posexplode(tails).alias("place", "partial"), "city", "n")
    first = F.split("partial", " ")[0]
    return out.where((F.col("place") == 0) | ~F.lower(first).isin(*excluded)) if excluded else out


def numbered(names: DataFrame, keys: list[str], label: str = "number") -> DataFrame:
    """Distinct rows of the keys with their number from 1 in the order of these, without a window over all rows."""
    return global_rank(names.select(*keys).distinct(), [F.col(k).asc_nulls_first() for k in keys], label)


def by_group(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group.., first, n): for each group its first row in an order, and how many distinct ones it has; as lists of streets by city, region or country."""
    one = rows.select(*group, *order).distinct()
    return one.groupBy(*group).agg(F.min(F.struct(*order)).alias("f"), F.count(F.lit(1)).alias("n")).select(*group, *[F.col(f"f.{c}").alias(f"first_{c}") for c in order], "n")


def type_groups(points: DataFrame) -> DataFrame:
    """(kind, type, n, start): points of interest by type, and where each type starts among those of its kind."""
    n = points.groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("kind").orderBy("type").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def reverse_index(records: DataFrame, key: str, of: str) -> DataFrame:
    """(key, ids, n): for each key the sorted ids of records that refer to it; as many as one map has."""
    return records.groupBy(key).agg(F.array_sort(F.collect_set(of)).alias("ids")).withColumn("n", F.size("ids"))


def string_table(names: DataFrame) -> DataFrame:
    """(name, offset, bytes): distinct names one after the other, each with its UTF-8 bytes and a closing zero.

    Offsets are sums over the names before in order; partitions sum their own and then what comes before.
    """
    one = names.where("name is not null").select("name").distinct().withColumn("bytes", (F.octet_length("name") + 1).cast("long"))
    ranked = global_rank(one, [F.col("name")], "nth")
    block = F.floor((F.col("nth") - 1) / 10_000)
    dealt = ranked.withColumn("block", block)
    sizes = dealt.groupBy("block").agg(F.sum("bytes").alias("total"))
    before = sizes.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    own = F.coalesce(F.sum("bytes").over(Window.partitionBy("block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each ten thousand names.
    return dealt.withColumn("own", own).join(before, "block").select("name", (F.col("before") + F.col("own")).alias("offset"), "bytes")


def limited(rows: DataFrame, group: list[str], order: list[Column], most: int = 255) -> DataFrame:
    """The first ``most`` rows of each group, as many as one division can hold, with their place from 1."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most)
