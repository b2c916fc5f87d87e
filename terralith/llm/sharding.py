"""Sharding by balanced label propagation (DataFrame functions only).

Documents that share a link key (here: equal texts) are neighbours. They start dealt over
the shards by a hash. In each round every linked document looks at how many neighbours each
shard holds and asks to move to the shard with the most; a shard accepts, from the largest
groups down, no more than its quota leaves room for. Documents of one group in one shard are
alike to all this, so the state is a table (group, shard, documents), joined and summed anew
in each round; a group of a third of all rows is some few rows of it. Quotas are read off a
histogram of group sizes, which is bounded. At last every document takes a place by rank:
linked ones first, then the unlinked, which cut no link wherever they go; documents beyond a
shard's quota fill the shards that have room. Counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, col, packed, stored

#: Rounds end once no document moves, or after so many.
SHARDS, ROUNDS = 16, 30
#: Rows that share a rank window on average.
RANK_ROWS = 200_000


def _rank(df: DataFrame, by: list[str], order: list[Column], deal: Column, name: str) -> DataFrame:
    """Adds a rank, gapless from 0 within each value of ``by`` and in the order of ``deal``.

    ``deal`` gives an int that splits a value's rows among tasks; sizes are summed to offsets.
    """
    dealt = df.withColumn("deal", deal)
    sizes = dealt.groupBy(*by, "deal").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    dealt = dealt.withColumn("within", F.row_number().over(Window.partitionBy(*by, "deal").orderBy(*order)) - 1)
    return dealt.join(offsets, [*by, "deal"]).withColumn(name, F.col("before") + F.col("within")).drop("before", "within", "deal")


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _dealt(key: Column, modulus: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(modulus)).cast("int")


def _round(state: DataFrame, quotas: list[int], number: int) -> tuple[DataFrame, int]:
    """One round over (group, shard, n); returns the new state and the documents moved."""
    shards = len(quotas)
    per_group = Window.partitionBy("group").orderBy(F.col("n").desc(), F.pmod(F.xxhash64("group", "shard"), F.lit(shards * 64)), "shard")
    # A group has at most one row for each shard, so its window holds that many rows.
    ranked = state.withColumn("place", F.row_number().over(per_group)).withColumn("size", F.sum("n").over(Window.partitionBy("group")))
    ranked = ranked.withColumn("target", F.first("shard").over(per_group)).withColumn("most", F.max("n").over(Window.partitionBy("group")))
    ranked = stored(ranked.withColumn("class", F.log2("size").cast("int")), "propagation")

    # What stays and who asks, by shard and size class: a bounded histogram.
    asked = ranked.groupBy("target", "class").agg(F.sum(F.when(F.col("place") == 1, F.col("n")).otherwise(0)).alias("stays"), F.sum(F.when(F.col("place") > 1, F.col("n")).otherwise(0)).alias("asks")).collect()
    room = list(quotas)
    for r in asked:
        room[r["target"]] -= r["stays"]
    share: list[tuple[int, int, float]] = []
    for r in sorted(asked, key=lambda r: -r["class"]):
        if r["asks"]:
            accepted = max(0, min(r["asks"], room[r["target"]]))
            room[r["target"]] -= accepted
            share.append((r["target"], r["class"], accepted / r["asks"]))
    spark = state.sparkSession
    accepted = F.broadcast(spark.createDataFrame(share, "target int, class int, share double"))
    moving = ranked.join(accepted, ["target", "class"], "left")
    # Large holdings move in part, small ones as a whole or not at all.
    lot = F.pmod(F.xxhash64("group", "shard", F.lit(number)), F.lit(1 << 20)) / (1 << 20) < F.col("share")
    some = F.when(F.col("n") >= 256, F.floor(F.col("n") * F.col("share"))).otherwise(F.when(lot, F.col("n")).otherwise(F.lit(0)))
    moves = F.when((F.col("place") > 1) & F.col("share").isNotNull(), some).otherwise(F.lit(0))
    moving = moving.withColumn("moves", moves.cast("long")).select("group", "shard", "target", "n", "moves")
    parts = moving.select("group", F.explode(F.array(F.struct("shard", (F.col("n") - F.col("moves")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("moves").alias("n")))).alias("p"))
    new = stored(parts.select("group", "p.shard", "p.n").where("n > 0").groupBy("group", "shard").agg(F.sum("n").alias("n")), "propagation")
    moved = moving.agg(F.coalesce(F.sum("moves"), F.lit(0))).first()[0]
    return new, moved


def assign(docs: DataFrame, link: Column, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``shard`` and ``slot`` to (id, link key) rows; counts of shards differ by one at most.

    docs needs a column ``doc_id``; ``link`` must be an expression over docs' columns, and
    rows with an equal one are neighbours.
    """
    rows = stored(docs.withColumn("group", link), "rows")
    n = rows.count()
    quotas = _quotas(n, shards)
    deals = n // RANK_ROWS + 1
    start = _dealt(F.struct("doc_id", F.lit("start")), shards)
    state = rows.withColumn("shard", start).groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    linked = state.groupBy("group").agg(F.sum("n").alias("size")).where("size > 1").select("group")
    state = stored(state.join(linked, "group", "left_semi"), "propagation")
    for number in range(rounds):
        state, moved = _round(state, quotas, number)
        if not moved:
            break

    # Rank within the group, then the shard whose share of the group covers that rank.
    upto = F.sum("n").over(Window.partitionBy("group").orderBy("shard"))
    spans = state.withColumn("upto", upto).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("spans"), F.sum("n").alias("size"))  # one for each shard at most
    mine = rows.join(spans, "group", "left_semi")
    mine = _rank(mine, ["group"], [F.col("doc_id")], _dealt(F.struct("doc_id"), deals), "rank").join(spans, "group")
    mine = mine.withColumn("shard", F.element_at(F.filter("spans", lambda s: s["upto"] > F.col("rank")), 1)["shard"]).drop("spans", "rank")
    alone = rows.join(spans, "group", "left_anti").withColumn("size", F.lit(1).cast("long")).withColumn("shard", start)
    placed = stored(mine.unionByName(alone), "placed")

    # Linked documents come first within a shard, large groups before small ones.
    level = F.lit(64) - F.log2("size").cast("int")
    spread = max(1, math.ceil(deals / shards))
    by_level = level * spread + _dealt(F.struct("doc_id", F.lit("place")), spread)
    placed = _rank(placed, ["shard"], [F.col("group"), F.col("doc_id")], by_level, "at")
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("shard") + 1)
    placed = stored(placed.withColumn("over", F.col("at") >= quota), "placed")

    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    spans_left, begin = [], 0
    for s, q in enumerate(quotas):
        if (free := q - counts.get(s, 0)) > 0:
            spans_left.append((s, begin, counts.get(s, 0)))
            begin += free
    stay = placed.where("not over").withColumn("slot", F.col("at"))
    # Copies of one text stay neighbours on their way to a shard with room.
    group_deal = _dealt(F.struct("group"), deals) * 8 + _dealt(F.struct("doc_id", F.lit("over")), 8)
    move = _rank(placed.where("over").withColumn("all", F.lit(0)), ["all"], [F.col("group"), F.col("doc_id")], group_deal, "at_all").drop("all")
    new_shard, new_slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s, first, used in spans_left:
        new_shard = F.when(F.col("at_all") >= first, F.lit(s)).otherwise(new_shard)
        new_slot = F.when(F.col("at_all") >= first, F.col("at_all") - first + used).otherwise(new_slot)
    move = move.withColumn("shard", new_shard).withColumn("slot", new_slot.cast("long")).drop("at_all")
    return stay.unionByName(move).drop("at", "over", "size", "group")


def cut_links(placed: DataFrame) -> int:
    """The links (pairs of rows with an equal ``group``) whose ends are in different shards."""
    held = placed.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    return held.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2), F.lit(0.0)).cast("long")).first()[0]


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    size is the UTF-8 bytes of the text plus 1. The law is ``rows``: the shards' counts
    differ by one at most. Equal texts are linked.

    Defined cases: a null text has 0 bytes and the crc32 of an empty one, but is linked with
    null texts alone; rows without doc_id and repeated rows take a place each; ties go by
    hash; an empty table gives an empty result; further columns are ignored.
    """
    text = col("text")
    own = docs.select(
        col("doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size_bytes"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.struct(text.isNull().alias("none"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")).alias("key"),
    )
    out = assign(own, F.col("key"), shards, rounds)
    return out.select("doc_id", F.col("size_bytes").alias("size"), "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(caller_row, shard, slot): every row of the caller with its place."""
    text = F.col(ROW).getField("text")
    rows = docs.select(packed(docs)).withColumn("doc_id", F.col(ROW).getField("doc_id"))
    key = F.struct(text.isNull().alias("none"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))
    return assign(rows, key, shards).select(ROW, "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
