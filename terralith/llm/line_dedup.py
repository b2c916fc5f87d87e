"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

The hashes of the long lines of each text are written once. Documents are then taken in
batches of falling doc_id. Each batch's line hashes are merge-anti-joined with those of the
runs that are settled, that is, already found in enough documents, and what is left is added
as a sorted run of (hash, documents, largest doc_id). Once a level holds ``fanout`` runs they
are compacted into one run of the next level, which settles keys whose counts now add up.
Because the batches fall in doc_id, the largest holder of a key is known once any run has it,
so a settled key need not be counted any more. Counts and largest holders of a key that stand
in several runs come together when closing merges all runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, col, marks_of, may_be_in, packed, stored, unpacked

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hot keys are broadcast: at most so many, the commonest ones among the lines of every SAMPLE-th document.
HOT_KEYS, SAMPLE = 10_000, 1000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """A line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def hash_of(key: Column, min_chars: int) -> Column:
    """128 bits of hash as two longs, or null for a key too short to count."""
    pair = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    return F.when(F.length(key) >= min_chars, pair)


def hashes_of(text: Column, min_chars: int) -> Column:
    """One hash, or null, for each line."""
    keys = F.transform(lines_of(text), key_of)
    return F.transform(keys, lambda k: hash_of(k, min_chars))


def hash_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, hashes) of the rows of (doc_id, text) that have a long line; hashes as ``hashes_of`` gives."""
    hashes = hashes_of(F.col("text"), min_chars)
    rows = docs.where("doc_id is not null").select("doc_id", text_hash(F.col("text")).alias("text_hash"), hashes.alias("hashes"))
    return rows.where(F.exists("hashes", lambda h: h.isNotNull()))


def text_hash(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.lit(2), text)


class LineRuns:
    """The levels of sorted runs; a run's settled keys are in a folder of their own."""

    def __init__(self, min_docs: int = 5, fanout: int = 2):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of (doc_id, hashes) whose doc_ids are all below those of earlier batches."""
        lines = batch.select("doc_id", F.explode(F.array_distinct("hashes")).alias("h")).where("h is not null").select("doc_id", "h.h1", "h.h2")
        for run in (run for level in self.levels for run in level):
            # Spark broadcasts the settled keys if their files are small, else it merges.
            lines = lines.join(run.where("settled").select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._push(0, self._written(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))))

    def _written(self, run: DataFrame) -> DataFrame:
        run = run.withColumn("settled", F.col("n_docs") >= self.min_docs)
        return stored(run.sortWithinPartitions("settled", "h1", "h2"), "line-run", by="settled")

    def _push(self, level: int, run: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._written(self._merged(runs)))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        union = reduce(DataFrame.unionByName, runs)
        return union.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def close(self) -> DataFrame:
        """(h1, h2, n_docs, last_doc) of all keys in enough documents, by merging all runs.

        n_docs of a key does not count the documents that came after it was settled.
        """
        return self._merged([run for level in self.levels for run in level]).where(F.col("n_docs") >= self.min_docs)


def _batch_of(doc_id: Column, cuts: list) -> Column:
    """The batch of a doc_id: the number of cuts above it, so that batches fall in doc_id."""
    return reduce(lambda n, cut: n + (doc_id < cut).cast("int"), cuts, F.lit(0))


def dropped_places(hashes: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, text_hash, places): the lines that go, by their places from 0."""
    frequent = stored(frequent.select("h1", "h2", "last_doc"), "frequent-lines")
    lines = hashes.select("doc_id", "text_hash", F.posexplode("hashes").alias("place", "h")).where("h is not null").select("doc_id", "text_hash", "place", "h.h1", "h.h2")
    # The sample decides only which way a key is joined; every line is joined one way or the other.
    seen = lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    commonest = F.broadcast(stored(seen.orderBy(F.desc("n"), "h1", "h2").limit(HOT_KEYS).select("h1", "h2"), "hot-lines"))
    hot, cold = F.broadcast(frequent.join(commonest, ["h1", "h2"], "left_semi")), frequent.join(commonest, ["h1", "h2"], "left_anti")
    rest = lines.join(commonest, ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"])
    hits = lines.join(hot, ["h1", "h2"]).unionByName(rest).where("doc_id <> last_doc")
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 8, fanout: int = 2) -> DataFrame:
    """Drops repeated lines, except in the document of largest doc_id that holds them.

    A line's key is the line without blanks at both ends and with A-Z in lower case. Keys of
    at least ``min_chars`` code points that are in at least ``min_docs`` documents lose all
    their lines in every other document. Returns ``caller_row`` (the whole input row),
    n_lines, n_dropped and kept_text.

    Defined cases: a null or empty text is one empty line; a row without doc_id is not
    counted and loses nothing; repeated rows with one doc_id count once each and are all
    holders of their lines; a line repeated within its largest holder stays as often as it
    is there; an empty table gives an empty result; further columns of any name pass through.
    """
    own = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    cuts = own.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    hashes = stored(hash_table(own, min_chars).withColumn("batch", _batch_of(F.col("doc_id"), cuts)), "line-hashes", by="batch")
    runs = LineRuns(min_docs, fanout)
    for number in range(len(cuts) + 1):
        runs.add(hashes.where(F.col("batch") == number))
    dropped = stored(dropped_places(hashes, runs.close()), "dropped-lines")

    rows = docs.select(packed(docs)).withColumn("doc_id", F.col(ROW).getField("doc_id")).withColumn("text_hash", text_hash(F.col(ROW).getField("text")))
    # Rows that surely lose nothing stay where they are.
    rows = may_be_in(rows, marks_of(dropped, "doc_id", "text_hash"), "doc_id", "text_hash")
    whole = rows.where("not may_be").withColumn("places", F.lit(None).cast("array<int>"))
    rows = rows.where("may_be").join(dropped.hint("merge"), ["doc_id", "text_hash"], "left").unionByName(whole).withColumn("lines", lines_of(F.col(ROW).getField("text")))
    # array_except works with a hash set, so the time for a text grows with its lines and no faster.
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("places", F.array().cast("array<int>")))
    kept = F.when(F.col("places").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    rows = rows.select(ROW, F.col("lines"), kept.alias("kept"))
    return rows.select(ROW, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.concat_ws("\n", "kept").alias("kept_text"))


def dedup_stage(docs: DataFrame, **options) -> DataFrame:
    """The documents with their kept texts; all rows stay, n_chars follows the text."""
    out = dedup_lines(docs, **options)
    unchanged = F.col("n_dropped") == 0
    text = F.when(unchanged, F.col(ROW).getField("text")).otherwise(F.col("kept_text"))
    replaced = {"text": text}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(unchanged, F.col(ROW).getField("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return unpacked(out, docs.columns, **replaced)


def query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_lines(docs)
    return out.select(F.col(ROW).getField("doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, frequent.k IS NOT NULL AND doc_id <> last_doc AS gone
  FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
