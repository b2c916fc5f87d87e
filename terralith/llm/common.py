"""Shared helpers: the cluster's shared folder, working tables and row packing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the struct that carries a caller's row through an operator, so that no own column can clash with it.
ROW = "caller_row"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Only a session on a single machine (tests) may leave that
    unset: a temporary folder is made and set for it. On a cluster that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terralith-")
        sc.setCheckpointDir(base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/terralith/{label}-{uuid.uuid4().hex}"


#: Paths of the working tables that nothing has deleted yet.
_WORKING: list[str] = []


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes a working table to the shared folder and reads it back, which cuts the lineage.

    The files outlive any executor, so a later stage never recomputes what came before. ``by``
    names a column that gets a folder of its own for each value, so that a filter on it reads
    just these. Results are read from working tables, so they stay until ``delete_since``.
    """
    path = new_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _WORKING.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def adopted(df: DataFrame, path: str) -> DataFrame:
    """df, whose files at the path are a working table from now on."""
    _WORKING.append(path)
    return df


def working_mark() -> int:
    return len(_WORKING)


def delete_since(spark: SparkSession, mark: int) -> None:
    """Deletes the working tables written since the mark, once what was made of them is written."""
    while len(_WORKING) > mark:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WORKING.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a mark table; with n ids about n in so many others are taken for marked.
MARK_BITS = 25


def _mark(columns: tuple) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(F.lit(4), *columns), F.lit(1 << MARK_BITS))
    return F.shiftright(h, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))


def marks_of(ids: DataFrame, *columns: str) -> DataFrame:
    """(word, bits): a bit for the hash of each row's columns; 2**(MARK_BITS - 6) rows at most, whatever the input."""
    word, bit = _mark(columns)
    return stored(ids.select(word.alias("mark_word"), bit.alias("mark_bit")).groupBy("mark_word").agg(F.bit_or("mark_bit").alias("mark_bits")), "marks")


def may_be_in(df: DataFrame, marks: DataFrame, *columns: str) -> DataFrame:
    """df with ``may_be``: false only for rows whose columns are surely not among the marked ids.

    So a join with few ids needs to shuffle few of the rows; the marks are broadcast.
    """
    word, bit = _mark(columns)
    out = df.withColumn("mark_word", word).join(F.broadcast(marks), "mark_word", "left")
    return out.withColumn("may_be", F.coalesce(F.col("mark_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("mark_word", "mark_bits")


#: A key of over a HOT-th of all rows is hot: there are fewer than HOT of them.
HOT = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, n_left: int, spread: str) -> DataFrame:
    """left with the columns of right by a key that right has once, null where it has none.

    right also has n, the number of left's rows with the key. Rows of hot keys meet broadcast rows; in the
    join by shuffle they are dealt by the column ``spread``, so no task gets all rows of a key.
    """
    names = [c for c in right.columns if c not in (key, "n")]
    value = F.struct(*names)
    is_hot = F.col("n") * HOT > n_left
    hot = F.broadcast(right.where(is_hot).select(key, value.alias("hot_value")))
    cold = right.where(~is_hot).select(F.col(key).cast("string").alias("join_key"), value.alias("cold_value"))
    out = left.join(hot, key, "left")
    out = out.withColumn("join_key", F.coalesce(F.when(F.col("hot_value").isNull(), F.col(key).cast("string")), F.col(spread).cast("string")))
    out = out.join(cold, "join_key", "left").withColumn("value", F.coalesce("hot_value", "cold_value"))
    return out.select(*left.columns, *[F.col(f"value.{c}").alias(c) for c in names])


def col(name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """The whole row of the caller as one struct."""
    return F.struct(*[col(c) for c in docs.columns]).alias(ROW)


def unpacked(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The caller's columns, in their order; replaced ones take the given expressions."""
    row = F.col(ROW)
    return df.select(*[replaced.get(c, row.getField(c)).alias(c) for c in columns])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds an Arrow batch, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def remainder_is_training(doc_id: Column) -> Column:
    """True for rows whose labels may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; false for a missing doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
