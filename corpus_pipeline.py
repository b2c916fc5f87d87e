"""The corpus pipeline: five operators of terralith.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralith.llm import decontaminate, line_dedup, near_dedup, packing, quality
from terralith.llm.common import adopted, delete_since, new_path, read, working_mark


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every document stays."""
    return line_dedup.dedup_stage(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of the documents into sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier, the tokenizer or the packing; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep.

    A stage's working tables, and the documents it read, are deleted once its own rows are written. Empty tables
    give an empty result; nulls and further columns are treated as each operator's docstring says.
    """
    docs, mark = read(spark, sf_dir, "documents"), working_mark()
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name}")
        made.write.option("compression", "zstd").parquet(path)
        delete_since(spark, mark)
        docs = adopted(spark.read.schema(made.schema).parquet(path), path)
    return docs
