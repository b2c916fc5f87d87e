"""Cutting lineage: iterative operators write their state to the folder that a cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, read from files in ``spark.checkpoint.dir``, so that no later round recomputes them.

    Only a session on a single machine may leave that folder unset; it then gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="terralith-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by columns to as many tasks as a shuffle has: for work in Python that costs much for few bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)
