"""Picks a reader by the name of a file, made-up elements for tests, and grids of heights."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, osm

#: Height of a place that was not measured. Fixed value.
VOID = -32768


def bare_name(path: str) -> str:
    """A file's name in lower case without the endings of compression."""
    return re.sub(r"\.(gz|bz2)$", "", path.rsplit("/", 1)[-1].lower())


def _polish(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {"sections": osm.read_polish(spark, path)}


#: Readers by the ending of a name, the first that fits; XML takes what is left. More can be put in front.
READERS: list[tuple[str, Callable[[SparkSession, str], dict[str, DataFrame]]]] = [
    (r"\.mp$", _polish),
    (r"^test-map:", lambda spark, path: made_up(spark, path)),
    (r"\.pbf$", lambda spark, path: binary.tables_of(binary.read_pbf(spark, path))),
    (r"\.o5m$", lambda spark, path: binary.tables_of(binary.read_o5m(spark, path))),
    (r"", lambda spark, path: osm.read_xml(spark, path)),
]


def reader_of(path: str) -> Callable[[SparkSession, str], dict[str, DataFrame]]:
    return next(read for pattern, read in READERS if re.search(pattern, path if path.startswith("test-map:") else bare_name(path)))


def read_map(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a map file in any format that is known."""
    return reader_of(path)(spark, path)


def made_up(spark: SparkSession, name: str) -> dict[str, DataFrame]:
    """A grid of nodes and the ways along its rows; ``test-map:12`` has 12 by 12 nodes."""
    size = int(name.partition(":")[2] or 10)
    i = F.col("id")
    nodes = spark.range(size * size).select(i, (F.floor(i / size) * 0.001).alias("lat"), ((i % size) * 0.001).alias("lon"), F.create_map(F.lit("n"), i.cast("string")).alias("tags"))
    ways = spark.range(size).select(i, F.create_map(F.lit("highway"), F.lit("test"), F.lit("name"), F.concat(F.lit("row "), i)).alias("tags"))
    way_nodes = nodes.select(F.floor(i / size).alias("way_id"), (i % size).cast("int").alias("pos"), i.alias("node_id"))
    return {"nodes": nodes, "ways": ways, "way_nodes": way_nodes}


def read_heights(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, res, row, heights): the rows of height files named as N12E034.hgt, from the south; voids are null.

    A file is a square of big-endian numbers from the north-west, whose last row and column are those of the
    next file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                m = re.search(r"([NSns])(\d{2})([EWew])(\d{3})\.hgt$", p)
                if not m:
                    raise ValueError(f"{p} does not tell its place")
                lat, lon = int(m[2]) * (1 if m[1] in "Nn" else -1), int(m[4]) * (1 if m[3] in "Ee" else -1)
                side = int((len(content) // 2) ** 0.5)
                if side * side * 2 != len(content):
                    raise ValueError(f"{p} is not a square")
                grid = np.frombuffer(content, dtype=">i2").reshape(side, side)[::-1]
                rows = [[None if h == VOID else int(h) for h in row] for row in grid]
                yield pd.DataFrame({"lat": lat, "lon": lon, "res": side - 1, "row": np.arange(side), "heights": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "lat int, lon int, res int, row int, heights array<int>")


def heights_at(points: DataFrame, grid: DataFrame, outside: int = 0) -> DataFrame:
    """points (id, lat, lon in degrees) with ``height``, by the four heights around; outside of all files it is ``outside``."""
    from ..functions import geo

    spot = points.withColumn("glat", F.floor("lat").cast("int")).withColumn("glon", F.floor("lon").cast("int"))
    res = grid.select(F.col("lat").alias("glat"), F.col("lon").alias("glon"), "res").distinct()
    spot = spot.join(res, ["glat", "glon"], "left")
    y, x = (F.col("lat") - F.col("glat")) * F.col("res"), (F.col("lon") - F.col("glon")) * F.col("res")
    spot = spot.withColumn("row", F.floor(y).cast("int")).withColumn("col", F.floor(x).cast("int")).withColumn("qy", y - F.floor(y)).withColumn("qx", x - F.floor(x))
    side = lambda name, step: grid.select(F.col("lat").alias("glat"), F.col("lon").alias("glon"), (F.col("row") - step).alias("row"), F.col("heights").alias(name))
    met = spot.join(side("low", 0), ["glat", "glon", "row"], "left").join(side("high", 1), ["glat", "glon", "row"], "left")
    at = lambda c, k: F.get(F.col(c), F.col("col") + k)
    h = geo.bilinear(at("low", 0), at("low", 1), at("high", 0), at("high", 1), F.col("qx"), F.col("qy"))
    return met.select("id", F.when(F.col("res").isNull(), F.lit(outside)).otherwise(h).alias("height"))


def bicubic(grid: Column, x: Column, y: Column) -> Column:
    """A height from sixteen around it (an array of four rows of four, from the south-west) by Catmull-Rom splines; null if one is void."""

    def spline(p: list[Column], t: Column) -> Column:
        a, b, c, d = p
        return b + 0.5 * t * (c - a + t * (2.0 * a - 5.0 * b + 4.0 * c - d + t * (3.0 * (b - c) + d - a)))

    rows = [spline([grid[i][j].cast("double") for j in range(4)], x) for i in range(4)]
    return F.floor(spline(rows, y) + 0.5).cast("int")


def partitioned_boundaries(boundaries: DataFrame, path: str, cell: int) -> None:
    """Writes boundaries (.., ring) by raster cell, so that a reader of a region opens its cells alone."""
    from ..functions import geo
    from ..operators.spatial import cells_of

    dealt = boundaries.withColumn("c", F.explode(cells_of(geo.bounds(F.col("ring")), cell)))
    dealt.withColumn("cx", F.col("c.cx")).withColumn("cy", F.col("c.cy")).drop("c").write.mode("overwrite").partitionBy("cx", "cy").parquet(path)


def read_boundaries(spark: SparkSession, path: str, box: tuple[int, int, int, int], cell: int) -> DataFrame:
    """The boundaries whose cells meet a box, each once; other cells' files are not opened."""
    low = lambda v: v // cell
    found = spark.read.parquet(path).where(F.col("cx").between(low(box[1]), low(box[3])) & F.col("cy").between(low(box[0]), low(box[2])))
    return found.drop("cx", "cy").dropDuplicates(["id"])
