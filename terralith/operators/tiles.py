"""Areas of a map at its levels, and the centres that its routing is dealt to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import lines
from .names import global_rank
from .work import cut

#: Bounds of a routing centre: width, roads, nodes outside and bytes of nodes. Fixed values.
CENTRE_WIDTH, CENTRE_ROADS, CENTRE_OUTSIDE, CENTRE_BYTES = 0xF800, 0xF8, 0xFE, 0x2000
#: Bytes that an area holds at most, and from which one is split if it is wide. Fixed values.
MOST_BYTES, WANTED_BYTES = 0xFFF8, 0x3FFF


def at_level(features: DataFrame, resolution: int, most: int | None = None) -> DataFrame:
    """The features that a level shows; lines and shapes over ``most`` units wide or high are cut first, pieces counted in ``piece``.

    features has kind, min_res, max_res and points.
    """
    shown = features.where((F.col("min_res") <= resolution) & (F.col("max_res") >= resolution))
    if most is None:
        return shown.withColumn("piece", F.lit(0))
    large = (F.col("kind") == "line") & (lines.dimension(F.col("points")) >= most)
    of_type = features.schema["points"].dataType.simpleString()
    rest = shown.where(~large).withColumn("piece", F.lit(0))
    pieces = shown.where(large).select(*[c for c in features.columns if c != "points"], F.posexplode(lines.split_by_size(most - 10, of_type)("points")).alias("piece", "points"))
    return rest.unionByName(pieces.select(*rest.columns))


def sized_areas(features: DataFrame, side: int, least: int, most: int = WANTED_BYTES) -> DataFrame:
    """(depth, cx, cy, n, bytes): square areas halved on both sides until their features take ``most`` bytes at most.

    features has lat, lon (its place) and bytes. Sums are made once, at the finest squares, and rolled up.
    """
    last = (side // least).bit_length() - 1
    cell = lambda c: F.floor(F.col(c) / least).cast("long")
    finest = features.groupBy(cell("lon").alias("cx"), cell("lat").alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    each = finest.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(last))))
    up = lambda c: F.expr(f"shiftright({c}, {last} - depth)")
    sums = each.groupBy("depth", up("cx").alias("cx"), up("cy").alias("cy")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    above = F.sum("bytes").over(Window.partitionBy("depth", F.shiftright("cx", 1), F.shiftright("cy", 1)))
    opened = (F.col("depth") == 0) | (F.col("above") > most)
    return sums.withColumn("above", above).where(opened & ((F.col("bytes") <= most) | (F.col("depth") == last))).drop("above")


def level_pyramid(features: DataFrame, levels: dict[int, int], side: int, least: int, most: int = WANTED_BYTES) -> DataFrame:
    """(level, depth, cx, cy, n, bytes): the areas of every level, from the features that it shows.

    features has lat, lon, min_res, max_res, kind and points; sizes are those expected at the level's resolution.
    """
    out = None
    for level, resolution in sorted(levels.items(), reverse=True):
        shown = at_level(features, resolution).withColumn("bytes", F.when(F.col("kind") == "point", 9).when(F.col("kind") == "line", lines.estimated_size("line", F.col("points"), resolution)).otherwise(lines.estimated_size("shape", F.col("points"), resolution)))
        own = sized_areas(shown.where("bytes > 0"), side, least, most).select(F.lit(level).alias("level"), "depth", "cx", "cy", "n", "bytes")
        out = own if out is None else out.unionByName(own)
    return out


def drawn_first(shapes: DataFrame, draw_level: Column | None = None) -> DataFrame:
    """shapes (points, ..) with ``area2`` and ``place``: by falling area; a draw level from 1 to 100 stands in for the area, high ones first."""
    area = F.abs(geo.signed_area(F.col("points")))
    shapes = shapes.withColumn("area2", area)
    wish = F.lit(None).cast("int") if draw_level is None else draw_level
    key = F.when(wish.between(1, 100), F.lit(1 << 62) - F.lit(1 << 40) * wish).otherwise(F.col("area2"))
    return global_rank(shapes.withColumn("_key", key.cast("long")), [F.desc("_key")], "place", dense=True).drop("_key")


def route_centres(nodes: DataFrame, arcs: DataFrame, width: int = CENTRE_WIDTH, roads: int = CENTRE_ROADS, outside: int = CENTRE_OUTSIDE, size: int = CENTRE_BYTES) -> DataFrame:
    """(node_id, centre): routing nodes dealt to boxes that are halved, across their longer side, until each fits.

    nodes has node_id, lat, lon and bytes; arcs from_node, to_node and way_id. A centre fits if its nodes' box is narrower
    than ``width``, and it has fewer than so many roads, nodes outside that arcs lead to, and bytes. A centre's name is the path of
    halves that lead to it. Boxes that fit are done, so a round looks only at the others; each is written out.
    """
    arcs = cut(arcs.select("from_node", "to_node", "way_id"))
    lead = arcs.groupBy(F.col("from_node").alias("node_id")).agg(F.count(F.lit(1)).alias("arcs"))
    state = cut(nodes.select("node_id", "lat", "lon", "bytes", F.lit("").alias("centre")).join(lead, "node_id", "left").fillna(0, ["arcs"]))
    done = None
    for _ in range(48):
        box = cut(state.groupBy("centre").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.sum("bytes").alias("bytes"), F.sum("arcs").alias("arcs")))
        # Roads and nodes outside are counted only in boxes that fit by all else and have so many arcs that they might not fit by these.
        open_ = (F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s")) < width) & (F.col("bytes") < size) & (F.col("arcs") >= min(roads, outside))
        asked = state.join(box.where(open_).select("centre"), "centre", "left_semi")
        if asked.isEmpty():
            box = box.withColumn("ways", F.lit(0)).withColumn("out", F.lit(0))
        else:
            own = asked.select(F.col("node_id").alias("from_node"), "centre")
            there = asked.select(F.col("node_id").alias("to_node"), F.col("centre").alias("other"))
            links = arcs.join(own, "from_node").join(there, "to_node", "left")
            links = links.groupBy("centre").agg(F.countDistinct("way_id").alias("ways"), F.countDistinct(F.when(~F.col("other").eqNullSafe(F.col("centre")), F.col("to_node"))).alias("out"))
            box = box.join(links, "centre", "left").fillna(0, ["ways", "out"])
        wide, high = F.col("e") - F.col("w"), F.col("n") - F.col("s")
        fits = (F.greatest(wide, high) < width) & (F.col("ways") < roads) & (F.col("out") < outside) & (F.col("bytes") < size)
        # A box of one place cannot be halved.
        fits = fits | ((wide == 0) & (high == 0))
        box = box.withColumn("fits", fits).withColumn("by_lon", wide > high).withColumn("at", F.when(wide > high, F.col("w") + F.floor(wide / 2)).otherwise(F.col("s") + F.floor(high / 2)))
        dealt = cut(state.join(box.select("centre", "fits", "by_lon", "at"), "centre"))
        part = dealt.where("fits").select("node_id", "centre")
        done = part if done is None else done.unionByName(part)
        rest = dealt.where("not fits")
        if rest.isEmpty():
            break
        upper = F.when(F.col("by_lon"), F.col("lon") > F.col("at")).otherwise(F.col("lat") > F.col("at"))
        state = cut(rest.select("node_id", "lat", "lon", "bytes", "arcs", F.concat("centre", F.when(upper, "1").otherwise("0")).alias("centre")))
    return done


