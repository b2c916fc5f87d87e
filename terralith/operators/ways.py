"""Ways, junctions and the routable network, as joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .work import cut


def ordered(refs: DataFrame, order: list[str]) -> DataFrame:
    """way_nodes (way_id, pos, node_id): pos counts from 0 in the given order."""
    pos = F.row_number().over(Window.partitionBy("way_id").orderBy(*order)) - 1
    return refs.select("way_id", pos.alias("pos"), "node_id")


def assembled(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, points, complete): points in order; nodes that are missing are left out and told."""
    joined = way_nodes.join(nodes.select("node_id", "lat", "lon"), "node_id", "left")
    point = F.when(F.col("lat").isNotNull(), F.struct("pos", "lat", "lon", "node_id"))
    return joined.groupBy("way_id").agg(F.sort_array(F.collect_list(point)).alias("points"), F.every(F.col("lat").isNotNull()).alias("complete"))


def degrees(way_nodes: DataFrame) -> DataFrame:
    """(node_id, degree): how often ways pass a node, 127 at most."""
    return way_nodes.groupBy("node_id").agg(F.least(F.count(F.lit(1)), F.lit(127)).alias("degree"))


def passing(refs: DataFrame, through: DataFrame) -> DataFrame:
    """The refs (way_id, node_id, ..) of the ways that pass a node of ``through``."""
    chosen = refs.join(through.select("node_id"), "node_id", "left_semi").select("way_id").distinct()
    # A table of the few ways chosen, so that the many refs are not sorted for the join.
    return refs.join(chosen.hint("shuffle_hash"), "way_id", "left_semi")


def located(way_nodes: DataFrame, nodes: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """way_nodes with lat, lon and the node's degree; nodes without a place are left out.

    The join and the count share one partitioning by node. If way_nodes has some of the ways only, ``counted`` has the ``degrees`` of all.
    """
    here = way_nodes.join(nodes.select("node_id", "lat", "lon"), "node_id")
    if counted is not None:
        return here.join(counted.select("node_id", "degree"), "node_id")
    return here.withColumn("degree", F.least(F.count(F.lit(1)).over(Window.partitionBy("node_id")), F.lit(127)))


def _steps(here: DataFrame) -> DataFrame:
    """Each point with the next one of its way (to_node, to_lat, to_lon) and the metres to it."""
    after = Window.partitionBy("way_id").orderBy("pos")
    there = here.withColumns({"to_node": F.lead("node_id").over(after), "to_lat": F.lead("lat").over(after), "to_lon": F.lead("lon").over(after)})
    metres = geo.equirectangular(geo.degrees(F.col("lat")), geo.degrees(F.col("lon")), geo.degrees(F.col("to_lat")), geo.degrees(F.col("to_lon")))
    return there.withColumn("metres", metres)


def segments(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, pos, from/to node and coordinates, metres) of consecutive points."""
    there = _steps(way_nodes.join(nodes.select("node_id", "lat", "lon"), "node_id"))
    return there.where("to_node is not null").select("way_id", "pos", F.col("node_id").alias("from_node"), "to_node", "lat", "lon", "to_lat", "to_lon", "metres")


def arcs(way_nodes: DataFrame, nodes: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(way_id, arc, from_node, to_node, metres, n_segments, heading, end_heading, direct) between routing nodes.

    A routing node is an end of a way or a node that ways pass more than once. An arc's
    number counts the routing nodes up to its start. heading and end_heading are the bearings of its
    first and last segment, direct that from end to end, all in degrees. ``counted`` is that of ``located``.
    """
    along = Window.partitionBy("way_id").orderBy("pos")
    there = _steps(located(way_nodes, nodes, counted))
    # The last point of a way has no next one; it starts no segment, so it needs no number.
    routing = (F.lag("pos").over(along).isNull() | (F.col("degree") > 1)).cast("int")
    there = there.withColumn("routing", routing).withColumn("arc", F.sum("routing").over(along)).where("to_node is not null")
    deg = lambda *names: [geo.degrees(F.col(n)) for n in names]
    there = there.withColumn("bearing", geo.bearing(*deg("lat", "lon", "to_lat", "to_lon")))
    out = there.groupBy("way_id", "arc").agg(
        F.min_by(F.struct("node_id", "lat", "lon", "bearing"), "pos").alias("a"), F.max_by(F.struct("to_node", "to_lat", "to_lon", "bearing"), "pos").alias("b"),
        F.sum("metres").alias("metres"), F.count(F.lit(1)).alias("n_segments"),
    )
    direct = geo.bearing(*deg("a.lat", "a.lon", "b.to_lat", "b.to_lon"))
    return out.select("way_id", "arc", F.col("a.node_id").alias("from_node"), F.col("b.to_node").alias("to_node"), "metres", "n_segments", F.col("a.bearing").alias("heading"), F.col("b.bearing").alias("end_heading"), direct.alias("direct"))


def _turned(bearing: Column) -> Column:
    return F.when(bearing > 0, bearing - 180).otherwise(bearing + 180)


def both_directions(arcs_: DataFrame) -> DataFrame:
    """Each arc forward and back, the columns of ``arcs`` with forward."""
    there = {"from_node": F.col("from_node"), "to_node": F.col("to_node"), "heading": F.col("heading"), "end_heading": F.col("end_heading"), "direct": F.col("direct"), "forward": F.lit(True)}
    back = {"from_node": F.col("to_node"), "to_node": F.col("from_node"), "heading": _turned(F.col("end_heading")), "end_heading": _turned(F.col("heading")), "direct": _turned(F.col("direct")), "forward": F.lit(False)}
    ways = [F.struct(*[c.alias(n) for n, c in side.items()]) for side in (there, back)]
    return arcs_.select("way_id", "arc", "metres", "n_segments", F.explode(F.array(*ways)).alias("d")).select("way_id", "arc", "metres", "n_segments", "d.*")


def dead_ends(way_nodes: DataFrame) -> DataFrame:
    """(way_id, node_id): ends of ways that no way passes again."""
    ends = way_nodes.groupBy("way_id").agg(F.min_by("node_id", "pos").alias("first"), F.max_by("node_id", "pos").alias("last"))
    ends = ends.select("way_id", F.explode(F.array_distinct(F.array("first", "last"))).alias("node_id"))
    return ends.join(degrees(way_nodes).where("degree = 1"), "node_id", "left_semi").select("way_id", "node_id")


def unconnected(way_nodes: DataFrame) -> DataFrame:
    """(way_id): ways that share no node with another one."""
    used = way_nodes.select("node_id", "way_id").distinct()
    shared = used.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = used.join(shared, "node_id", "left_semi").select("way_id").distinct()
    return way_nodes.select("way_id").distinct().join(linked, "way_id", "left_anti")


def through_routes(arcs_: DataFrame, via: DataFrame) -> DataFrame:
    """(node_id, from_way, to_way): pairs of different ways at the listed nodes."""
    at = both_directions(arcs_).select(F.col("from_node").alias("node_id"), "way_id").distinct().join(via, "node_id", "left_semi")
    other = at.select("node_id", F.col("way_id").alias("to_way"))
    return at.join(other, "node_id").where("way_id <> to_way").select("node_id", F.col("way_id").alias("from_way"), "to_way")


def through_route_counts(arcs_: DataFrame, via: DataFrame) -> DataFrame:
    """(node_id, n_pairs): how many rows ``through_routes`` has at each node, from the number of ways there."""
    at = both_directions(arcs_).select(F.col("from_node").alias("node_id"), "way_id").distinct().join(via, "node_id", "left_semi")
    n = at.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n > 1").select("node_id", (F.col("n") * (F.col("n") - 1)).alias("n_pairs"))


def no_through_routes(arcs_: DataFrame, via: DataFrame, access: DataFrame) -> DataFrame:
    """(node_id, in_way, in_arc, out_way, out_arc): paths that a closed node forbids, by the vehicles that could use them.

    via has node_id and except_mask, access has way_id and mask. A path takes one arc in and
    another out, to another node than it came from, both open to a vehicle that is not excepted.
    """
    each = both_directions(arcs_).join(access.select("way_id", "mask"), "way_id")
    end = lambda d, node, other: each.select(F.col(node).alias("node_id"), F.col(other).alias(f"{d}_end"), F.col("way_id").alias(f"{d}_way"), F.col("arc").alias(f"{d}_arc"), F.col("mask").alias(f"{d}_mask"), F.col("forward").alias(f"{d}_forward"))
    pairs = end("in", "to_node", "from_node").join(via, "node_id").join(end("out", "from_node", "to_node"), "node_id")
    usable = F.col("in_mask").bitwiseAND(F.col("out_mask")).bitwiseAND(F.bitwise_not(F.col("except_mask"))).bitwiseAND(F.lit(255)) != 0
    return pairs.where((F.col("in_end") != F.col("out_end")) & usable).select("node_id", "in_way", "in_arc", "out_way", "out_arc")


def no_through_counts(arcs_: DataFrame, via: DataFrame, access: DataFrame) -> DataFrame:
    """(node_id, n): how many rows ``no_through_routes`` has at each node that has any, without making them.

    An arc leads in from a node as it leads out to it. So these are the pairs of arcs at the node by their masks, less those of the same other end.
    """
    out = both_directions(arcs_).select("way_id", F.col("from_node").alias("node_id"), F.col("to_node").alias("end")).where("end is not null")
    out = out.join(via.select("node_id"), "node_id", "left_semi").join(access.select("way_id", F.col("mask").bitwiseAND(F.lit(255)).alias("mask")), "way_id")
    ends = cut(out.groupBy("node_id", "end", "mask").agg(F.count(F.lit(1)).alias("n")))

    def pairs(of: DataFrame, sign: int, *by: str) -> DataFrame:
        other = of.select(*by, F.col("mask").alias("mask2"), F.col("n").alias("n2"))
        return of.join(other, list(by)).groupBy("node_id", F.col("mask").bitwiseAND(F.col("mask2")).alias("mask")).agg(F.sum(F.col("n") * F.col("n2") * sign).alias("n"))

    every = pairs(ends.groupBy("node_id", "mask").agg(F.sum("n").alias("n")), 1, "node_id").unionByName(pairs(ends, -1, "node_id", "end"))
    usable = F.col("mask").bitwiseAND(F.bitwise_not(F.col("except_mask"))) != 0
    return every.join(via.select("node_id", "except_mask"), "node_id").where(usable).groupBy("node_id").agg(F.sum("n").alias("n")).where("n > 0")


def node_class(way_nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(node_id, class): the highest class with more than one road, else the single class
    there is, else the second highest."""
    per = way_nodes.select("node_id", "way_id").distinct().join(ways.select("way_id", "road_class"), "way_id")
    counts = per.groupBy("node_id", "road_class").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("node_id").agg(F.max(F.when(F.col("n") > 1, F.col("road_class"))).alias("twice"), F.sort_array(F.collect_set("road_class"), asc=False).alias("all"))
    second = F.when(F.size("all") == 1, F.element_at("all", 1)).otherwise(F.try_element_at("all", F.lit(2)))
    return best.select("node_id", F.coalesce("twice", second).alias("class"))


def access_mask(allowed: dict[str, Column], bits: dict[str, int]) -> Column:
    """A bit for each vehicle whose tag does not say no."""
    out = F.lit(0)
    for vehicle, bit in bits.items():
        denied = F.coalesce(allowed[vehicle].isin("no", "false", "0"), F.lit(False))
        out = out + F.when(denied, 0).otherwise(bit)
    return out


def chunked(way_nodes: DataFrame, most: int) -> DataFrame:
    """(way_id, chunk, first, last, n): lines of at most ``most`` points; the end of one is
    the start of the next."""
    size = F.count(F.lit(1)).over(Window.partitionBy("way_id"))
    step = most - 1
    here = way_nodes.withColumn("size", size).withColumn("chunk", F.expr(f"pos div {step}"))
    start = here.where((F.col("pos") < F.col("size") - 1) | (F.col("size") == 1))
    runs = start.groupBy("way_id", "chunk").agg(F.min("pos").alias("first"), F.least(F.min("pos") + step, F.max("size") - 1).alias("last"))
    return runs.select("way_id", "chunk", "first", "last", (F.col("last") - F.col("first") + 1).alias("n"))


def first_of_duplicates(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of the points with equal keys."""
    least = F.min(F.struct(*order, *[c for c in points.columns if c not in order]))
    return points.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(least.alias("p")).select("p.*").select(*points.columns)


def number_ranges(houses: DataFrame) -> DataFrame:
    """(road, side, style, low, high, n) of house numbers: even, odd or both."""
    odd = F.sum(F.col("number") % 2)
    style = F.when(odd == 0, "E").when(odd == F.count(F.lit(1)), "O").otherwise("B")
    return houses.groupBy("road", "side").agg(style.alias("style"), F.min("number").alias("low"), F.max("number").alias("high"), F.count(F.lit(1)).alias("n"))


def interpolated(ends: DataFrame) -> DataFrame:
    """(road, number): the numbers between low and high in steps of the style."""
    step = F.when(F.col("style") == "B", 1).otherwise(2)
    return ends.select("road", F.explode(F.sequence(F.col("low").cast("long"), F.col("high").cast("long"), step.cast("long"))).alias("number"))


def driving_side(roads: DataFrame, wish: str = "detect,right") -> DataFrame:
    """One row: the counts of roads on the left, the right and without a side, and the side that drives.

    A detected side needs more roads than the other side and the unknown ones together; else the
    side that the wish ends with holds. A wish of just left or right always holds.
    """
    side = F.col("side")
    votes = roads.agg(F.count_if(side == "left").alias("n_left"), F.count_if(side == "right").alias("n_right"), F.count_if(~F.coalesce(side.isin("left", "right"), F.lit(False))).alias("n_unknown"))
    fallback = F.lit("left" if wish.endswith("left") else "right")
    if not wish.startswith("detect"):
        return votes.withColumn("side", fallback)
    left = F.col("n_left") > F.col("n_right") + F.col("n_unknown")
    right = F.col("n_right") > F.col("n_left") + F.col("n_unknown")
    return votes.withColumn("side", F.when(left, "left").when(right, "right").otherwise(fallback))
