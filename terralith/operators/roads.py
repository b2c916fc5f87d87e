"""Roads made from ways: direction, classes, masks, merging, splitting, restrictions and checks.

A road is a row with way_id, points (structs of lat, lon, node_id), tags and what rules gave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .lines import pairwise
from .rules import NAMESPACE
from .work import cut

#: Bits of vehicles and of route flags. Fixed values.
ACCESS_BITS = {"foot": 1, "bicycle": 2, "car": 4, "delivery": 8, "truck": 16, "bus": 32, "taxi": 64, "emergency": 128}
ROUTE_BITS = {"throughroute": 1, "carpool": 2, "oneway": 4, "toll": 8, "unpaved": 16, "ferry": 32, "roundabout": 64}
#: Vehicles that a restriction can name and their bits; those in upper places mean all but the named ones. Fixed values.
DEFAULT_EXCEPT = ACCESS_BITS["foot"] | ACCESS_BITS["emergency"]
EXCEPT_BITS = {
    "vehicle": 255 & ~DEFAULT_EXCEPT, "motor_vehicle": 255 & ~(DEFAULT_EXCEPT | 2), "psv": 64 | 32, "bicycle": 2, "motorcar": 4, "bus": 32, "taxi": 64,
    "goods": 8, "hgv": 16, "truck": 16, "emergency": 128, "foot": 1,
}
#: Turns that are understood. Fixed values.
TURNS = ("no_right_turn", "no_left_turn", "no_u_turn", "no_straight_on", "only_right_turn", "only_left_turn", "only_straight_on", "no_entry", "no_exit")
MAX_NODES, MAX_ARC_METRES, MAX_ANGLE = 64, 20_450_000.0, 130.0


def like_yes(value: Column) -> Column:
    return F.coalesce(value.isin("yes", "true", "1"), F.lit(False))


def like_no(value: Column) -> Column:
    return F.coalesce(value.isin("no", "false", "0"), F.lit(False))


def _tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def with_tags(tags: Column, new: dict[str, str | None]) -> Column:
    """A map with some tags set, or taken away where the new value is None."""
    rest = F.map_filter(tags, lambda k, v: ~k.isin(*new))
    added = {k: v for k, v in new.items() if v is not None}
    return F.map_concat(rest, F.create_map(*[F.lit(x) for kv in added.items() for x in kv])) if added else rest


def one_way(roads: DataFrame) -> DataFrame:
    """Roads against their points are turned round: adds ``reversed``; the tag oneway is 'yes' or missing afterwards."""
    value = _tag(F.col("tags"), "oneway")
    back = F.coalesce(value.isin("-1", "reverse"), F.lit(False))
    yes = back | like_yes(value)
    tags = F.when(yes, with_tags(F.col("tags"), {"oneway": "yes"})).otherwise(with_tags(F.col("tags"), {"oneway": None}))
    return roads.withColumns({"reversed": back, "points": F.when(back, F.reverse("points")).otherwise(F.col("points")), "tags": tags})


#: Access tags that a cycle way made from a road does not keep. Fixed values.
_NO_CYCLE = ("foot", "motorcar", "goods", "hgv", "bus", "taxi", "emergency", "vehicle", "motor_vehicle", "carpool", "motorcycle", "psv", "truck")


def with_cycleways(roads: DataFrame, opposite: Column) -> DataFrame:
    """Roads, and a copy of those with a way for cycles against the traffic: open to cycles alone, in both directions. Adds ``synthesised``."""
    tags = with_tags(F.col("tags"), {"access": "no", "bicycle": "yes", "oneway": "no"} | dict.fromkeys(_NO_CYCLE))
    copies = roads.where(F.coalesce(opposite, F.lit(False))).withColumn("tags", tags).withColumn("synthesised", F.lit(True))
    return roads.withColumn("synthesised", F.lit(False)).unionByName(copies)


def rotated(roads: DataFrame, degrees: DataFrame) -> DataFrame:
    """Closed roads start at their first junction, unless they do so already; degrees has node_id and degree.

    The node where a closed road starts counts twice on that road alone.
    """
    closed = roads.where((F.size("points") > 2) & (F.element_at("points", 1)["node_id"] == F.element_at("points", -1)["node_id"]))
    nodes = closed.select("way_id", F.posexplode(F.transform("points", lambda p: p["node_id"])).alias("pos", "node_id"), F.size("points").alias("n")).where("pos < n - 1")
    found = nodes.join(degrees, "node_id").groupBy("way_id").agg(F.max(F.when(F.col("pos") == 0, F.col("degree"))).alias("own"), F.min(F.when((F.col("pos") > 0) & (F.col("degree") > 1), F.col("pos"))).alias("at"))
    out = roads.join(found.where("own <= 2 and at is not null").select("way_id", "at"), "way_id", "left")
    n = F.size("points")
    turned = F.concat(F.slice("points", F.col("at") + 1, n - 1 - F.col("at")), F.slice("points", F.lit(1), F.col("at") + 1))
    return out.withColumn("points", F.when(F.col("at").isNull(), F.col("points")).otherwise(turned)).drop("at")


def recalculated(value: Column, tags: Column, name: str, highest: int, namespace: str = NAMESPACE) -> Column:
    """A road class or speed after its tags: an absolute number, +n or -n, then a least and a greatest one.

    name is road-class or road-speed; for the speed the tag <name>-class replaces it first, if from 0 to 7.
    """
    get = lambda suffix: _tag(tags, f"{namespace}:{name}{suffix}")
    if name == "road-speed":
        own = get("-class").try_cast("int")
        value = F.when(own.between(0, 7), own).otherwise(value)
    change, number = get(""), F.regexp_replace(get(""), r"^[+-]", "").try_cast("int")
    value = F.when(number.isNull(), value).when(change.startswith("-"), value - number).when(change.startswith("+"), value + number).otherwise(number)
    most, least = F.coalesce(get("-max").try_cast("int"), F.lit(highest)), F.coalesce(get("-min").try_cast("int"), F.lit(0))
    return F.when(value > most, most).when(value < least, least).otherwise(value)


def access_mask(tags: Column, namespace: str = NAMESPACE) -> Column:
    """A bit for each vehicle whose tag does not say no."""
    closed = sum((F.when(like_no(_tag(tags, f"{namespace}:{v}")), bit).otherwise(0) for v, bit in ACCESS_BITS.items()), F.lit(0))
    return F.lit(255) - closed


def route_flags(tags: Column, namespace: str = NAMESPACE) -> Column:
    """Flags of a road; a through route is allowed unless its tag says no."""
    own = lambda name: _tag(tags, f"{namespace}:{name}")
    on = {n: like_yes(own(n)) for n in ("carpool", "toll", "unpaved", "ferry")}
    on |= {"throughroute": ~like_no(own("throughroute")), "oneway": like_yes(_tag(tags, "oneway")), "roundabout": F.coalesce(_tag(tags, "junction") == "roundabout", F.lit(False))}
    return sum((F.when(c, ROUTE_BITS[n]).otherwise(0) for n, c in on.items()), F.lit(0))


def roundabout_direction(points: Column) -> Column:
    """The sum of votes of every third segment: +1 if the centre lies to its right, -1 if to its left.

    Segments under 2.5 metres and bearings to the centre of under 15 or over 165 degrees do not vote.
    """
    centre, n = geo.centre_of(points), F.size(points)
    deg = lambda p: [geo.degrees(p["lat"]), geo.degrees(p["lon"])]

    def vote(a: Column, b: Column) -> Column:
        off = geo.rhumb_bearing(*deg(a), *deg(centre)) - geo.rhumb_bearing(*deg(a), *deg(b))
        off = F.when(off > 180, off - 360).when(off < -180, off + 360).otherwise(off)
        far = (geo.distance(*deg(a), *deg(centre)) > 2.5) & (geo.distance(*deg(a), *deg(b)) > 2.5)
        return F.when(far & (off >= 15) & (off < 165), 1).when(far & (off <= -15) & (off > -165), -1).otherwise(0)

    third = F.filter(F.zip_with(pairwise(points, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["i"] % 3 == 0)
    return F.when(n > 2, F.aggregate(F.transform(third, lambda x: vote(x["s"]["a"], x["s"]["b"])), F.lit(0), lambda s, v: s + v)).otherwise(0)


def merge_pairs(roads: DataFrame, same: list[str], closed_ends: DataFrame | None = None, most: float = MAX_ANGLE) -> DataFrame:
    """(node_id, first, second, angle): roads that go on in one another, chosen by the smallest turn at each node.

    roads has way_id, points and the columns of ``same``, which must agree; a turn may have ``most``
    degrees; closed_ends lists (node_id, way_id) that must not be merged there. Merging at one node changes no turn at another, so nodes are
    dealt with side by side; within a node pairs are taken by rising angle, then by way ids.
    """
    end = lambda p, i: [geo.degrees(F.element_at(p, i)[a]) for a in ("lat", "lon")]
    open_ = roads.where((F.size("points") > 1) & (F.element_at("points", 1)["node_id"] != F.element_at("points", -1)["node_id"]))
    p = F.col("points")
    into = open_.select(F.element_at(p, -1)["node_id"].alias("node_id"), F.col("way_id").alias("first"), F.struct(*end(p, -2), *end(p, -1)).alias("a"), F.struct(*same).alias("same"))
    out = open_.select(F.element_at(p, 1)["node_id"].alias("node_id"), F.col("way_id").alias("second"), F.struct(*end(p, 2)).alias("b"), F.struct(*same).alias("same2"))
    if closed_ends is not None:
        into = into.join(closed_ends.select("node_id", F.col("way_id").alias("first")), ["node_id", "first"], "left_anti")
        out = out.join(closed_ends.select("node_id", F.col("way_id").alias("second")), ["node_id", "second"], "left_anti")
    pairs = into.join(out, "node_id").where(F.col("same").eqNullSafe(F.col("same2")) & (F.col("first") != F.col("second")))
    angle = F.abs(geo.angle_at(F.col("a.col1"), F.col("a.col2"), F.col("a.col3"), F.col("a.col4"), F.col("b.col1"), F.col("b.col2")))
    pairs = pairs.select("node_id", "first", "second", F.round(angle, 6).alias("angle")).where(F.col("angle") <= most)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, used = None, (set(), set())
        for batch in batches:
            keep = []
            for at, first, second in zip(*(batch.column(c).to_pylist() for c in ("node_id", "first", "second"))):
                if at != node:
                    node, used = at, (set(), set())
                keep.append(first not in used[0] and second not in used[1])
                if keep[-1]:
                    used[0].add(first)
                    used[1].add(second)
            yield batch.filter(pa.array(keep, pa.bool_()))

    # Many nodes to a worker call; what is kept of a node are the ways that are taken already.
    return pairs.repartition("node_id").sortWithinPartitions("node_id", "angle", "first", "second").mapInArrow(chosen, pairs.schema)


def chains(pairs: DataFrame, ways: DataFrame) -> DataFrame:
    """(way_id, head, place): each way with the first way of its chain and its place in it, from 0.

    pairs has first and second; each way follows one other and is followed by one other at most. A ring is
    cut before its least way. Pointers are doubled, so a chain of n ways takes log2(n) rounds, and so does a ring.
    """
    placed = _followers(pairs)
    return ways.select("way_id").join(placed, "way_id", "left").select("way_id", F.coalesce("head", "way_id").alias("head"), F.coalesce("place", F.lit(0)).alias("place"))


def _followers(pairs: DataFrame) -> DataFrame:
    """The rows of ``chains`` for the ways that follow another one; rounds carry no others."""
    links = cut(pairs.select(F.col("second").alias("way_id"), F.col("first").alias("to"), F.lit(1).alias("place"), F.col("first").alias("low")))
    # low is the least of the ways passed so far, the way's own start not among them: who meets itself there is the least of a ring.
    state, rings = links, []
    while True:
        if not state.where("way_id = low").isEmpty():
            least = state.where("way_id = low").select("low")
            rings.append(cut(state.join(least, "low", "left_semi").select("way_id", "low")))
            state = cut(state.join(least, "low", "left_anti").select("way_id", "to", "place", "low"))
        far = state.select(F.col("way_id").alias("to"), F.col("to").alias("to2"), F.col("place").alias("place2"), F.col("low").alias("low2"))
        state = cut(state.join(far, "to", "left").select("way_id", F.coalesce("to2", "to").alias("to"), (F.col("place") + F.coalesce("place2", F.lit(0))).alias("place"), F.least("low", "low2").alias("low"), F.col("to2").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    out = state.select("way_id", F.col("to").alias("head"), "place")
    if not rings:
        return out
    inner = reduce(DataFrame.unionByName, rings).where("way_id <> low").select(F.col("way_id").alias("second"))
    return out.unionByName(_followers(pairs.join(inner, "second", "left_semi")))


def merged_lines(lines: DataFrame, same: list[str]) -> DataFrame:
    """(way_id, points, n_ways): lines (way_id, points, ..) that are no roads joined at equal places, whatever the turn.

    Lines that agree in the columns of ``same``, as type, name and resolutions, are joined end to start, the straightest first.
    """
    place = lambda p: geo.point_key(p["lat"], p["lon"])
    at = F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), place(p).alias("node_id")))
    return merged(lines.withColumn("points", at), same, most=180.0)


def merged(roads: DataFrame, same: list[str], closed_ends: DataFrame | None = None, most: float = MAX_ANGLE) -> DataFrame:
    """(way_id, points, n_ways): roads joined where they go on; the first way of a chain gives the id."""
    roads = cut(roads)
    placed = chains(cut(merge_pairs(roads, same, closed_ends, most)), roads)
    parts = roads.select("way_id", "points").join(placed, "way_id")
    joined = parts.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("place", "points"))).alias("parts"))
    # Each way after the first begins with the point that the one before ends with.
    points = F.flatten(F.transform("parts", lambda x, i: F.when(i == 0, x["points"]).otherwise(F.slice(x["points"], 2, F.greatest(F.size(x["points"]) - 1, F.lit(0))))))
    return joined.select(F.col("head").alias("way_id"), points.alias("points"), F.size("parts").alias("n_ways"))


def split_by_nodes(way_nodes: DataFrame, routing: Column, most: int = MAX_NODES) -> DataFrame:
    """(way_id, part, first, last): roads cut so that none has over ``most`` routing nodes, or passes a node twice.

    A road is cut at the last routing node before its ``most``-th, and before a node it has been at.
    """
    along = Window.partitionBy("way_id").orderBy("pos")
    marked = way_nodes.withColumn("routing", routing)
    marked = marked.withColumn("nth", F.sum(F.col("routing").cast("int")).over(along)).withColumn("last", F.max("pos").over(Window.partitionBy("way_id")))
    marked = marked.withColumn("seen", F.max("pos").over(Window.partitionBy("way_id", "node_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    nodes = marked.where("routing").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "seen"))).alias("nodes"))
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("before"), F.array().cast("array<int>").alias("cuts"))

    def fold(s: Column, x: Column) -> Column:
        loop = F.coalesce(x["seen"] >= s["first"], F.lit(False))
        full = s["n"] >= most
        over = (loop | full) & (s["before"] > s["first"])
        return F.struct(
            F.when(over, s["before"]).otherwise(s["first"]).alias("first"), F.when(over, 2).otherwise(s["n"] + 1).alias("n"), x["pos"].cast("int").alias("before"),
            F.when(over, F.concat(s["cuts"], F.array(s["before"]))).otherwise(s["cuts"]).alias("cuts"),
        )

    cuts = nodes.select("way_id", F.aggregate("nodes", start, fold)["cuts"].alias("cuts"))
    bounds = marked.groupBy("way_id").agg(F.max("last").alias("last")).join(cuts, "way_id", "left").withColumn("at", F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.col("last").cast("int"))))
    parts = pairwise(F.col("at"), lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return bounds.select("way_id", F.posexplode(parts).alias("part", "p")).select("way_id", "part", "p.first", "p.last")


def restrictions(relations: DataFrame, members: DataFrame, way_ends: DataFrame) -> DataFrame:
    """(rel_id, turn, only, from_way, via_node, via_ways, to_way, except_mask, direction) of valid turn restrictions.

    relations has rel_id and tags, members (rel_id, pos, role, member_type, member_id), way_ends (way_id, first_node,
    last_node). Only no_entry may have several from ways and only no_exit several to ways, and neither with via ways. Without a
    via the end that both ways share is taken, if there is just one. The mask has a bit for each vehicle that is not bound: foot and emergency, or, where the
    restriction names vehicles, all others; then those of the tag except.
    """
    tags = F.col("tags")
    named = F.map_filter(tags, lambda k, v: k.startswith("restriction:"))
    of_type = F.when(_tag(tags, "type").startswith("restriction:"), F.substring(_tag(tags, "type"), len("restriction:") + 1, 100))
    vehicles = F.array_compact(F.concat(F.transform(F.map_keys(named), lambda k: F.substring(k, len("restriction:") + 1, 100)), F.array(of_type)))
    bits = F.create_map(*[F.lit(x) for kv in EXCEPT_BITS.items() for x in kv])
    bit = lambda v: F.coalesce(F.try_element_at(bits, v), F.lit(0))
    bound = F.aggregate(vehicles, F.lit(255), lambda m, v: m.bitwiseAND(F.bitwise_not(bit(v))))
    base = F.when(F.size(vehicles) > 0, bound).otherwise(DEFAULT_EXCEPT)
    excepted = F.transform(F.split(F.coalesce(_tag(tags, "except"), F.lit("")), "[,;]"), lambda v: F.trim(v))
    mask = F.aggregate(excepted, base, lambda m, v: m.bitwiseOR(bit(v)))
    kinds = F.array_distinct(F.array_compact(F.concat(F.array(_tag(tags, "restriction")), F.map_values(named))))
    turn = F.trim(F.element_at(kinds, 1))
    known = F.size(F.filter(vehicles, lambda v: bit(v) != 0)) > 0
    direction = F.when(turn.endswith("u_turn"), "u").when(turn.contains("left"), "l").when(turn.contains("right"), "r").when(turn.contains("straight"), "s").otherwise("?")
    rels = relations.where(F.coalesce(_tag(tags, "type").startswith("restriction"), F.lit(False)) & (F.size(kinds) == 1))
    rels = rels.where(((F.size(vehicles) == 0) | known) & turn.isin(*TURNS)).select("rel_id", turn.alias("turn"), mask.alias("except_mask"), direction.alias("direction"))

    of = lambda role, kind: F.sort_array(F.collect_list(F.when((F.col("role") == role) & (F.col("member_type") == kind), F.struct("pos", "member_id"))))
    sides = members.groupBy("rel_id").agg(of("from", "way").alias("f"), of("to", "way").alias("t"), of("via", "node").alias("v"), of("via", "way").alias("w"))
    out = rels.join(sides, "rel_id")
    several = lambda c, turn_: (F.size(c) == 1) | ((F.size(c) > 1) & (F.col("turn") == turn_) & (F.size("w") == 0))
    out = out.where(several("f", "no_entry") & several("t", "no_exit") & (F.size("v") + (F.size("w") > 0).cast("int") <= 1))
    ids = lambda c: F.transform(c, lambda x: x["member_id"])
    out = out.select("rel_id", "turn", "except_mask", "direction", ids("w").alias("via_ways"), F.try_element_at(ids("v"), F.lit(1)).alias("via"), F.explode(ids("f")).alias("from_way"), ids("t").alias("t"))
    out = out.withColumn("to_way", F.explode("t")).drop("t")
    ends = lambda side: way_ends.select(F.col("way_id").alias(f"{side}_way"), F.array("first_node", "last_node").alias(f"{side}_ends"))
    out = out.join(ends("from"), "from_way").join(ends("to"), "to_way")
    shared = F.array_intersect("from_ends", "to_ends")
    guessed = F.when((F.size(shared) == 1) & (F.size("via_ways") == 0), F.element_at(shared, 1))
    out = out.withColumn("via_node", F.coalesce("via", guessed))
    # A given via node must be an end of a way on both sides unless via ways lie between them.
    fits = F.when(F.size("via_ways") > 0, True).otherwise(F.array_contains("from_ends", F.col("via_node")) & F.array_contains("to_ends", F.col("via_node")))
    return out.where(F.coalesce(fits, F.lit(False))).select("rel_id", "turn", F.col("turn").startswith("only_").alias("only"), "from_way", "via_node", "via_ways", "to_way", "except_mask", "direction")


def still_valid(restrictions_: DataFrame, removed: DataFrame) -> DataFrame:
    """Restrictions none of whose ways is among the removed ones (way_id); other rows of a no_entry or no_exit stay."""
    gone = removed.select("way_id").distinct()
    via = restrictions_.select("rel_id", F.explode("via_ways").alias("way_id")).join(gone, "way_id", "left_semi").select("rel_id").distinct()
    out = restrictions_.join(via, "rel_id", "left_anti")
    for side in ("from_way", "to_way"):
        out = out.join(gone.withColumnRenamed("way_id", side), side, "left_anti")
    return out.select(*restrictions_.columns)


def forbidden_arcs(restrictions_: DataFrame, both: DataFrame) -> DataFrame:
    """(rel_id, via_node, in_way, in_arc, out_way, out_arc, except_mask): the paths that restrictions at a node forbid.

    both is ``ways.both_directions``. A no_ restriction forbids its own path, an only_ one every other way out.
    """
    one = restrictions_.where(F.size("via_ways") == 0)
    into = both.select(F.col("to_node").alias("via_node"), F.col("way_id").alias("from_way"), F.col("arc").alias("in_arc"), F.col("forward").alias("in_forward"), F.col("from_node").alias("came"))
    out = both.select(F.col("from_node").alias("via_node"), F.col("way_id").alias("out_way"), F.col("arc").alias("out_arc"), F.col("to_node").alias("goes"), F.col("forward").alias("out_forward"))
    paths = one.join(into, ["via_node", "from_way"]).join(out, "via_node")
    back = (F.col("from_way") == F.col("out_way")) & (F.col("in_arc") == F.col("out_arc")) & (F.col("in_forward") != F.col("out_forward"))
    own = F.col("out_way") == F.col("to_way")
    hit = F.when(F.col("only"), ~own & ~back).otherwise(own & ((F.col("direction") == "u") | ~back))
    return paths.where(hit).select("rel_id", "via_node", F.col("from_way").alias("in_way"), "in_arc", "out_way", "out_arc", "except_mask").distinct()


def barriers(nodes: DataFrame, way_nodes: DataFrame, access: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """(node_id, way_id, except_mask): nodes on roads that close them to some vehicles of the road.

    nodes has node_id and tags with access tags, access (way_id, mask). The vehicles that may pass are those not closed at the node.
    """
    closed = nodes.select("node_id", access_mask(F.col("tags"), namespace).alias("except_mask")).where("except_mask <> 255")
    on = way_nodes.select("node_id", "way_id").distinct().join(closed, "node_id").join(access.select("way_id", "mask"), "way_id")
    return on.where(F.col("mask").bitwiseAND(F.bitwise_not(F.col("except_mask"))).bitwiseAND(F.lit(255)) != 0).select("node_id", "way_id", "except_mask")


def exits(nodes: DataFrame, way_nodes: DataFrame, motorways: DataFrame) -> DataFrame:
    """(node_id, ref): the number of the motorway that an exit node lies on; the least way with a number gives it."""
    on = way_nodes.select("node_id", "way_id").distinct().join(nodes.select("node_id"), "node_id", "left_semi").join(motorways.select("way_id", "ref"), "way_id")
    return on.groupBy("node_id").agg(F.min(F.when(F.col("ref").isNotNull(), F.struct("way_id", "ref"))).alias("m")).select("node_id", F.col("m.ref").alias("ref"))


def onward(links: DataFrame, roads: DataFrame) -> DataFrame:
    """(way_id, next_way, angle): the road that each link goes on in, the one with the smallest turn, then the least id.

    links and roads have way_id and points; a road may be joined at any of its points but the last.
    """
    deg = lambda p: [geo.degrees(p["lat"]), geo.degrees(p["lon"])]
    p = F.col("points")
    ends = links.where(F.size(p) > 1).select("way_id", F.element_at(p, -1)["node_id"].alias("node_id"), F.element_at(p, -2).alias("a"), F.element_at(p, -1).alias("b"))
    steps = roads.select(F.col("way_id").alias("next_way"), F.explode(pairwise(p, lambda a, b: F.struct(a["node_id"].alias("node_id"), b.alias("c")))).alias("s")).select("next_way", "s.node_id", "s.c")
    met = ends.join(steps, "node_id").where("way_id <> next_way")
    angle = F.round(F.abs(geo.angle_at(*deg(F.col("a")), *deg(F.col("b")), *deg(F.col("c")))), 6)
    return met.groupBy("way_id").agg(F.min(F.struct(angle.alias("angle"), "next_way")).alias("m")).select("way_id", "m.next_way", "m.angle")


def major_arcs(arcs_: DataFrame, node_class: DataFrame, road_class: DataFrame) -> DataFrame:
    """(way_id, from_node, to_node, metres, steps): extra arcs of a road from each node to the next one of a higher class.

    arcs_ is ``ways.arcs``, node_class (node_id, class) the class of the other roads at a node, road_class (way_id, class) of
    roads. An extra arc passes one node at least and ends at a node whose class, at most the road's, is above all between.
    """
    along = arcs_.join(road_class.select("way_id", F.col("class").alias("own")), "way_id").join(node_class.select(F.col("node_id").alias("to_node"), F.col("class").alias("other")), "to_node", "left")
    step = along.withColumn("rank", F.least("own", F.coalesce("other", F.lit(0))))
    line = step.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("arc", "from_node", "to_node", "metres", "rank"))).alias("a"))
    # The arcs of one way, each with those after it up to the first that outranks it.
    each = line.select("way_id", "a", F.posexplode("a").alias("i", "x"))
    later = F.slice("a", F.col("i") + 2, F.greatest(F.size("a") - F.col("i") - 1, F.lit(0)))
    start = F.struct(F.col("x.metres").alias("metres"), F.col("x.rank").alias("top"), F.lit(0).alias("n"), F.lit(None).cast("struct<to:bigint,metres:double,n:int>").alias("hit"))

    def walk(s: Column, y: Column) -> Column:
        up = y["rank"] > s["top"]
        total = s["metres"] + y["metres"]
        found = F.when(s["hit"].isNull() & up, F.struct(y["to_node"].cast("bigint").alias("to"), total.alias("metres"), (s["n"] + 1).alias("n"))).otherwise(s["hit"])
        return F.struct(total.alias("metres"), F.greatest(s["top"], y["rank"]).alias("top"), (s["n"] + 1).alias("n"), found.alias("hit"))

    hit = each.select("way_id", F.col("x.from_node").alias("from_node"), F.aggregate(later, start, walk)["hit"].alias("h")).where("h is not null")
    return hit.select("way_id", "from_node", F.col("h.to").alias("to_node"), F.round("h.metres", 3).alias("metres"), F.col("h.n").alias("steps"))


def widened(both: DataFrame, least: int = 0x10) -> DataFrame:
    """Arcs with ``heading_byte``; where two that leave a node are closer than ``least`` the second one, clockwise, is turned away.

    Arcs of one node are taken by rising heading, then way and arc; the first one is not moved.
    """
    leaving = both.withColumn("h", geo.heading_byte(F.col("heading")))

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "way_id", "arc", "forward"]).reset_index(drop=True)
        new, last = [], None
        for h in group["h"]:
            last = int(h) if last is None or h - last >= least else last + least
            new.append(last % 256)
        return group.assign(heading_byte=new) if len(group) * least <= 256 else group.assign(heading_byte=group["h"])

    # As many rows as arcs leave one node.
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaving.schema) + ", heading_byte int"
    return leaving.groupBy("from_node").applyInPandas(spread, schema).drop("h")


def similar_arcs(both: DataFrame) -> DataFrame:
    """(from_node, to_node, n): pairs of nodes that more than one arc joins with the same length to a metre, as a check."""
    return both.where("forward").groupBy("from_node", "to_node", F.round("metres").alias("metres")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("from_node", "to_node", "metres", "n")


def flares(both: DataFrame, oneway: DataFrame, most: float = 40.0) -> DataFrame:
    """(from_node, way_a, way_b, angle): pairs of one-way arcs that leave a node within ``most`` degrees and end at one other node, as a check.

    oneway lists way_id of one-way roads.
    """
    out = both.where("forward").join(oneway.select("way_id").distinct(), "way_id", "left_semi").select("from_node", "to_node", "way_id", "heading")
    a, b = out.alias("a"), out.alias("b")
    on = (F.col("a.from_node") == F.col("b.from_node")) & (F.col("a.to_node") == F.col("b.to_node")) & (F.col("a.way_id") < F.col("b.way_id"))
    turn = F.abs(F.col("a.heading") - F.col("b.heading"))
    turn = F.when(turn > 180, 360 - turn).otherwise(turn)
    return a.join(b, on).where(turn <= most).select("a.from_node", F.col("a.way_id").alias("way_a"), F.col("b.way_id").alias("way_b"), F.round(turn, 6).alias("angle"))
