"""Addresses and places: houses on roads, number ranges, points of interest, cities and countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from . import spatial
from .lines import pairwise

#: How far a house may be from its road in metres, and a city from a place of its name. Fixed values.
HOUSE_METRES, CITY_METRES = 150.0, 30_000.0
CONTINENTS = ("africa", "antarctica", "asia", "europe", "north america", "oceania", "south america", "australia")
MAX_DELTA = 1_000_000


def matched_houses(houses: DataFrame, segments: DataFrame, most: int) -> DataFrame:
    """(id, number, road, pos, share, side): each house with its nearest road segment within ``most`` units and its side of it.

    houses has id, number, street, lat, lon; segments road, name, pos, lat, lon, to_lat, to_lon. If a segment of a road with the
    house's street name is near enough, only such roads count.
    """
    spots = houses.select("id", "lat", "lon")
    own = spatial.nearest_segment(spots, segments.drop("name"), most)
    named = houses.where("street is not null").select("id", F.col("street").alias("name"), "lat", "lon")
    by_name = spatial.nearest_segment(named, segments, most, named=True)
    both = own.join(by_name.select("id", F.struct("road", "pos", "share").alias("n")), "id", "left")
    pick = F.coalesce("n", F.struct("road", "pos", "share"))
    found = both.select("id", pick.alias("p")).select("id", "p.*").join(houses.select("id", "number", F.col("lat").alias("y"), F.col("lon").alias("x")), "id")
    out = found.join(segments.select("road", "pos", "lat", "lon", "to_lat", "to_lon"), ["road", "pos"])
    return out.select("id", "number", "road", "pos", "share", spatial.side_of(F.col("y"), F.col("x"), F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")).alias("side"))


def number_ranges(houses: DataFrame) -> DataFrame:
    """(road, side, part, style, first, last, low, high, n): ranges of house numbers along each side of a road.

    houses has road, side, pos, share, number. Numbers follow the road; a part ends where the direction
    of the numbers turns or even ones give way to odd ones. style is E, O or B.
    """
    along = Window.partitionBy("road", "side").orderBy("pos", "share", "number")
    one = houses.groupBy("road", "side", "pos", "share", "number").agg(F.count(F.lit(1)).alias("same")).drop("same")
    steps = one.withColumn("before", F.lag("number").over(along)).withColumn("way", F.signum(F.col("number") - F.col("before")).cast("int"))
    steps = steps.withColumn("trend", F.last(F.when(F.col("way") != 0, F.col("way")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    turns = (F.col("trend").isNotNull() & (F.col("way") != 0) & (F.col("way") != F.col("trend"))) | ((F.col("number") - F.col("before")) % 2 != 0)
    # A part that has just begun has no trend yet, so the turn after a turn does not count again.
    parts = steps.withColumn("turns", F.coalesce(turns, F.lit(False))).withColumn("part", F.sum(F.col("turns").cast("int")).over(along))
    n = F.count(F.lit(1))
    odd = F.sum(F.abs(F.col("number")) % 2)
    style = F.when(odd == 0, "E").when(odd == n, "O").otherwise("B")
    at = F.struct("pos", "share", "number")
    return parts.groupBy("road", "side", "part").agg(style.alias("style"), F.min_by("number", at).alias("first"), F.max_by("number", at).alias("last"), F.min("number").alias("low"), F.max("number").alias("high"), n.alias("n"))


def plausible_side(style: Column, start: Column, end: Column) -> Column:
    """Whether one side's range can be: not too wide, and even or odd at both ends as its style says."""
    odd = (F.abs(start) % 2 != 0) & (F.abs(end) % 2 != 0)
    even = (start % 2 == 0) & (end % 2 == 0)
    return (F.abs(start - end) <= MAX_DELTA) & F.when(style == "E", even).when(style == "O", odd).otherwise(True)


def plausible(left: Column, right: Column) -> Column:
    """Whether the ranges of both sides (structs of style, start, end, city, zip) can be together.

    Ranges that overlap are not, unless they are one number, of different styles, or of different cities or zips.
    """
    each = plausible_side(left["style"], left["start"], left["end"]) & plausible_side(right["style"], right["start"], right["end"])
    one_sided = (left["style"] == "N") | (right["style"] == "N")
    apart = ~left["city"].eqNullSafe(right["city"]) | ~left["zip"].eqNullSafe(right["zip"])
    alike = (left["style"] == right["style"]) | (left["style"] == "B") | (right["style"] == "B")
    low = lambda s: F.least(s["start"], s["end"])
    high = lambda s: F.greatest(s["start"], s["end"])
    clear = (low(right) > high(left)) | (high(right) < low(left))
    single = (left["start"] == left["end"]) & (right["start"] == right["end"]) & (left["start"] == right["start"])
    return each & (one_sided | apart | ~alike | clear | single)


def contained(side: Column, number: Column) -> Column:
    """Whether a side's range holds a number of its style."""
    fits = F.when(side["style"] == "E", number % 2 == 0).when(side["style"] == "O", F.abs(number) % 2 != 0).otherwise(side["style"] == "B")
    return fits & number.between(F.least(side["start"], side["end"]), F.greatest(side["start"], side["end"]))


def count_matches(left: Column, right: Column, number: Column) -> Column:
    """On how many sides a number is; both sides being that number alone count once."""
    n = contained(left, number).cast("int") + contained(right, number).cast("int")
    single = (left["start"] == left["end"]) & (right["start"] == right["end"])
    return F.when((n > 1) & single, 1).otherwise(n)


def similar(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether two pairs of ranges are the same but for their place."""
    out = F.lit(True)
    for s, o in zip(a, b):
        for f in ("style", "start", "end"):
            out = out & s[f].eqNullSafe(o[f])
    return out


def interpolation_ways(ways: DataFrame, way_nodes: DataFrame, houses: DataFrame) -> DataFrame:
    """(way_id, kind, node_ids): the house nodes, in order, of ways that give numbers by interpolation.

    ways has way_id and kind, which must be odd, even, all, 1 or 2; houses node_id and number. Two nodes at least are needed.
    """
    known = ways.where(F.col("kind").isin("odd", "even", "all", "1", "2")).select("way_id", "kind")
    on = way_nodes.join(known, "way_id").join(houses.where("number is not null").select("node_id"), "node_id", "left_semi")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"])
    return on.groupBy("way_id", "kind").agg(ids.alias("node_ids")).where(F.size("node_ids") > 1)


def interpolated_houses(ways: DataFrame, houses: DataFrame) -> DataFrame:
    """(way_id, part, nth, number, lat, lon): the numbers between two neighbouring house nodes, at even distances.

    ways is ``interpolation_ways``; houses has node_id, number (an int), lat, lon. The step is 2 for odd, even and
    2, else 1; ends whose numbers do not fit the kind or are equal give nothing.
    """
    pairs = ways.select("way_id", "kind", F.posexplode(pairwise(F.col("node_ids"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("part", "p")).select("way_id", "kind", "part", "p.a", "p.b")
    end = lambda c: houses.select(F.col("node_id").alias(c), F.struct("number", "lat", "lon").alias(f"h{c}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    one, two = F.col("ha.number"), F.col("hb.number")
    step = F.when(F.col("kind").isin("odd", "even", "2"), 2).otherwise(1)
    fits = F.when(F.col("kind") == "odd", (one % 2 != 0) & (two % 2 != 0)).when(F.col("kind") == "even", (one % 2 == 0) & (two % 2 == 0)).otherwise((two - one) % step == 0)
    both = both.where(fits & (F.abs(two - one) > step)).withColumn("step", F.when(two > one, step).otherwise(-step))
    steps = F.sequence(one + F.col("step"), two - F.col("step"), F.col("step"))
    each = both.select("way_id", "part", "ha", "hb", F.posexplode(steps).alias("nth", "number"), F.size(steps).alias("n"))
    at = lambda axis: F.floor(F.col(f"ha.{axis}") + (F.col(f"hb.{axis}") - F.col(f"ha.{axis}")) * (F.col("nth") + 1) / (F.col("n") + 1) + 0.5).cast("int").alias(axis)
    return each.select("way_id", "part", "nth", "number", at("lat"), at("lon"))


def street_houses(members: DataFrame, houses: DataFrame, names: DataFrame) -> DataFrame:
    """(id, street): houses with the street that a street relation gives those without one.

    members has rel_id, role and member_id; names rel_id and name. The relation of least id with a name counts.
    """
    mine = members.where(F.col("role").isin("house", "address", "addr:houselink")).select("rel_id", F.col("member_id").alias("id")).join(names.where("name is not null").select("rel_id", "name"), "rel_id")
    first = mine.groupBy("id").agg(F.min(F.struct("rel_id", "name")).alias("f")).select("id", F.col("f.name").alias("given"))
    return houses.join(first, "id", "left").withColumn("street", F.coalesce("street", "given")).drop("given")


def area_points(ways: DataFrame, labels: DataFrame) -> DataFrame:
    """(way_id, lat, lon, labelled): a point for each closed way: its first corner of the best label order, else its centre.

    ways has way_id and points with node_id; labels node_id and place, its rank among label tags from 0.
    """
    closed = ways.where((F.size("points") > 2) & (F.element_at("points", 1)["node_id"] == F.element_at("points", -1)["node_id"]))
    corners = closed.select("way_id", F.posexplode("points").alias("pos", "p")).select("way_id", "pos", "p.node_id", "p.lat", "p.lon")
    best = corners.join(labels, "node_id").groupBy("way_id").agg(F.min(F.struct("place", "pos", "lat", "lon")).alias("b"))
    out = closed.select("way_id", geo.centre_of(F.col("points")).alias("c")).join(best, "way_id", "left")
    return out.select("way_id", F.coalesce("b.lat", "c.lat").alias("lat"), F.coalesce("b.lon", "c.lon").alias("lon"), F.col("b").isNotNull().alias("labelled"))


def line_points(ways: DataFrame) -> DataFrame:
    """(way_id, kind, nth, lat, lon): points of open ways: start, end, inner ones without doubles, and mid, halfway along."""
    n, p = F.size("points"), F.col("points")
    first, last = F.element_at(p, 1), F.element_at(p, -1)
    row = lambda kind, nth, lat, lon: F.struct(F.lit(kind).alias("kind"), nth.cast("int").alias("nth"), lat.alias("lat"), lon.alias("lon"))
    ends = F.array(row("start", F.lit(0), first["lat"], first["lon"]), row("end", n - 1, last["lat"], last["lon"]))
    changes = pairwise(F.slice(p, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(((a["lat"] == b["lat"]) & (a["lon"] == b["lon"])).alias("same"), b.alias("p")))
    inner = F.transform(F.filter(F.transform(changes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: ~y["x"]["same"]), lambda y: row("inner", y["i"] + 1, y["x"]["p"]["lat"], y["x"]["p"]["lon"]))
    deg = lambda *v: [geo.degrees(x) for x in v]
    metres = pairwise(p, lambda a, b: geo.distance(*deg(a["lat"], a["lon"], b["lat"], b["lon"])))
    half = F.aggregate(metres, F.lit(0.0), lambda s, x: s + x) / 2
    found = F.aggregate(
        metres, F.struct(half.alias("left"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("double").alias("share")),
        lambda s, x: F.struct(
            (s["left"] - x).alias("left"), (s["i"] + 1).alias("i"), F.coalesce(s["at"], F.when(s["left"] <= x, s["i"])).alias("at"),
            F.coalesce(s["share"], F.when((s["left"] <= x) & (x > 0), s["left"] / x)).alias("share"),
        ),
    )
    ways = ways.where(n > 1).where((first["lat"] != last["lat"]) | (first["lon"] != last["lon"]))
    out = ways.select("way_id", "points", F.concat(ends, inner).alias("rows"), found.alias("m"))
    a, b = F.element_at(p, F.col("m.at") + 1), F.element_at(p, F.col("m.at") + 2)
    lat, lon = geo.between(a["lat"], a["lon"], b["lat"], b["lon"], F.col("m.share"), geo.UNITS_24)
    mid = F.when(F.col("m.share").isNotNull(), F.array(row("mid", F.col("m.at"), lat, lon)))
    every = F.concat("rows", F.coalesce(mid, F.slice(F.col("rows"), 1, 0)))
    return out.select("way_id", F.explode(every).alias("r")).select("way_id", "r.*")


def relation_points(relations: DataFrame, members: DataFrame) -> DataFrame:
    """(rel_id, lat, lon, source): the place of an area relation: its label node, else the admin centre, of the same name, else its centre.

    relations has rel_id, name, administrative, lat, lon (the centre); members rel_id, pos, role, name, lat, lon of nodes.
    """
    own = relations.select("rel_id", "name", "administrative").join(members.select("rel_id", "pos", "role", F.col("name").alias("n"), F.col("lat").alias("y"), F.col("lon").alias("x")), "rel_id").where("name = n")
    label = F.min(F.when(F.col("role") == "label", F.struct("pos", "y", "x"))).alias("label")
    centre = F.max(F.when((F.col("role") == "admin_centre") & F.col("administrative"), F.struct("pos", "y", "x"))).alias("centre")
    out = relations.join(own.groupBy("rel_id").agg(label, centre), "rel_id", "left")
    source = F.when(F.col("label").isNotNull(), "label").when(F.col("centre").isNotNull(), "admin_centre").otherwise("middle")
    return out.select("rel_id", F.coalesce("label.y", "centre.y", "lat").alias("lat"), F.coalesce("label.x", "centre.x", "lon").alias("lon"), source.alias("source"))


def split_is_in(is_in: Column, region_offset: Column) -> Column:
    """The struct (country, region) of an is_in text: 'county, state, country, continent', the other way round, or without a continent.

    Without a continent the last item must be a country that is known. region_offset tells how many items from the country the region is.
    """
    items = F.transform(F.split(is_in, ","), lambda s: F.trim(s))
    n = F.size(items)
    continent = lambda s: F.lower(s).isin(*CONTINENTS)
    known = F.upper(text.country_iso(F.element_at(items, -1))).isin(sorted(set(text.COUNTRIES.values())))
    at = lambda i: F.when((i >= 1) & (i <= n), F.get(items, i - 1))
    from_end = lambda country, offset: F.struct(at(country).alias("country"), at(country - offset).alias("region"))
    last = from_end(n - 1, region_offset)
    first = F.struct(at(F.lit(2)).alias("country"), at(F.lit(2) + region_offset).alias("region"))
    return F.when((n > 1) & continent(F.element_at(items, -1)), last).when((n > 1) & continent(F.element_at(items, 1)), first).when(known, from_end(n, region_offset))


def filled_places(points: DataFrame) -> DataFrame:
    """points (name, country, region, city, is_in) with what their is_in tells, countries by their code, and the own name as city if country and region are known."""
    info = split_is_in(F.col("is_in"), F.lit(1))
    out = points.withColumn("i", info).withColumn("country", text.country_iso(F.coalesce("country", "i.country"))).withColumn("region", F.coalesce("region", "i.region"))
    return out.withColumn("city", F.coalesce("city", F.when(F.col("country").isNotNull() & F.col("region").isNotNull(), F.col("name")))).drop("i")


def cities_by_is_in(places: DataFrame, cities: DataFrame, most: int) -> DataFrame:
    """(id, city, d2): the nearest city whose name stands in a place's is_in, within ``most`` units."""
    named = places.where("is_in is not null").select("id", F.explode(F.array_distinct(F.transform(F.split("is_in", ","), lambda s: F.trim(s)))).alias("name"), "lat", "lon")
    return spatial.nearest_named(named, cities, most)


def autofilled(places: DataFrame, cities: DataFrame, most: int) -> DataFrame:
    """places (id, city, zip, country, region, is_in, lat, lon) with gaps filled from the city named in is_in, else from the nearest city of all.

    cities has city, name, zip, country, region, lat, lon. A nearest city must have a country.
    """
    whole = cities.select(F.col("city").alias("other"), F.col("name").alias("c_city"), F.col("zip").alias("c_zip"), F.col("country").alias("c_country"), F.col("region").alias("c_region"))
    by_name = cities_by_is_in(places, cities, most).select("id", F.col("city").alias("other"))
    rest = places.join(by_name, "id", "left_anti").select("id", "lat", "lon")
    near = spatial.nearest(rest, cities.where("country is not null").select(F.col("city").alias("other_id"), "lat", "lon"), most).select("id", F.col("other_id").alias("other"), F.lit(True).alias("far"))
    chosen = by_name.withColumn("far", F.lit(False)).unionByName(near).join(whole, "other")
    out = places.join(chosen.drop("other"), "id", "left")
    only_far = lambda c: F.when(F.col("far"), F.col(c))
    return out.select("id", F.coalesce("city", "c_city").alias("city"), F.coalesce("zip", "c_zip").alias("zip"), F.coalesce("country", only_far("c_country")).alias("country"), F.coalesce("region", only_far("c_region")).alias("region"))
