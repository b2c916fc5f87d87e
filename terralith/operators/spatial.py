"""Spatial joins by grid cells: equi-joins that Spark can distribute and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import sweep
from .work import cut

#: The widest distance of two points in units of any resolution used here.
_WIDEST = 1 << 31


def _cell(value, size: int):
    return F.floor(value / size).cast("long")


def squared(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    y, x = lat1.cast("long") - lat2, lon1.cast("long") - lon2
    return y * y + x * x


def cells_of(box: Column, cell: int) -> Column:
    """The cells (cx, cy) that a box covers."""
    across = F.sequence(_cell(box["min_lon"], cell), _cell(box["max_lon"], cell))
    up = F.sequence(_cell(box["min_lat"], cell), _cell(box["max_lat"], cell))
    return F.flatten(F.transform(across, lambda x: F.transform(up, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: int) -> DataFrame:
    """Pairs of point and box columns; a box takes part in every cell it covers."""
    box = F.struct("min_lat", "min_lon", "max_lat", "max_lon")
    boxes = boxes.withColumn("c", F.explode(cells_of(box, cell))).withColumn("cx", F.col("c.cx")).withColumn("cy", F.col("c.cy")).drop("c")
    points = points.withColumn("cx", _cell(F.col("lon"), cell)).withColumn("cy", _cell(F.col("lat"), cell))
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
    return points.join(boxes, ["cx", "cy"]).where(inside).drop("cx", "cy")


def ring_contains(ring: Column, lat: Column, lon: Column) -> Column:
    """Whether a point is in a ring of (lat, lon) structs, closed or not, by crossings of a ray to the east; exact in longs.

    A point on a southern or western edge is inside, one on a northern or eastern edge is not.
    """
    n = F.size(ring)
    after = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, F.least(n, F.lit(1))))

    def crosses(a: Column, b: Column) -> Column:
        y1, x1, y2, x2 = (v.cast("long") for v in (a["lat"], a["lon"], b["lat"], b["lon"]))
        side = (x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1)
        return ((y1 > lat) != (y2 > lat)) & F.when(y2 > y1, side > 0).otherwise(side < 0)

    hits = F.zip_with(ring, after, crosses)
    return F.size(F.filter(hits, lambda h: h)) % 2 == 1


def points_in_areas(points: DataFrame, areas: DataFrame, cell: int) -> DataFrame:
    """Pairs of a point (lat, lon, ..) and the area (ring, ..) that it is in: cells, then boxes, then the ring itself."""
    box = geo.bounds(F.col("ring"))
    areas = areas.where(F.size("ring") > 2).withColumn("_box", box).withColumn("_c", F.explode(cells_of(box, cell)))
    points = points.withColumn("_c", F.struct(_cell(F.col("lon"), cell).alias("cx"), _cell(F.col("lat"), cell).alias("cy")))
    met = points.join(areas, "_c").where(geo.box_contains(F.col("_box"), F.col("lat"), F.col("lon")))
    return met.where(ring_contains(F.col("ring"), F.col("lat"), F.col("lon"))).drop("_c", "_box")


def _around(df: DataFrame, cell: int, *keep: str) -> DataFrame:
    """Each row in its own cell and the eight around it."""
    step = F.sequence(F.lit(-1), F.lit(1))
    out = df.select(*keep, "lat", "lon", _cell(F.col("lon"), cell).alias("x"), _cell(F.col("lat"), cell).alias("y"))
    out = out.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    return out.select(*keep, "lat", "lon", (F.col("x") + F.col("dx")).alias("cx"), (F.col("y") + F.col("dy")).alias("cy"))


def within_radius(points: DataFrame, others: DataFrame, radius: int) -> DataFrame:
    """(id, other_id, d2): pairs with a squared distance up to radius**2, by neighbouring cells.

    points has id, lat, lon; others has other_id, lat, lon. Rows without a place are in no pair.
    """
    right = others.select("other_id", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), _cell(F.col("lon"), radius).alias("cx"), _cell(F.col("lat"), radius).alias("cy"))
    pairs = _around(points, radius, "id").join(right, ["cx", "cy"]).withColumn("d2", squared(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")))
    return pairs.where(F.col("d2") <= radius * radius).select("id", "other_id", "d2")


#: A search begins in squares that hold this many different places at most.
_FEW = 16


def _nearest_by_key(points: DataFrame, others: DataFrame, first: int, most: int | None) -> DataFrame:
    """(id, other_id, d2) of the nearest other of a point's own key ``_k``, the least other_id among equals, up to ``most`` away.

    Sides are powers of 4. Those of a key begin with the widest one, up to ``first``, whose squares hold few places each; a point
    that finds nothing within a side looks again with the next one. So the pairs of a point do not grow with the tables.
    Others are read as places: many in one spot count as the least of them.
    """
    places = cut(others.where("lat is not null and lon is not null and _k is not null").groupBy("_k", "lat", "lon").agg(F.min("other_id").alias("other_id")))
    side = lambda e: F.pow(F.lit(4.0), e)
    top = min(max((first.bit_length() - 1) // 2, 0), 16)
    levels = places.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(top)))).groupBy("_k", "e", F.floor(F.col("lat") / side(F.col("e"))).alias("cy"), F.floor(F.col("lon") / side(F.col("e"))).alias("cx")).agg(F.count(F.lit(1)).alias("n"))
    fits = levels.groupBy("_k", "e").agg(F.max("n").alias("n")).groupBy("_k").agg(F.coalesce(F.max(F.when(F.col("n") <= _FEW, F.col("e"))), F.lit(0)).alias("e"))
    places = cut(places.join(fits, "_k"))
    rest = points.where("lat is not null and lon is not null").select("id", "_k", "lat", "lon").join(fits, "_k")
    widest = min(most or _WIDEST, _WIDEST)
    step = F.sequence(F.lit(-1), F.lit(1))
    none = points.limit(0).select("id", F.lit(None).cast(places.schema["other_id"].dataType).alias("other_id"), F.lit(None).cast("long").alias("d2"))
    found, nth = none, 0
    while nth == 0 or not rest.isEmpty():
        r = F.least(side(F.col("e") + nth), F.lit(float(widest))).cast("long")
        cell = lambda c: F.floor(F.col(c) / r).cast("long")
        right = places.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
        right = right.select("_k", (cell("lon") + F.col("dx")).alias("cx"), (cell("lat") + F.col("dy")).alias("cy"), "other_id", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
        pairs = rest.withColumn("r", r).withColumn("cx", cell("lon")).withColumn("cy", cell("lat")).join(right, ["_k", "cx", "cy"]).withColumn("d2", squared(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")))
        # The last round of a search without a bound takes the nearest of all that are left.
        near = pairs.where((F.col("d2") <= F.col("r") * F.col("r")) if most else (F.col("d2") <= F.col("r") * F.col("r")) | (F.col("r") >= _WIDEST))
        best = cut(near.groupBy("id", "_k").agg(F.min(F.struct("d2", "other_id")).alias("b")).select("id", "_k", "b.other_id", "b.d2"))
        found = found.unionByName(best.drop("_k"))
        rest = cut(rest.where(r < widest).join(best, ["id", "_k"], "left_anti"))
        nth += 1
    return found.groupBy("id").agg(F.min(F.struct("d2", "other_id")).alias("b")).select("id", "b.other_id", "b.d2")


def nearest(points: DataFrame, others: DataFrame, radius: int) -> DataFrame:
    """(id, other_id, d2) of the nearest other, the least other_id among equals.

    The search begins within ``radius`` at most, nearer where others are dense, and grows for the points that have found
    nothing. A point without a place has null for its other, and so have all points if there is no other with a place.
    """
    one = lambda df, *c: df.select(*c, "lat", "lon", F.lit(0).alias("_k"))
    found = _nearest_by_key(one(points, "id"), one(others, "other_id"), radius, None)
    nothing = points.select("id").distinct().join(found, "id", "left_anti")
    return found.unionByName(nothing.select("id", F.lit(None).cast(found.schema["other_id"].dataType).alias("other_id"), F.lit(None).cast("long").alias("d2")))


def nearest_named(points: DataFrame, cities: DataFrame, most: int) -> DataFrame:
    """(id, city, d2): the nearest city of a point's own name, ``most`` units away at the furthest.

    points has id, name, lat, lon; cities has city, name, lat, lon. Name and cell are the key of the
    join, so a common name does not bring all its cities to all its points; each name has cells of its own size.
    """
    keyed = lambda df, *c: df.select(*c, "lat", "lon", F.col("name").alias("_k"))
    return _nearest_by_key(keyed(points, "id"), keyed(cities, F.col("city").alias("other_id")), most, most).select("id", F.col("other_id").alias("city"), "d2")


def nearest_segment(points: DataFrame, segments: DataFrame, most: int, named: bool = False) -> DataFrame:
    """(id, road, pos, d2, share): the nearest road segment of each point within ``most`` units; ``named``: of those that bear its name.

    points has id, lat, lon (and name); segments has road, pos, lat, lon, to_lat, to_lon (and name). Distances are flat, in
    squared units; the least (road, pos) counts among equals. Squares of points meet parts of the segments that reach them, and
    a point's distance so far bounds where later segments of a part look for it (``sweep``).
    """
    name = ["name"] if named else []
    spots = points.select("id", "lat", "lon", *name).where(" and ".join(f"{c} is not null" for c in ["lat", "lon", *name]))
    lines = segments.select("road", "pos", "lat", "lon", "to_lat", "to_lon", *name).where(" and ".join(f"{c} is not null" for c in ["lat", "lon", "to_lat", "to_lon", *name]))
    placed, chunks, n = sweep.tiled(spots, most)
    left, right = sweep.groups_of(placed, lines, chunks, n)
    of = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"id {of(spots, 'id')}, road {of(lines, 'road')}, pos {of(lines, 'pos')}, d2 double, share double"
    near = left.groupBy("_g").cogroup(right.groupBy("_g")).applyInArrow(sweep.nearest_in_group(most, named), schema)
    return near.groupBy("id").agg(F.min(F.struct("d2", "road", "pos", "share")).alias("b")).select("id", "b.road", "b.pos", "b.d2", "b.share")


def side_of(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """On which side of a directed segment a point is: 'left', 'right' or 'on'."""
    c = geo.cross(lat1, lon1, lat2, lon2, lat, lon)
    return F.when(c > 0, "left").when(c < 0, "right").otherwise("on")


_ENDS = ("lat", "lon", "to_lat", "to_lon")


def _met(segments: DataFrame, borders: DataFrame, kernel, schema: str) -> DataFrame:
    """What a kernel makes of borders in chunks and of parts of the segments; equal rows count once on both sides."""
    whole = " and ".join(f"{c} is not null" for c in _ENDS)
    lines = segments.select("road", "pos", *_ENDS).where(whole).dropDuplicates()
    edges = borders.select("border", "pos", *_ENDS).where(whole).dropDuplicates()
    n = max(-(-edges.count() // sweep.PER_GROUP), 1)
    edges = edges.withColumn("_chunk", F.pmod(F.xxhash64("border", "pos", *_ENDS), F.lit(n)).cast("int"))
    left, right = sweep.groups_of(edges, lines, segments.sparkSession.range(n).select(F.col("id").cast("int").alias("_chunk")), n)
    of = lambda df, c: df.schema[c].dataType.simpleString()
    schema = schema.format(road=of(lines, "road"), pos=of(lines, "pos"), border=of(edges, "border"), b_pos=of(edges, "pos"))
    return left.groupBy("_g").cogroup(right.groupBy("_g")).applyInArrow(kernel, schema)


def crossings(segments: DataFrame, borders: DataFrame, snap: int = 0) -> DataFrame:
    """(road, pos, border, b_pos, lat, lon, at): where road segments cross border segments.

    Both have pos, lat, lon, to_lat, to_lon, roads have road and borders border. ``at`` tells whether
    the place is taken by the segment's 'start' or 'end', that is up to ``snap`` units away and the
    nearer one, or is a new node, 'between'.
    """
    return _met(segments, borders, sweep.rows_in_group(snap), "road {road}, pos {pos}, border {border}, b_pos {b_pos}, lat int, lon int, at string")


def crossing_counts(segments: DataFrame, borders: DataFrame, snap: int = 0) -> DataFrame:
    """(border, at, n): the rows of ``crossings`` counted where they are found, so that none of them is moved."""
    return _met(segments, borders, sweep.counts_in_group(snap), "border {border}, at string, n long").groupBy("border", "at").agg(F.sum("n").alias("n"))


def pyramid(points: DataFrame, side: int, least: int) -> DataFrame:
    """(depth, cx, cy, n, above): points by square cell for sides from ``side`` down to ``least``, each half of the one before.

    above is the count of the cell that holds it one depth up. Points are counted once, at the finest
    cells; these counts are rolled up. side must be least times a power of two.
    """
    last = (side // least).bit_length() - 1
    if least << last != side:
        raise ValueError("side must be least times a power of two")
    finest = points.groupBy(_cell(F.col("lon"), least).alias("cx"), _cell(F.col("lat"), least).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    each = finest.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(last))))
    up = lambda c: F.expr(f"shiftright({c}, {last} - depth)")
    counts = each.groupBy("depth", up("cx").alias("cx"), up("cy").alias("cy")).agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy("depth", F.shiftright("cx", 1), F.shiftright("cy", 1)))
    return counts.withColumn("above", F.when(F.col("depth") > 0, above))


def subdivided(points: DataFrame, most: int, side: int, least: int) -> DataFrame:
    """(depth, cx, cy, n): square areas, halved on both sides until they hold ``most`` points.

    points has lat and lon; the first squares are ``side`` wide and none is under ``least``. A square
    is an area if the one above it had too many points and it has not, or cannot be halved.
    """
    levels = pyramid(points, side, least)
    last = (side // least).bit_length() - 1
    opened = (F.col("depth") == 0) | (F.col("above") > most)
    return levels.where(opened & ((F.col("n") <= most) | (F.col("depth") == last))).select("depth", "cx", "cy", "n")


def with_area(points: DataFrame, areas: DataFrame, side: int, least: int) -> DataFrame:
    """Each point with the (depth, cx, cy) of the area of ``subdivided`` that holds it."""
    last = (side // least).bit_length() - 1
    size = F.lit(float(side)) / F.pow(F.lit(2.0), F.col("depth"))
    cells = points.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(last))))
    cells = cells.withColumn("cx", F.floor(F.col("lon") / size).cast("long")).withColumn("cy", F.floor(F.col("lat") / size).cast("long"))
    return cells.join(areas.select("depth", "cx", "cy"), ["depth", "cx", "cy"], "left_semi")
