"""Geometry of points in map units, as native expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
UNITS_24, UNITS_30 = 1 << 24, 1 << 30


def map_units(degrees: Column, units: int = UNITS_24) -> Column:
    """Degrees to units of 360 / units degrees, rounded half away from zero."""
    half = 180.0 / units
    return ((degrees + F.when(degrees > 0, half).otherwise(-half)) * units / 360.0).cast("int")


def degrees(units: Column, scale: int = UNITS_24) -> Column:
    return units * 360.0 / scale


def low_precision(high: Column) -> Column:
    """30-bit units as 24-bit ones."""
    return F.shiftright(high + 32, 6)


def rounded_units(units: Column, shift: int) -> Column:
    """Units at a lower resolution: to the next multiple of 2**shift."""
    return units.bitwiseAND(F.lit(0)) if shift > 30 else F.shiftleft(F.shiftright(units + ((1 << shift) >> 1), shift), shift)


def point_key(lat: Column, lon: Column) -> Column:
    """Both coordinates in one long."""
    return F.shiftleft(lat.cast("long"), 32).bitwiseOR(lon.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def inlined(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value): where code is generated, a value used twice is found and computed once."""
    return body(value)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; for functions over arrays, which are interpreted and share nothing."""
    return F.element_at(F.transform(F.array(value), body), 1)


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column, bind=inlined) -> Column:
    """Metres over a short distance; arguments in degrees."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return bind(x, lambda x: bind(y, lambda y: F.sqrt(x * x + y * y) * EARTH))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    return F.asin(F.sqrt(a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b)) * 2 * EARTH


def rhumb(lat1: Column, lon1: Column, lat2: Column, lon2: Column, bind=inlined) -> Column:
    """Metres along the line of constant bearing."""
    stretched = F.log(F.tan(F.radians(lat2) / 2 + math.pi / 4) / F.tan(F.radians(lat1) / 2 + math.pi / 4))

    def metres(d_lat: Column) -> Column:
        d_lon = bind(F.radians(lon2 - lon1), lambda turn: F.when(F.abs(turn) > math.pi, F.when(turn > 0, turn - 2 * math.pi).otherwise(turn + 2 * math.pi)).otherwise(turn))
        q = bind(stretched, lambda s: F.when(F.abs(s) > 1e-10, d_lat / s).otherwise(F.cos(F.radians(lat1))))
        return bind(d_lon, lambda d_lon: bind(q, lambda q: F.sqrt(d_lat * d_lat + q * q * d_lon * d_lon) * EARTH))

    return bind(F.radians(lat2 - lat1), metres)


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, bind=inlined) -> Column:
    """Equirectangular under 10 km, else along the rhumb line."""
    return bind(equirectangular(lat1, lon1, lat2, lon2, bind), lambda near: F.when(near < 10_000, near).otherwise(rhumb(lat1, lon1, lat2, lon2, bind)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees of the great circle's start, -180 to 180."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.degrees(F.atan2(y, x))


def cross(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat3: Column, lon3: Column) -> Column:
    """Twice the signed area of three points, exact in longs."""
    a = lambda c: c.cast("long")
    return (a(lat2) - a(lat1)) * (a(lon3) - a(lon1)) - (a(lon2) - a(lon1)) * (a(lat3) - a(lat1))


def straightness(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat3: Column, lon3: Column) -> Column:
    """'spike' where the third point lies back towards the first, 'straight', or 'bent'."""
    a = lambda c: c.cast("long")
    ahead = (a(lat2) - a(lat1)) * (a(lat3) - a(lat2)) + (a(lon2) - a(lon1)) * (a(lon3) - a(lon2))
    on_line = cross(lat1, lon1, lat2, lon2, lat3, lon3) == 0
    return F.when(on_line & (ahead < 0), "spike").when(on_line, "straight").otherwise("bent")


def signed_area(points: Column) -> Column:
    """Twice the signed area of a ring of (lat, lon) structs; positive is clockwise."""
    n = F.size(points)
    steps = F.when(n > 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def term(i: Column) -> Column:
        here, after = F.element_at(points, i), F.element_at(points, i % n + 1)
        return (after["lon"] - here["lon"]).cast("long") * (here["lat"] + after["lat"]).cast("long")

    return F.aggregate(F.transform(steps, term), F.lit(0).cast("long"), lambda s, x: s + x)


def rhumb_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees of the shorter line of constant bearing, -180 to 180."""
    turn = F.radians(lon2 - lon1)
    d_lon = F.when(F.abs(turn) > math.pi, F.when(turn > 0, turn - 2 * math.pi).otherwise(turn + 2 * math.pi)).otherwise(turn)
    return F.degrees(F.atan2(d_lon, _stretched(lat1, lat2)))


def _stretched(lat1: Column, lat2: Column) -> Column:
    return F.log(F.tan(F.radians(lat2) / 2 + math.pi / 4) / F.tan(F.radians(lat1) / 2 + math.pi / 4))


def rhumb_destination(lat: Column, lon: Column, bearing_: Column, metres: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of the point so far away on a line of constant bearing."""
    along = metres / EARTH
    up = along * F.cos(F.radians(bearing_))
    raw = F.radians(lat) + up
    new = F.when(raw > math.pi / 2, math.pi - raw).when(raw < -math.pi / 2, -math.pi - raw).otherwise(raw)
    stretched = _stretched(lat, F.degrees(new))
    q = F.when(F.abs(stretched) > 1e-11, up / stretched).otherwise(F.cos(F.radians(lat)))
    turned = F.radians(lon) + along * F.sin(F.radians(bearing_)) / q
    return F.degrees(new), F.degrees(F.pmod(turned + math.pi, F.lit(2 * math.pi)) - math.pi)


#: Mean radius, for offsets along great circles. Fixed value.
MEAN_EARTH = 6371000.0


def offset_point(lat: Column, lon: Column, bearing_: Column, metres: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of the point so far away along the great circle that starts with the bearing."""
    along, turn, up = metres / MEAN_EARTH, F.radians(bearing_), F.radians(lat)
    new = F.asin(F.sin(up) * F.cos(along) + F.cos(up) * F.sin(along) * F.cos(turn))
    side = F.atan2(F.sin(turn) * F.sin(along) * F.cos(up), F.cos(along) - F.sin(up) * F.sin(new))
    return F.degrees(new), F.degrees(F.radians(lon) + side)


def between(lat1: Column, lon1: Column, lat2: Column, lon2: Column, share: Column | float, units: int = UNITS_30) -> tuple[Column, Column]:
    """(lat, lon) in units of the point at a share of the way; straight in units for short ways, else of constant bearing."""
    share = F.lit(share) if isinstance(share, float) else share
    d_lat, d_lon = lat2 - lat1, lon2 - lon1
    flat = (d_lon == 0) | ((F.abs(d_lat) < 1_000_000) & (F.abs(d_lon) < 1_000_000))
    four = [degrees(c, units) for c in (lat1, lon1, lat2, lon2)]
    far = rhumb_destination(four[0], four[1], rhumb_bearing(*four), distance(*four) * share)
    straight = (lat1 + d_lat * share).cast("int"), (lon1 + d_lon * share).cast("int")
    return tuple(F.when(flat, a).otherwise(map_units(b, units)) for a, b in zip(straight, far))


def segment_fraction(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Where the foot of a point lies on a segment, 0 at its start and 1 at its end; degrees, flat."""
    scale = F.cos(F.radians((lat + lat1 + lat2) / 3))
    dx, dy = (lon2 - lon1) * scale, lat2 - lat1
    size = dx * dx + dy * dy
    return F.when(size == 0, F.lit(0.0)).otherwise(((lon - lon1) * scale * dx + (lat - lat1) * dy) / size)


def segment_distance(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres of a point to a segment: to an end, or the height of the triangle by its sides."""
    f = segment_fraction(lat, lon, lat1, lon1, lat2, lon2)
    a, b, c = distance(lat1, lon1, lat, lon), distance(lat, lon, lat2, lon2), distance(lat1, lon1, lat2, lon2)
    half = (a + b + c) / 2
    height = 2 * F.sqrt(F.greatest(half * (half - a) * (half - b) * (half - c), F.lit(0.0))) / c
    return F.when(f <= 0, a).when(f >= 1, b).otherwise(height)


def angle_at(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat3: Column, lon3: Column) -> Column:
    """The turn at the second point, degrees from -180 to 180; 0 is straight on."""
    turn = rhumb_bearing(lat2, lon2, lat3, lon3) - rhumb_bearing(lat2, lon2, lat1, lon1) + 180
    return F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)


def crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The struct (lat, lon) where the segments a-b and c-d meet, rounded; null if they do not or are parallel.

    Points are structs of units; all products are exact in longs up to 30-bit units.
    """
    x = lambda p: p["lon"].cast("long")
    y = lambda p: p["lat"].cast("long")
    by = (y(b) - y(a)) * (x(d) - x(c)) - (y(d) - y(c)) * (x(b) - x(a))
    on_ab = ((y(d) - y(c)) * (x(a) - x(d)) - (y(a) - y(d)) * (x(d) - x(c))) / by
    on_cd = ((y(b) - y(a)) * (x(a) - x(c)) - (y(a) - y(c)) * (x(b) - x(a))) / by
    meets = (by != 0) & on_ab.between(0, 1) & on_cd.between(0, 1)
    at = lambda v, p, q: F.floor(v(p) + on_ab * (v(q) - v(p)) + 0.5).cast("int")
    return F.when(by != 0, F.when(meets, F.struct(at(y, a, b).alias("lat"), at(x, a, b).alias("lon"))))


def centre_of(points: Column) -> Column:
    """The mean (lat, lon) of the corners of a ring or the points of a line, rounded half up; the end that closes a ring counts once."""
    n = F.size(points)
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    own = F.when((n > 1) & (first["lat"] == last["lat"]) & (first["lon"] == last["lon"]), F.slice(points, 1, n - 1)).otherwise(points)
    mean = lambda axis: F.floor(F.aggregate(own, F.lit(0).cast("long"), lambda s, p: s + p[axis]) / F.size(own) + 0.5).cast("int")
    return F.when(n > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))


def bounds(points: Column) -> Column:
    """The box (min_lat, min_lon, max_lat, max_lon) of an array of points."""
    of = lambda axis, pick: pick(F.transform(points, lambda p: p[axis]))
    return F.struct(of("lat", F.array_min).alias("min_lat"), of("lon", F.array_min).alias("min_lon"), of("lat", F.array_max).alias("max_lat"), of("lon", F.array_max).alias("max_lon"))


def box_contains(box: Column, lat: Column, lon: Column) -> Column:
    return lat.between(box["min_lat"], box["max_lat"]) & lon.between(box["min_lon"], box["max_lon"])


def box_inside(box: Column, lat: Column, lon: Column) -> Column:
    """Within a box and not on its edge."""
    return (lat > box["min_lat"]) & (lat < box["max_lat"]) & (lon > box["min_lon"]) & (lon < box["max_lon"])


def box_edge(box: Column, lat: Column, lon: Column) -> Column:
    return box_contains(box, lat, lon) & ~box_inside(box, lat, lon)


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"]) & (a["min_lon"] <= b["max_lon"]) & (b["min_lon"] <= a["max_lon"])


def box_common(a: Column, b: Column) -> Column:
    """The common part of two boxes; null if there is none."""
    part = F.struct(
        F.greatest(a["min_lat"], b["min_lat"]).alias("min_lat"), F.greatest(a["min_lon"], b["min_lon"]).alias("min_lon"),
        F.least(a["max_lat"], b["max_lat"]).alias("max_lat"), F.least(a["max_lon"], b["max_lon"]).alias("max_lon"),
    )
    return F.when(boxes_meet(a, b), part)


def box_split(box: Column, across: int, up: int) -> Column:
    """The across * up parts of a box, from the south-west, row by row; the last ones take what is left over."""

    def cut(low: str, high: str, i: int, n: int) -> tuple[Column, Column]:
        step = F.floor((box[high] - box[low]) / n).cast("int")
        return box[low] + step * i, box[high] if i == n - 1 else box[low] + step * (i + 1)

    out = []
    for j in range(up):
        for i in range(across):
            (s, n), (w, e) = cut("min_lat", "max_lat", j, up), cut("min_lon", "max_lon", i, across)
            out.append(F.struct(s.alias("min_lat"), w.alias("min_lon"), n.alias("max_lat"), e.alias("max_lon")))
    return F.array(*out)


#: Units of 30 bits off the centre of a unit of 24 bits from which a point may take the next one. Fixed value.
MOST_OFF = 16


def alternative_places(lat30: Column, lon30: Column) -> Column:
    """Up to three neighbouring places in 24-bit units for a point of 30 bits that lies near their edge."""

    def other(v: Column) -> tuple[Column, Column]:
        near = low_precision(v)
        off = near * 64 - v
        return near, F.when(off > MOST_OFF, near - 1).when(off < -MOST_OFF, near + 1)

    (lat, lat2), (lon, lon2) = other(lat30), other(lon30)
    at = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("lat"), b.alias("lon")))
    return F.array_compact(F.array(at(lat2, lon2), at(lat2, lon), at(lat, lon2)))


def bilinear(left_bottom: Column, right_bottom: Column, left_top: Column, right_top: Column, x: Column, y: Column) -> Column:
    """A height within a cell, rounded half up; one void corner is filled from the other three, more give null."""
    corners = [left_bottom, right_bottom, left_top, right_top]
    lb, rb, lt, rt = corners
    lb_, rb_, lt_, rt_ = F.coalesce(lb, rb + lt - rt), F.coalesce(rb, lb + rt - lt), F.coalesce(lt, lb + rt - rb), F.coalesce(rt, rb + lt - lb)
    h = lb_ * (1 - x) * (1 - y) + rb_ * x * (1 - y) + lt_ * (1 - x) * y + rt_ * x * y
    return F.floor(h + 0.5).cast("int")


def heading_byte(degrees_: Column) -> Column:
    """A compass heading as one byte."""
    return F.pmod(F.floor(degrees_ * 256.0 / 360.0 + 0.5).cast("int"), F.lit(256))
