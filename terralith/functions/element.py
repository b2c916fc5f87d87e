"""Functions of an element, as rules call them: all give strings, null where there is no value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo

#: Kilometres of a mile, as the speed functions count. Fixed value.
MILE = 1.61


def decimal_text(x: Column) -> Column:
    """A number in plain decimals with one place at least."""
    plain = F.regexp_replace(x.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(x) < 1e7) & ((F.abs(x) >= 1e-3) | (x == 0)), x.cast("string")).otherwise(plain)


def way_length(points: Column) -> Column:
    """Metres along an array of (lat, lon) structs in map units."""

    def along(places: Column) -> Column:
        n = F.greatest(F.size(places) - 1, F.lit(0))
        steps = F.zip_with(F.slice(places, 1, n), F.slice(places, 2, n), lambda a, b: geo.distance(a["lat"], a["lon"], b["lat"], b["lon"], geo.bound))
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)

    places = F.transform(points, lambda p: F.struct(geo.degrees(p["lat"]).alias("lat"), geo.degrees(p["lon"]).alias("lon")))
    return F.when(points.isNull(), F.lit(0.0)).otherwise(geo.bound(places, along))


def length(metres: Column) -> Column:
    """``length()``: of a way its own, of a relation the sum over its members."""
    return decimal_text(metres)


def area_size(points: Column, closed: Column) -> Column:
    """``area_size()``: of a closed way of at least four points in square map units, else 0."""
    area = F.abs(geo.signed_area(points)) / 2.0
    return F.when(closed & (F.size(points) >= 4), F.format_string("%.3f", area)).otherwise(F.lit("0"))


def is_closed(points: Column) -> Column:
    """``is_closed()``: more than two points, and the same node at both ends."""
    same = F.element_at(points, 1)["node_id"].eqNullSafe(F.element_at(points, -1)["node_id"])
    return F.when((F.size(points) > 2) & same, "true").otherwise("false")


def truth(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(False)), "true").otherwise("false")


def max_speed(maxspeed: Column, miles: bool = False) -> Column:
    """``maxspeedkmh()`` and ``maxspeedmph()``: null unless the speed is a whole number with a known unit."""
    value = F.trim(F.lower(maxspeed))
    in_miles = value.endswith("mph")
    number = F.when(in_miles, F.regexp_replace(value, r"\s*mph$", "")).otherwise(F.regexp_replace(value, r"\s*(kmh|km/h|kmph)$", ""))
    x = F.when(number.rlike(r"\A[+-]?[0-9]{1,9}\z"), number.try_cast("double"))
    x = F.when(in_miles, x if miles else x * MILE).otherwise(x / MILE if miles else x)
    return F.round(x, 2).cast("string")


#: Further functions of elements by name: (tag_of) -> column.
FUNCTIONS: dict[str, Callable] = {}


def functions_of(kind: str, tag_of, id_: Column | None = None, points: Column | None = None, complete: Column | None = None, metres: Column | None = None) -> dict[str, Column]:
    """The functions that an element of a kind (node, way or relation) has, for ``run_rules``."""
    out = {"type()": F.lit(kind)} | {name: make(tag_of) for name, make in FUNCTIONS.items()}
    if id_ is not None:
        out["osmid()"] = id_.cast("string")
    if kind == "way" and points is not None:
        out |= {"length()": length(way_length(points)), "is_closed()": is_closed(points), "area_size()": area_size(points, is_closed(points) == "true")}
    if kind == "way" and complete is not None:
        out["is_complete()"] = truth(complete)
    if kind == "relation" and metres is not None:
        out["length()"] = length(metres)
    if kind in ("way", "relation"):
        out |= {"maxspeedkmh()": max_speed(tag_of("maxspeed")), "maxspeedmph()": max_speed(tag_of("maxspeed"), miles=True)}
    return out
