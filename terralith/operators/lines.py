"""Filters of lines and shapes: native expressions over arrays of points, Arrow kernels where a fold is needed.

A point is a struct with lat and lon in map units, and what else the caller keeps in it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Points of a line, and the metres of one, at most. Fixed values.
MAX_POINTS, MAX_METRES = 250, 40_000.0
#: The widest shape or line of a subdivision in units of its resolution. Fixed value.
MAX_SIZE = 0x7FFF
#: Density of simplification, metres at the highest resolution. Fixed value.
ERROR = 2.6


def pairwise(points: Column, step) -> Column:
    """step(point, next point) for each two neighbours."""
    n = F.size(points)
    return F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), step)


def _same(a: Column, b: Column) -> Column:
    return (a["lat"] == b["lat"]) & (a["lon"] == b["lon"])


def without_doubles(points: Column) -> Column:
    """Without points at the same place as the one before."""
    later = F.filter(pairwise(points, lambda a, b: F.struct(_same(a, b).alias("same"), b.alias("p"))), lambda x: ~x["same"])
    return F.concat(F.slice(points, 1, 1), F.transform(later, lambda x: x["p"]))


def rounded(points: Column, shift: int) -> Column:
    """Points to the next multiple of 2**shift, without doubles; at shift 0 as they are."""
    if not shift:
        return points
    return without_doubles(F.transform(points, lambda p: p.withField("lat", geo.rounded_units(p["lat"], shift)).withField("lon", geo.rounded_units(p["lon"], shift))))


def predicted_points(points: Column, resolution: int) -> Column:
    """How many points a line keeps once it is rounded to a resolution."""
    shift = 24 - resolution
    at = F.transform(points, lambda p: F.struct(geo.rounded_units(p["lat"], shift).alias("lat"), geo.rounded_units(p["lon"], shift).alias("lon")))
    changes = F.size(F.filter(pairwise(at, lambda a, b: ~_same(a, b)), lambda x: x))
    return F.when(F.size(points) > 0, changes + 1).otherwise(0)


def estimated_size(kind: str, points: Column, resolution: int) -> Column:
    """Bytes that a feature is expected to take: 9 a point, 11 an element and 4 a point of lines and shapes."""
    if kind == "point":
        return F.lit(9)
    n = predicted_points(points, resolution)
    parts = F.floor((n - 1) / MAX_POINTS) + 1
    return F.when(n <= (1 if kind == "line" else 3), 0).otherwise(parts * 11 + n * 4).cast("int")


def dimension(points: Column) -> Column:
    box = geo.bounds(points)
    return F.greatest(box["max_lat"] - box["min_lat"], box["max_lon"] - box["min_lon"])


def large_enough(points: Column, size: int, shift: int, exempt: Column | None = None) -> Column:
    """Whether a feature is at least size << shift wide or high, or exempt from that."""
    big = dimension(points) >= size << shift
    return big if exempt is None else big | F.coalesce(exempt, F.lit(False))


def not_empty(points: Column, kind: str) -> Column:
    return F.size(points) > (1 if kind == "line" else 3)


def split_by_count(points: Column, most: int = MAX_POINTS) -> Column:
    """The pieces of a line of at most ``most`` points; the end of one is the start of the next.

    Pieces are full while at least twice as many points are left; the rest is halved.
    """
    n, step = F.size(points), most - 1
    full = F.when(n >= 2 * most, F.floor((n - 2 * most) / step) + 1).otherwise(0).cast("int")
    at = full * step
    left = n - at
    half = F.floor(left / 2).cast("int") + 1
    wholes = F.transform(F.when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(points, i * step + 1, most))
    rest = F.when(left > most, F.array(F.slice(points, at + 1, half), F.slice(points, at + half, left - half + 1))).otherwise(F.array(F.slice(points, at + 1, left)))
    return F.concat(wholes, rest)


def split_by_length(points: Column, most: float = MAX_METRES) -> Column:
    """The pieces of a line, each cut at the point where it gets ``most`` metres long."""
    deg = lambda *v: [geo.degrees(x) for x in v]
    steps = pairwise(points, lambda a, b: geo.distance(*deg(a["lat"], a["lon"], b["lat"], b["lon"])))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(1).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def fold(s: Column, metres: Column) -> Column:
        over, at = s["run"] + metres >= most, s["at"] + 1
        return F.struct(F.when(over, 0.0).otherwise(s["run"] + metres).alias("run"), at.alias("at"), F.when(over, F.concat(s["cuts"], F.array(at))).otherwise(s["cuts"]).alias("cuts"))

    cuts = F.aggregate(steps, start, fold)["cuts"]
    bounds = F.array_distinct(F.concat(F.array(F.lit(1)), cuts, F.array(F.size(points))))
    return F.when(F.size(points) > 1, F.transform(pairwise(bounds, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: F.slice(points, x["a"], x["b"] - x["a"] + 1)))


def on_box_edge(points: Column, box: tuple[int, int, int, int]) -> Column:
    """Points with ``preserved``, true for those on the edge of (min_lat, min_lon, max_lat, max_lon)."""
    edge = lambda p: p["lat"].isin(box[0], box[2]) | p["lon"].isin(box[1], box[3])
    return F.transform(points, lambda p: p.withField("preserved", edge(p)))


def _lines_of(lines: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(start of each line, lat, lon, points) over all lines of a batch; null lines are empty."""
    values = lines.flatten()
    starts = np.concatenate([[0], np.cumsum(np.nan_to_num(lines.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
    lat = values.field("lat").to_numpy(zero_copy_only=False).astype(np.int64)
    lon = values.field("lon").to_numpy(zero_copy_only=False).astype(np.int64)
    return starts, lat, lon, values


def _kept(lines: pa.ListArray, starts: np.ndarray, values: pa.Array, keep: np.ndarray) -> pa.ListArray:
    """The lines with the points that are kept."""
    sizes = np.concatenate([[0], np.cumsum(keep)])
    return pa.ListArray.from_arrays(pa.array(sizes[starts].astype(np.int32)), values.take(pa.array(np.flatnonzero(keep))), mask=lines.is_null())


def _metres(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Flat distances of points in units, as ``geo.equirectangular``."""
    unit = math.radians(360.0 / geo.UNITS_24)
    x = (lon2 - lon1) * unit * np.cos((lat1 + lat2) / 2 * unit)
    return np.hypot(x, (lat2 - lat1) * unit) * geo.EARTH


def segment_metres(lat, lon, lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres of points to a segment: to its ends, or the height of the triangle by its sides."""
    a, b, c = _metres(lat1, lon1, lat, lon), _metres(lat, lon, lat2, lon2), float(_metres(lat1, lon1, lat2, lon2))
    scale = np.cos(np.radians((lat + lat1 + lat2) / 3 * 360.0 / geo.UNITS_24))
    dx, dy = (lon2 - lon1) * scale, lat2 - lat1
    size = dx * dx + dy * dy
    share = np.divide((lon - lon1) * scale * dx + (lat - lat1) * dy, size, out=np.zeros(len(a)), where=size > 0)
    half = (a + b + c) / 2
    height = 2 * np.sqrt(np.maximum(half * (half - a) * (half - b) * (half - c), 0)) / c if c else a
    return np.where(share <= 0, a, np.where(share >= 1, b, height))


def simplified_mask(lat: np.ndarray, lon: np.ndarray, error: float, fixed: np.ndarray | None = None) -> np.ndarray:
    """Which points of one line stay, if no dropped one may be further than error metres from the line (Douglas-Peucker).

    fixed points stay; each run between them is simplified by itself.
    """
    keep = np.zeros(len(lat), dtype=bool)
    if not len(lat):
        return keep
    keep[[0, -1]] = True
    if fixed is not None:
        keep |= fixed
    ends = np.flatnonzero(keep)
    work = list(zip(ends.tolist(), ends[1:].tolist()))
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        far = segment_metres(lat[a + 1 : b], lon[a + 1 : b], lat[a], lon[a], lat[b], lon[b])
        # Of equally far points the last one is taken.
        at = b - 1 - int(np.argmax(far[::-1]))
        if far[at - a - 1] > error:
            keep[at] = True
            work += [(a, at), (at, b)]
    return keep


def simplified(error: float, points_type: str = "array<struct<lat:int,lon:int>>"):
    """A column function: lines without the points that are nearer than error metres to what is left."""

    @F.arrow_udf(points_type)
    def run(lines: pa.Array) -> pa.Array:
        starts, lat, lon, values = _lines_of(lines)
        fixed = values.field("preserved").to_numpy(zero_copy_only=False).astype(bool) if values.type.get_field_index("preserved") >= 0 else None
        keep = np.zeros(len(lat), dtype=bool)
        for a, b in zip(starts[:-1], starts[1:]):
            keep[a:b] = simplified_mask(lat[a:b], lon[a:b], error, None if fixed is None else fixed[a:b])
        return _kept(lines, starts, values, keep)

    return run


def obsolete_mask(lat: np.ndarray, lon: np.ndarray, shape: bool = False) -> np.ndarray:
    """Which points of one line stay: none that is where the one before is, straight on the line, or the tip of a spike.

    Passes over the whole line go on until nothing changes; in a pass no two neighbours go. A shape may also lose the
    point that closes it, its ring being open here.
    """
    keep = np.arange(len(lat))
    while len(keep) > 2:
        y, x = lat[keep], lon[keep]
        before, after = (np.roll, 1), (np.roll, -1)
        y0, x0, y2, x2 = before[0](y, before[1]), before[0](x, before[1]), after[0](y, after[1]), after[0](x, after[1])
        gone = ((y - y0) * (x2 - x) == (x - x0) * (y2 - y)) | ((y == y0) & (x == x0))
        if not shape:
            gone[[0, -1]] = False
        # Of a run of such points every second one goes in a pass, counted from the first of the run.
        run = np.arange(len(gone)) - np.maximum.accumulate(np.where(gone, -1, np.arange(len(gone))))
        gone &= run % 2 == 1
        if not gone.any():
            break
        keep = keep[~gone]
    if len(keep) == 2 and not shape and lat[keep[0]] == lat[keep[1]] and lon[keep[0]] == lon[keep[1]]:
        keep = keep[:1]
    out = np.zeros(len(lat), dtype=bool)
    out[keep] = True
    return out


def without_obsolete(shape: bool = False, points_type: str = "array<struct<lat:int,lon:int>>"):
    """A column function over lines, or over rings whose first point is not repeated at the end."""

    @F.arrow_udf(points_type)
    def run(lines: pa.Array) -> pa.Array:
        starts, lat, lon, values = _lines_of(lines)
        keep = np.zeros(len(lat), dtype=bool)
        for a, b in zip(starts[:-1], starts[1:]):
            keep[a:b] = obsolete_mask(lat[a:b], lon[a:b], shape)
        return _kept(lines, starts, values, keep)

    return run


def size_cuts(lat: np.ndarray, lon: np.ndarray, most: int) -> list[int]:
    """Places of the points where a line is cut so that no piece is wider or higher than most, unless one segment is."""
    cuts, first, k = [], 0, 1
    while k < len(lat):
        end = k
        low_y = high_y = lat[first]
        low_x = high_x = lon[first]
        while end < len(lat):
            low_y, high_y, low_x, high_x = min(low_y, lat[end]), max(high_y, lat[end]), min(low_x, lon[end]), max(high_x, lon[end])
            if max(high_y - low_y, high_x - low_x) > most and end > first + 1:
                break
            end += 1
        if end == len(lat):
            break
        cuts.append(end - 1)
        first, k = end - 1, end
    return cuts


def split_by_size(most: int, points_type: str = "array<struct<lat:int,lon:int>>"):
    """A column function: the pieces of a line, cut before the point with which one gets wider or higher than most."""

    @F.arrow_udf(f"array<{points_type}>")
    def run(lines: pa.Array) -> pa.Array:
        starts, lat, lon, values = _lines_of(lines)
        pieces, outer, indices, total = [0], [0], [], 0
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            bounds = [0, *size_cuts(lat[a:b], lon[a:b], most), b - a - 1] if b > a else []
            for low, high in zip(bounds, bounds[1:]):
                indices.append(np.arange(a + low, a + high + 1))
                total += high - low + 1
                pieces.append(total)
            outer.append(len(pieces) - 1)
        inner = pa.ListArray.from_arrays(pa.array(pieces, pa.int32()), values.take(pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *indices]))))
        return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner, mask=lines.is_null())

    return run


def smoothed(points: list[tuple[int, int]], step: int) -> list[tuple[int, int]]:
    """A line whose points are the means of neighbours: a new point is set once the mean is ``step`` units from the last one; ends stay."""
    if len(points) <= 5 or step <= 0:
        return points
    out, run = [points[0]], []
    for p in points[1:]:
        run.append(p)
        mean = (sum(y for y, _ in run) // len(run), sum(x for _, x in run) // len(run))
        if abs(mean[0] - out[-1][0]) + abs(mean[1] - out[-1][1]) > step:
            out.append(mean)
            # A point that took part in a mean with others begins the next one.
            run = [p] if len(run) > 1 else []
    return out if out[-1] == points[-1] else [*out, points[-1]]


def smooth(shift: int, spacing: int = 5):
    """A column function over lines at a level of 24 - shift bits; at shift 0 they stay as they are."""

    @F.pandas_udf("array<struct<lat:int,lon:int>>")
    def run(lines: pd.Series) -> pd.Series:
        step = spacing << shift if shift else 0
        return pd.Series([None if line is None else [{"lat": y, "lon": x} for y, x in smoothed([(p["lat"], p["lon"]) for p in line], step)] for line in lines], dtype=object)

    return run


def filter_lines(lines: DataFrame, resolution: int, level: int, min_size: int = 1, error: float = ERROR, roads_exempt: bool = True) -> DataFrame:
    """The chain for lines (points, is_road, skip_size_filter, ..) at a level: rounding, size, simplification, splitting, emptiness, obsolete points.

    At the highest resolution lines are only split. Pieces get ``piece``, counted from 0.
    """
    shift = 24 - resolution
    of_type = lines.schema["points"].dataType.simpleString()
    if shift:
        exempt = F.col("skip_size_filter") | (F.col("is_road") if roads_exempt and level == 0 else F.lit(False))
        lines = lines.withColumn("points", rounded(F.col("points"), shift)).where(F.size("points") > 1).where(large_enough(F.col("points"), min_size, shift, exempt))
        lines = lines.withColumn("points", simplified(error * (1 << shift), of_type)("points"))
    out = lines.select(*[c for c in lines.columns if c != "points"], F.posexplode(split_by_count(F.col("points"))).alias("piece", "points"))
    out = out.where(not_empty(F.col("points"), "line"))
    return out.withColumn("points", without_obsolete(points_type=of_type)("points")).where(not_empty(F.col("points"), "line"))


def filter_shapes(shapes: DataFrame, resolution: int, min_size: int = 8, error: float = ERROR, by_area: bool = False) -> DataFrame:
    """The chain for closed shapes (points, skip_size_filter, ..): rounding, size, simplification, obsolete points, emptiness.

    With by_area shapes get ``place``, their rank by falling area, as large ones are drawn first.
    """
    from .names import global_rank

    shift = 24 - resolution
    of_type = shapes.schema["points"].dataType.simpleString()
    if shift:
        shapes = shapes.withColumn("points", rounded(F.col("points"), shift)).where(F.size("points") > 3).where(large_enough(F.col("points"), min_size, shift, F.col("skip_size_filter")))
        shapes = shapes.withColumn("points", simplified(error * (1 << shift), of_type)("points"))
    ring = F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0)))
    shapes = shapes.withColumn("points", without_obsolete(shape=True, points_type=of_type)(ring))
    shapes = shapes.withColumn("points", F.concat("points", F.slice("points", 1, 1))).where(not_empty(F.col("points"), "shape"))
    if by_area:
        shapes = global_rank(shapes.withColumn("area", F.abs(geo.signed_area(F.col("points")))), [F.desc("area")], "place")
    return shapes
