"""Rings and areas: assembly of relations, nesting, clipping, splitting, merging and coverage.

Kernels work on one relation, tile or shape; rings are lists of (lat, lon) in map units whose first
point is not repeated at the end.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial
from .kernels import Point, clipped_line, clipped_ring, contains, lists_of_points, points_of_lists
from .work import spread

RING = "array<struct<lat:int,lon:int>>"


def chained(ways: list[list]) -> tuple[list[list], list[list]]:
    """(rings, open chains) of ways by equal ends; each way is used once and may be turned round.

    Ways are taken in their order; at an end the first unused way that fits goes on. A ring has its
    first item at the end too. Looking up an end takes constant time.
    """
    at: dict = defaultdict(list)
    for i, w in enumerate(ways):
        if len(w) > 1:
            at[w[0]].append(i)
            if w[-1] != w[0]:
                at[w[-1]].append(i)
    used, rings, open_ = [len(w) < 2 for w in ways], [], []

    def following(end):
        while at[end] and used[at[end][-1]]:
            at[end].pop()
        return at[end][-1] if at[end] else None

    for ends in at.values():
        ends.reverse()
    for i, w in enumerate(ways):
        if used[i]:
            continue
        used[i], chain = True, list(w)
        for _ in range(2):
            while chain[0] != chain[-1] and (k := following(chain[-1])) is not None:
                used[k] = True
                step = ways[k] if ways[k][0] == chain[-1] else ways[k][::-1]
                chain += step[1:]
            if chain[0] == chain[-1]:
                break
            chain.reverse()
        (rings if chain[0] == chain[-1] and len(chain) > 3 else open_).append(chain)
    return rings, open_


def signed_area(ring: list[Point]) -> int:
    """Twice the area, positive if clockwise on a map."""
    return sum((x2 - x1) * (y1 + y2) for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], *ring[:1]]))


def inner_point(ring: list[Point]) -> tuple[float, float]:
    """A point surely within a ring: halfway between the first two crossings of a line that passes no corner."""
    ys = sorted({y for y, _ in ring})
    y = max(((b - a), (a + b) / 2) for a, b in zip(ys, ys[1:]))[1] if len(ys) > 1 else ys[0]
    xs = sorted(x1 + (x2 - x1) * (y - y1) / (y2 - y1) for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]) if (y1 > y) != (y2 > y))
    return (y, (xs[0] + xs[1]) / 2) if len(xs) > 1 else ring[0]


def nested(rings: list[list[Point]]) -> list[tuple[int, int | None]]:
    """(depth, parent) of each ring: in how many others it lies, and the smallest of these.

    Rings of even depth are outer ones, those of odd depth holes. Boxes are compared before rings.
    """
    area = [abs(signed_area(r)) for r in rings]
    box = [(min(y for y, _ in r), min(x for _, x in r), max(y for y, _ in r), max(x for _, x in r)) for r in rings]
    spot = [inner_point(r) for r in rings]
    out = []
    for i in range(len(rings)):
        around = [
            j for j in range(len(rings))
            if area[j] > area[i] and box[j][0] <= box[i][0] and box[j][1] <= box[i][1] and box[j][2] >= box[i][2] and box[j][3] >= box[i][3] and contains(rings[j], spot[i])
        ]
        out.append((len(around), min(around, key=lambda j: (area[j], j)) if around else None))
    return out


def closed_gaps(chains: list[list[Point]], most: float) -> list[list[Point]]:
    """Rings from open chains: the nearest ends are joined as long as they are at most ``most`` units apart."""
    chains, rings = [list(c) for c in chains], []
    while chains:
        best = None
        for i, a in enumerate(chains):
            for j, b in enumerate(chains):
                for turn in (False, True):
                    if j < i or (i == j and turn):
                        continue
                    end = b[-1] if turn else b[0]
                    gap = max(abs(a[-1][0] - end[0]), abs(a[-1][1] - end[1]))
                    if best is None or gap < best[0]:
                        best = (gap, i, j, turn)
        if best is None or best[0] > most:
            break
        _, i, j, turn = best
        if i == j:
            rings.append(chains.pop(i))
            continue
        b = chains[j][::-1] if turn else chains[j]
        chains[i] += b[1:] if chains[i][-1] == b[0] else b
        chains.pop(j)
    return [r for r in rings if len(r) > 3]


def assembled_rings(members: DataFrame, gap: float = 0.0) -> DataFrame:
    """(rel_id, ring, depth, parent, outer, points, area2): the rings of relations from their way members.

    members has rel_id, pos and points (structs of node_id, lat, lon) of each way. Ways are joined at equal nodes;
    open chains are closed over gaps of up to ``gap`` units. Rings of even depth are outer ones, the others
    holes of their parent.
    """

    def rows(rel_id, members: list[dict]) -> list[dict]:
        place: dict = {}
        ways = []
        for member in members:
            place |= {p["node_id"]: (p["lat"], p["lon"]) for p in member["points"]}
            ways.append([p["node_id"] for p in member["points"]])
        closed, open_ = chained(ways)
        rings = [[place[n] for n in r[:-1]] for r in closed]
        rings += [[p for p in r if True] for r in closed_gaps([[place[n] for n in c] for c in open_], gap)] if gap > 0 else []
        rings = [r for r in rings if len(r) > 2 and signed_area(r)]
        return [
            {"rel_id": rel_id, "ring": i, "depth": depth, "parent": parent, "outer": depth % 2 == 0, "points": [{"lat": y, "lon": x} for y, x in r], "area2": signed_area(r)}
            for i, (r, (depth, parent)) in enumerate(zip(rings, nested(rings)))
        ]

    ring = pa.list_(pa.struct([("lat", pa.int32()), ("lon", pa.int32())]))
    types = pa.schema([("rel_id", pa.int64()), ("ring", pa.int32()), ("depth", pa.int32()), ("parent", pa.int64()), ("outer", pa.bool_()), ("points", ring), ("area2", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_pylist([row for r, m in zip(some["rel_id"].to_pylist(), some["members"].to_pylist()) for row in rows(r, m)], types)

    # The members of one relation stand in one row; many relations go to a worker at once.
    whole = spread(members.select("rel_id", "pos", "points"), "rel_id").groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("pos", "points"))).alias("members"))
    return whole.mapInArrow(run, f"rel_id long, ring int, depth int, parent long, outer boolean, points {RING}, area2 long")


def polygons_of(rings: DataFrame, tags: DataFrame) -> DataFrame:
    """(rel_id, ring, points, holes, area2, tags): each outer ring with its holes; area2 is without them.

    tags has rel_id and tags; an outer ring has all of them but the type.
    """
    # One pass: rings come from Python, which two joined halves would run twice.
    hole = lambda c: F.when(~F.col("outer"), c)
    owner = F.when(F.col("outer"), F.col("ring")).otherwise(F.col("parent").cast("int"))
    held = rings.groupBy("rel_id", owner.alias("owner")).agg(
        F.any_value(F.when(F.col("outer"), F.struct("ring", "points", "area2")), True).alias("o"),
        F.sort_array(F.collect_list(hole(F.struct(F.col("ring").alias("k"), "points")))).alias("h"), F.sum(hole(F.abs("area2"))).alias("cut"),
    )
    out = held.where("o is not null").select("rel_id", "o.*", "h", "cut").join(tags.select("rel_id", F.map_filter("tags", lambda k, v: k != "type").alias("tags")), "rel_id")
    inner = F.coalesce(F.transform("h", lambda x: x["points"]), F.array().cast(f"array<{RING}>"))
    return out.select("rel_id", "ring", "points", inner.alias("holes"), (F.abs("area2") - F.coalesce("cut", F.lit(0))).alias("area2"), "tags")


def with_boundaries(points: DataFrame, boundaries: DataFrame, cell: int, step: int = 0) -> DataFrame:
    """points with ``levels``, a map from admin level to the name of the area that holds it, '' for those without a level's name.

    points has id, lat, lon; boundaries admin_level, name, ring. Of several areas of a level the one with the
    least name counts. With a step, a point in no area takes what holds a neighbour: step units
    to the north, east, south or west, in this order.
    """
    offsets = [(0, 0)] + ([(step, 0), (0, step), (-step, 0), (0, -step)] if step else [])
    tries = F.array(*[F.struct(F.lit(i).alias("nth"), (F.col("lat") + dy).alias("lat"), (F.col("lon") + dx).alias("lon")) for i, (dy, dx) in enumerate(offsets)])
    spread = points.select("id", F.explode(tries).alias("t")).select("id", "t.nth", "t.lat", "t.lon")
    met = spatial.points_in_areas(spread, boundaries.select("admin_level", "name", "ring"), cell)
    named = met.groupBy("id", "nth", "admin_level").agg(F.min("name").alias("name"))
    each = named.groupBy("id", "nth").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("admin_level", "name")))).alias("levels"))
    first = each.groupBy("id").agg(F.min_by("levels", "nth").alias("levels"))
    return points.join(first, "id", "left")


def location_tags(points: DataFrame, boundaries: DataFrame, cell: int) -> DataFrame:
    """(id, admin_level2 .. admin_level11, postcode): the names of the areas that hold a point, one column a level.

    boundaries has admin_level (null for postal areas), name, zip and ring.
    """
    met = spatial.points_in_areas(points.select("id", "lat", "lon"), boundaries.select("admin_level", "name", "zip", "ring"), cell)
    levels = [F.min(F.when(F.col("admin_level") == k, F.col("name"))).alias(f"admin_level{k}") for k in range(2, 12)]
    found = met.groupBy("id").agg(*levels, F.min("zip").alias("postcode"))
    return points.select("id").join(found, "id", "left")


def way_locations(ways: DataFrame, boundaries: DataFrame, cell: int) -> DataFrame:
    """(way_id, levels): what holds the middle point of a way, else its first, its last, or any other one.

    ways has way_id and points; the middle of two points lies between them.
    """
    n = F.size("points")
    mid = F.floor(n / 2).cast("int")
    order = lambda i: F.when(i == mid, 0).when(i == 0, 1).when(i == n - 1, 2).otherwise(i + 3)
    half = F.struct(*[((F.element_at("points", 1)[a] + F.element_at("points", 2)[a]) / 2).cast("int").alias(a) for a in ("lat", "lon")])
    extra = F.when(n == 2, F.array(F.struct(F.lit(-1).alias("nth"), half["lat"].alias("lat"), half["lon"].alias("lon"))))
    tries = F.concat(F.coalesce(extra, F.array().cast("array<struct<nth:int,lat:int,lon:int>>")), F.transform("points", lambda p, i: F.struct(order(i).alias("nth"), p["lat"].alias("lat"), p["lon"].alias("lon"))))
    spread = ways.where(n > 0).select(F.col("way_id").alias("id"), F.explode(tries).alias("t")).select("id", "t.*")
    met = spatial.points_in_areas(spread, boundaries.select("admin_level", "name", "ring"), cell)
    named = met.groupBy("id", "nth", "admin_level").agg(F.min("name").alias("name"))
    each = named.groupBy("id", "nth").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("admin_level", "name")))).alias("levels"))
    return ways.select("way_id").join(each.groupBy(F.col("id").alias("way_id")).agg(F.min_by("levels", "nth").alias("levels")), "way_id", "left")


def residential(elements: DataFrame, ways: DataFrame, cell: int) -> DataFrame:
    """elements (id, lat, lon, ..) with ``residential``: the name of the residential area that holds them, 'yes' for one without a name.

    ways has way_id, name, landuse, stylefilter and ring, null for open ways; areas kept as lines are left out. Of several
    areas the least name counts.
    """
    areas = ways.where((F.col("landuse") == "residential") & F.col("ring").isNotNull() & ~F.coalesce(F.col("stylefilter") == "polyline", F.lit(False)))
    met = spatial.points_in_areas(elements.select("id", "lat", "lon"), areas.select(F.coalesce("name", F.lit("yes")).alias("residential"), "ring"), cell)
    return elements.join(met.groupBy("id").agg(F.min("residential").alias("residential")), "id", "left")


def split_ring(ring: list[Point], most_points: int, most_size: int, depth: int = 0) -> list[list[Point]]:
    """A ring halved across its longer side until no part has too many points or is too large."""
    ys, xs = [y for y, _ in ring], [x for _, x in ring]
    high, wide = (max(ys) - min(ys), max(xs) - min(xs)) if ring else (0, 0)
    if not ring or (len(ring) <= most_points and max(high, wide) <= most_size) or max(high, wide) < 2 or depth > 60:
        return [ring] if len(ring) > 2 and signed_area(ring) else []
    far = 1 << 40
    if wide > high:
        cut = min(xs) + wide // 2
        boxes = [(-far, -far, far, cut), (-far, cut, far, far)]
    else:
        cut = min(ys) + high // 2
        boxes = [(-far, -far, cut, far), (cut, -far, far, far)]
    return [part for b in boxes for part in split_ring(clipped_ring(b, ring), most_points, most_size, depth + 1)]


def _on_rings(kernel, result: str):
    """A column function over rings (arrays of lat, lon) that gives a list of rings."""

    @F.arrow_udf(result)
    def run(rings: pa.Array) -> pa.Array:
        made = [None if ring is None else kernel(ring) for ring in lists_of_points(rings)]
        starts, at = [], 0
        for parts in made:
            starts.append(None if parts is None else at)
            at += len(parts or ())
        return pa.ListArray.from_arrays(pa.array([*starts, at], pa.int32()), points_of_lists([r for parts in made if parts is not None for r in parts]))

    return run


def split_rings(most_points: int = 250, most_size: int = 0x7FFF):
    """A column function: the parts of a ring, none with over so many points or over so wide or high."""
    return _on_rings(lambda ring: split_ring(ring, most_points, most_size), f"array<{RING}>")


def clip_rings(box: tuple[int, int, int, int]):
    """A column function: the part of a ring within (min_lat, min_lon, max_lat, max_lon), in a list that is empty if there is none."""
    return _on_rings(lambda ring: [r] if len(r := clipped_ring(box, ring)) > 2 and signed_area(r) else [], f"array<{RING}>")


def clip_lines(box: tuple[int, int, int, int]):
    """A column function: the pieces of a line within a box. Of a closed line that starts inside, the last piece goes on in the first."""

    def kernel(line: list[Point]) -> list[list[Point]]:
        parts = clipped_line(box, line)
        if len(parts) > 1 and line[0] == line[-1] and parts[0][0] == line[0] and parts[-1][-1] == line[0]:
            parts = [parts[-1] + parts[0][1:], *parts[1:-1]]
        return parts

    return _on_rings(kernel, f"array<{RING}>")


def with_edge_points(box: tuple[int, int, int, int]):
    """A column function: a line with a point put in wherever it crosses the edge of a box; nothing is cut off."""
    from .kernels import clipped_segment

    def kernel(line: list[Point]) -> list[list[Point]]:
        out = line[:1]
        for a, b in zip(line, line[1:]):
            part = clipped_segment(box, a, b)
            out += [p for p in (part or ()) if p not in (a, b, out[-1])] + [b]
        return [out]

    return _on_rings(kernel, f"array<{RING}>")


def clip_features(points: DataFrame, lines: DataFrame, shapes: DataFrame, box: tuple[int, int, int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, lines (points) and shapes (ring) within a box; a line gives a row for each piece."""
    inside = F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3])
    cut = lambda df, column, by: df.withColumn(column, F.explode(by(F.col(column))))
    return points.where(inside), cut(lines, "points", clip_lines(box)), cut(shapes, "ring", clip_rings(box))


def in_use(elements: DataFrame, kind: str, box: tuple[int, int, int, int], keep: Column | None = None) -> DataFrame:
    """Elements that can matter in a box: tagged nodes within it, and ways with points that touch it or are around it.

    Nodes have lat, lon and tags; ways points and tags, ``via`` if they are part of a restriction, which keeps
    them. keep tells of nodes that stay wherever they are.
    """
    low_y, low_x, high_y, high_x = box
    if kind == "node":
        inside = F.col("lat").between(low_y, high_y) & F.col("lon").between(low_x, high_x)
        return elements.where((F.size("tags") > 0) & (inside if keep is None else inside | keep))
    from .lines import pairwise

    own = geo.bounds(F.col("points"))
    meets = (own["min_lat"] <= high_y) & (own["max_lat"] >= low_y) & (own["min_lon"] <= high_x) & (own["max_lon"] >= low_x)
    corner = lambda y, x: F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon"))
    sides = [(corner(low_y, low_x), corner(low_y, high_x)), (corner(low_y, high_x), corner(high_y, high_x)), (corner(high_y, high_x), corner(high_y, low_x)), (corner(high_y, low_x), corner(low_y, low_x))]
    inside = F.exists("points", lambda p: p["lat"].between(low_y, high_y) & p["lon"].between(low_x, high_x))
    crosses = F.lit(False)
    for a, b in sides:
        crosses = crosses | F.exists(pairwise(F.col("points"), lambda p, q: geo.crossing(p, q, a, b).isNotNull()), lambda x: x)  # noqa: B023
    around = spatial.ring_contains(F.col("points"), F.lit(low_y), F.lit(low_x)) & (F.element_at("points", 1)["lat"] == F.element_at("points", -1)["lat"]) & (F.element_at("points", 1)["lon"] == F.element_at("points", -1)["lon"])
    return elements.where(F.coalesce(F.col("via"), F.lit(False)) | ((F.size("points") > 0) & meets & (inside | crosses | around)))


def joined_shapes(rings: list[list[Point]]) -> list[list[Point]]:
    """Rings joined where they share edges: edges that two rings run in opposite directions fall out, the rest is chained anew.

    All rings are turned clockwise first. A ring with no shared edge stays as it is.
    """
    count: dict = defaultdict(int)
    order: list = []
    for r in rings:
        r = r if signed_area(r) > 0 else r[::-1]
        for a, b in zip(r, [*r[1:], r[0]]):
            if count[b, a]:
                count[b, a] -= 1
            else:
                count[a, b] += 1
                order.append((a, b))
    follow = defaultdict(list)
    for a, b in reversed(order):
        if count[a, b]:
            count[a, b] -= 1
            follow[a].append(b)
    out = []
    for start in [a for a, _ in order]:
        while follow[start]:
            ring = [start]
            while follow[ring[-1]]:
                ring.append(follow[ring[-1]].pop())
                if ring[-1] == start:
                    break
            out.append(ring[:-1])
    return [r for r in out if len(r) > 2]


def merge_shapes(shapes: DataFrame, same: list[str], side: int) -> DataFrame:
    """(same.., cell, points): shapes that agree in the columns of ``same`` joined along shared edges.

    Shapes are dealt to square cells of a grid, ``side`` wide, by the first corner of their box, so that no task holds
    all shapes of a common kind; shapes of different cells stay apart.
    """
    box = geo.bounds(F.col("points"))
    cell = F.struct(F.floor(box["min_lon"] / side).cast("long").alias("cx"), F.floor(box["min_lat"] / side).cast("long").alias("cy"))

    def run(batches):
        for batch in batches:
            rings = [joined_shapes([[(p["lat"], p["lon"]) for p in s["points"]] for s in group]) for group in batch["shapes"].to_pylist()]
            of = pa.array([i for i, r in enumerate(rings) for _ in r], pa.int64())
            kept = [batch[c].take(of) for c in [*same, "cx", "cy"]]
            yield pa.RecordBatch.from_arrays([*kept, points_of_lists([r for group in rings for r in group])], names=[*same, "cx", "cy", "points"])

    dealt = shapes.withColumn("cell", cell).select("id", *same, F.col("cell.cx").alias("cx"), F.col("cell.cy").alias("cy"), "points")
    types = {f.name: f.dataType.simpleString() for f in shapes.schema}
    # The shapes of one group stand in one row, in the order of their ids.
    whole = spread(dealt, *same, "cx", "cy").groupBy(*same, "cx", "cy").agg(F.sort_array(F.collect_list(F.struct("id", "points"))).alias("shapes"))
    return whole.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in same] + ["cx long", "cy long", f"points {RING}"]))


def union_area(rings: list[list[Point]]) -> float:
    """The area that rings cover together, exact up to rounding: between the heights of all corners and crossings, by covered widths."""
    edges = [(y1, x1, y2, x2) if y1 < y2 else (y2, x2, y1, x1) for r in rings for (y1, x1), (y2, x2) in zip(r, [*r[1:], r[0]]) if y1 != y2]
    owner = [k for k, r in enumerate(rings) for (y1, _), (y2, _) in zip(r, [*r[1:], r[0]]) if y1 != y2]
    heights = {float(y) for e in edges for y in (e[0], e[2])}
    for i, (y1, x1, y2, x2) in enumerate(edges):
        for y3, x3, y4, x4 in edges[:i]:
            by = (y2 - y1) * (x4 - x3) - (y4 - y3) * (x2 - x1)
            if by:
                t = ((y4 - y3) * (x1 - x4) - (y1 - y4) * (x4 - x3)) / by
                y = y1 + t * (y2 - y1)
                if 0 <= t <= 1 and y3 <= y <= y4:
                    heights.add(y)
    levels, total = sorted(heights), 0.0
    for low, high in zip(levels, levels[1:]):
        mid = (low + high) / 2
        found = defaultdict(list)
        for k, (y1, x1, y2, x2) in zip(owner, edges):
            if y1 < mid < y2:
                found[k].append(x1 + (x2 - x1) * (mid - y1) / (y2 - y1))
        spans = sorted((a, b) for xs in found.values() for a, b in zip(sorted(xs)[::2], sorted(xs)[1::2]))
        end = -np.inf
        for a, b in spans:
            total += max(0.0, b - max(a, end)) * (high - low)
            end = max(end, b)
    return total


def coverage(boundaries: DataFrame, by: list[str], side: int) -> DataFrame:
    """(by.., area): the area that the rings of a group cover together, summed over the cells of a grid.

    boundaries has the columns of ``by`` and ring. Rings are cut at the cells, so a task holds what lies in one cell.
    """
    box = geo.bounds(F.col("ring"))
    cells = boundaries.withColumn("c", F.explode(spatial.cells_of(box, side))).select(*by, "ring", "c.cx", "c.cy")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cx, cy = int(group["cx"].iloc[0]), int(group["cy"].iloc[0])
        cell = (cy * side, cx * side, (cy + 1) * side, (cx + 1) * side)
        rings = [r for r in (clipped_ring(cell, [(p["lat"], p["lon"]) for p in ring]) for ring in group["ring"]) if len(r) > 2]
        first = group.iloc[0]
        return pd.DataFrame([{**{b: first[b] for b in by}, "part": union_area(rings)}])

    types = {f.name: f.dataType.simpleString() for f in boundaries.schema}
    parts = cells.groupBy(*by, "cx", "cy").applyInPandas(run, ", ".join([f"`{b}` {types[b]}" for b in by] + ["part double"]))
    return parts.groupBy(*by).agg(F.round(F.sum("part"), 3).alias("area"))


def postal_union(boundaries: DataFrame, side: int) -> DataFrame:
    """(zip, n, area): the boundaries of each postal code as one; area is what they cover together."""
    own = boundaries.where("zip is not null")
    return coverage(own, ["zip"], side).join(own.groupBy("zip").agg(F.count(F.lit(1)).alias("n")), "zip").select("zip", "n", "area")


def compared(first: DataFrame, second: DataFrame, side: int) -> DataFrame:
    """(key, only_first, only_second, both): the areas of two sets of boundaries (key, ring), by key.

    A key that one set alone has counts as a whole for that set.
    """
    a, b = coverage(first.select("key", "ring"), ["key"], side), coverage(second.select("key", "ring"), ["key"], side)
    both = coverage(first.select("key", "ring").unionByName(second.select("key", "ring")), ["key"], side).withColumnRenamed("area", "u")
    out = both.join(a.withColumnRenamed("area", "a"), "key", "left").join(b.withColumnRenamed("area", "b"), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    a_, b_ = zero(F.col("a")), zero(F.col("b"))
    return out.select("key", F.round(F.col("u") - b_, 3).alias("only_first"), F.round(F.col("u") - a_, 3).alias("only_second"), F.round(a_ + b_ - F.col("u"), 3).alias("both"))


def sea_rings(coast: list[list[Point]], box: tuple[int, int, int, int]) -> tuple[list[list[Point]], list[list[Point]]]:
    """(sea, islands) of a tile from coast lines with land on their left: lines are cut at the box and closed along its edge.

    Without any line that reaches the edge, the sea is the whole box if an island lies in it, else nothing.
    """
    low_y, low_x, high_y, high_x = box
    rings, open_ = chained([list(c) for c in coast])
    cut: list[list[Point]] = []
    islands = []
    for r in rings:
        if all(low_y <= y <= high_y and low_x <= x <= high_x for y, x in r):
            islands.append(r[:-1])
        else:
            cut += clipped_line(box, r)
    for c in open_:
        cut += clipped_line(box, c)
    height, width = high_y - low_y, high_x - low_x

    def place(p: Point) -> float:
        """How far along the edge a point is, clockwise from the south-west corner."""
        y, x = p
        if x == low_x:
            return y - low_y
        if y == high_y:
            return height + x - low_x
        if x == high_x:
            return height + width + high_y - y
        return 2 * height + width + high_x - x

    corners = [((low_y, low_x), 0.0), ((high_y, low_x), height), ((high_y, high_x), height + width), ((low_y, high_x), 2 * height + width)]
    on_edge = lambda p: p[0] in (low_y, high_y) or p[1] in (low_x, high_x)
    pieces, loose = chained(cut)
    pieces_ = [c for c in loose if on_edge(c[0]) and on_edge(c[-1])]
    islands += [r[:-1] for r in pieces]
    if not pieces_:
        whole = [c for c, _ in corners]
        return ([whole] if islands else []), islands
    starts = sorted((place(c[0]), i) for i, c in enumerate(pieces_))
    around = 2 * (height + width)
    left, sea = set(range(len(pieces_))), []
    while left:
        i = min(left)
        ring: list[Point] = []
        while i in left:
            left.discard(i)
            ring += pieces_[i]
            at = place(pieces_[i][-1])
            # With land on the left the sea lies on the right: from the end of a line the edge is followed clockwise to the next start.
            gap, i = min(((s - at) % around, k) for s, k in starts)
            ring += [c for d, c in sorted(((d - at) % around, c) for c, d in corners) if 0 < d < gap]
        sea.append(ring)
    return sea, islands


def sea_polygons(coast: DataFrame, side: int) -> DataFrame:
    """(cx, cy, kind, points): sea and island rings of each square tile that coast lines (pos, points) pass.

    Lines have land on their left. Each line goes to the tiles that its box meets.
    """
    tiles = coast.withColumn("c", F.explode(spatial.cells_of(geo.bounds(F.col("points")), side))).select("c.cx", "c.cy", "pos", "points")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cx, cy = int(group["cx"].iloc[0]), int(group["cy"].iloc[0])
        box = (cy * side, cx * side, (cy + 1) * side, (cx + 1) * side)
        sea, islands = sea_rings([[(p["lat"], p["lon"]) for p in line] for line in group.sort_values("pos")["points"]], box)
        rows = [(cx, cy, kind, [{"lat": y, "lon": x} for y, x in r]) for kind, rings in (("sea", sea), ("land", islands)) for r in rings]
        return pd.DataFrame(rows, columns=["cx", "cy", "kind", "points"])

    # The coast lines of one tile.
    return tiles.groupBy("cx", "cy").applyInPandas(run, f"cx long, cy long, kind string, points {RING}")


def without_flooded(sea: DataFrame, roads: DataFrame, most: int, cell: int) -> DataFrame:
    """Sea polygons (id, ring, ..) that hold at most ``most`` points of roads (lat, lon): one with more is land by mistake."""
    wet = spatial.points_in_areas(roads.select("lat", "lon"), sea.select("id", "ring"), cell).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return sea.join(wet.where(F.col("n") > most).select("id"), "id", "left_anti")
