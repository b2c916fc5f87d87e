"""Segments met with points or with other segments in groups of bounded size, by Arrow kernels that hold one group at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the smaller side that one group holds, the parts of the segments for each of them, and the pairs looked at in one step.
PER_GROUP, PARTS, STEP = 200_000, 48, 1 << 16


def groups_of(small: DataFrame, segments: DataFrame, chunks: DataFrame, n_chunks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the number ``_g`` of their group: each chunk of the small one meets every part of the segments that reach it.

    small has _chunk; chunks has _chunk (from 0) and _near, a condition on segments that must not leave out any that counts.
    """
    salt = F.pmod(F.xxhash64("road", "pos", "lat", "lon", "to_lat", "to_lon"), F.lit(PARTS))
    left = small.withColumn("_g", F.explode(F.sequence(F.col("_chunk") * PARTS, F.col("_chunk") * PARTS + (PARTS - 1)))).drop("_chunk")
    right = segments.crossJoin(F.broadcast(chunks)) if n_chunks > 1 else segments.withColumn("_chunk", F.lit(0))
    right = right.where(_near()) if n_chunks > 1 and "c_min_lat" in chunks.columns else right
    right = right.withColumn("_g", (salt + F.col("_chunk") * PARTS).cast("int")).drop(*chunks.columns)
    n = min(n_chunks * PARTS, 2000)
    return left.withColumn("_g", F.col("_g").cast("int")).repartition(n, "_g"), right.repartition(n, "_g")


def _near() -> Column:
    """Whether a segment's box meets the box of a chunk and its line has corners of that box on both sides."""
    box = (F.least("lat", "to_lat") <= F.col("c_max_lat")) & (F.greatest("lat", "to_lat") >= F.col("c_min_lat")) & (F.least("lon", "to_lon") <= F.col("c_max_lon")) & (F.greatest("lon", "to_lon") >= F.col("c_min_lon"))
    dy, dx = F.col("to_lat").cast("double") - F.col("lat"), F.col("to_lon").cast("double") - F.col("lon")
    sides = [dy * (F.col(x) - F.col("lon")) - dx * (F.col(y) - F.col("lat")) for y in ("c_min_lat", "c_max_lat") for x in ("c_min_lon", "c_max_lon")]
    return box & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def tiled(points: DataFrame, most: int) -> tuple[DataFrame, DataFrame, int]:
    """points with their _chunk, and the boxes of the chunks, ``most`` wider: squares of some ``PER_GROUP`` points, fuller ones dealt into several."""
    all_ = points.agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("s"), F.max("lat").alias("n_"), F.min("lon").alias("w"), F.max("lon").alias("e")).first()
    n = all_["n"]
    spark = points.sparkSession
    schema = "_chunk int, c_min_lat double, c_min_lon double, c_max_lat double, c_max_lon double"
    if not n:
        return points.withColumn("_chunk", F.lit(0)), spark.createDataFrame([], schema), 1
    high, wide = all_["n_"] - all_["s"] + 1, all_["e"] - all_["w"] + 1
    side = max((high * wide * PER_GROUP / n) ** 0.5, max(high, wide) * PER_GROUP / n, 1.0)
    placed = points.withColumn("_ty", F.floor((F.col("lat") - all_["s"]) / side).cast("int")).withColumn("_tx", F.floor((F.col("lon") - all_["w"]) / side).cast("int"))
    if n <= PER_GROUP:
        return points.withColumn("_chunk", F.lit(0)), spark.createDataFrame([(0, float(all_["s"] - most), float(all_["w"] - most), float(all_["n_"] + most), float(all_["e"] + most))], schema), 1
    # At most as many rows as there are squares: n / PER_GROUP, times the unevenness of a row of squares.
    tiles = placed.groupBy("_ty", "_tx").agg(F.count(F.lit(1)).alias("n"), F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).collect()
    known, boxes = [], []
    for ty, tx, n, s, w, e, x in tiles:
        parts = -(-n // (2 * PER_GROUP))
        known.append((ty, tx, len(boxes), parts))
        boxes += [(len(boxes) + i, float(s - most), float(w - most), float(e + most), float(x + most)) for i in range(parts)]
    first = spark.createDataFrame(known, "_ty int, _tx int, _first int, _parts int")
    dealt = placed.join(F.broadcast(first), ["_ty", "_tx"]).withColumn("_chunk", (F.col("_first") + F.pmod(F.xxhash64("id", "lat", "lon"), F.col("_parts"))).cast("int"))
    return dealt.drop("_ty", "_tx", "_first", "_parts"), spark.createDataFrame(boxes, schema), len(boxes)


def _flat(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of counts[i] numbers from starts[i]: the i of each and the number."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class _Columns:
    """Points in columns of low cells, so that those of neighbouring cells of a column stand together."""

    def __init__(self, u: np.ndarray, v: np.ndarray, ids: np.ndarray, reach: float):
        u, v = u[ids], v[ids]
        self.u0, self.v0, self.reach = u.min(), v.min(), reach
        wide, high, n = u.max() - self.u0 + 1.0, v.max() - self.v0 + 1.0, len(ids)
        self.cell = max(reach, 1.2 * (wide * high / n) ** 0.5, max(wide, high) / (4 * n), 1.0)
        self.low = self.cell / 4
        self.columns, self.rows = int(wide // self.cell) + 1, int(high // self.low) + 1
        at = ((u - self.u0) // self.cell).astype(np.int64) * self.rows + ((v - self.v0) // self.low).astype(np.int64)
        by = np.argsort(at, kind="stable")
        self.ids, self.u, self.v = ids[by], u[by] - self.u0, v[by] - self.v0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=self.columns * self.rows))])

    def pairs(self, u1, v1, u2, v2, seg):
        """Batches of (segment, point) that hold all pairs within reach; segments rise at most as steeply as they run."""
        slope = np.divide(v2 - v1, u2 - u1, out=np.zeros(len(u1)), where=u1 != u2)
        cross = v1 - self.v0 - slope * (u1 - self.u0)
        lo = np.clip((np.minimum(u1, u2) - self.reach - self.u0) // self.cell, 0, self.columns).astype(np.int64)
        hi = np.clip((np.maximum(u1, u2) + self.reach - self.u0) // self.cell, -1, self.columns - 1).astype(np.int64)
        # How far the line may be, in v, from a point within reach: one more unit for rounding. It may be longer than its segment here.
        room = self.reach * np.sqrt(1.0 + slope * slope) + 1.0
        half = (np.abs(slope) * self.cell / 2 + room) / self.low
        middle, rise = (cross + slope * self.cell / 2) / self.low, slope * self.cell / self.low
        runs = np.maximum(hi - lo + 1, 0)
        ends = np.cumsum(runs)
        a = 0
        while a < len(runs):
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")), a + 1)
            of, col = _flat(lo[a:b], runs[a:b])
            of += a
            m, h = middle[of] + rise[of] * col, half[of]
            col *= self.rows
            start = self.first[col + np.clip(m - h, 0, self.rows).astype(np.int64)]
            # Rows below the first are -1 here, so the run ends where it begins.
            m += h
            count = self.first[col + np.clip(np.floor(m) + 1, 0, self.rows).astype(np.int64)] - start
            some = np.flatnonzero(count > 0)
            of, start, count = of[some], start[some], count[some]
            sums = np.cumsum(count)
            c = 0
            while c < len(count):
                d = max(int(np.searchsorted(sums, (sums[c - 1] if c else 0) + STEP, "right")), c + 1)
                i, j = _flat(start[c:d], count[c:d])
                i = of[c:d][i]
                keep = np.flatnonzero(np.abs(self.v[j] - slope[i] * self.u[j] - cross[i]) <= room[i])
                yield seg[i[keep]], self.ids[j[keep]]
                c = d
            a = b


def nearest_rows(y, x, y1, x1, y2, x2, most: float, alike: Callable | None = None):
    """For each point the segment of least (d2, number) within ``most``: arrays (number or -1, d2, share).

    Segments are taken in a mixed order, few at first: what they leave as the distance still open is the reach in which
    later ones look for points. alike(segments, points) tells which pairs count.
    """
    n = len(y)
    best, found, shares = np.full(n, float(most) * most), np.full(n, -1, np.int64), np.zeros(n)
    order = np.random.default_rng(0).permutation(len(y1))
    dy, dx = y2 - y1, x2 - x1
    size = dy * dy + dx * dx
    flat = np.abs(dx) >= np.abs(dy)
    a, step = 0, 64
    while a < len(order) and n:
        some = order[a : a + step]
        reach = np.sqrt(best)
        grade = np.ceil(np.log(np.maximum(reach, 1.0)) / np.log(4.0)).astype(int)
        # Points whose distance is below the space between points are searched together.
        space = 0.35 * ((y.max() - y.min() + 1.0) * (x.max() - x.min() + 1.0) / n) ** 0.5
        grade = np.maximum(grade, int(np.floor(np.log(max(space, 1.0)) / np.log(4.0))))
        for g in np.unique(grade):
            ids = np.flatnonzero(grade == g)
            wide = float(reach[ids].max()) + 1e-6
            for side, u, v, e in ((some[flat[some]], x, y, (x1, y1, x2, y2)), (some[~flat[some]], y, x, (y1, x1, y2, x2))):
                if not len(side):
                    continue
                for s, p in _Columns(u, v, ids, wide).pairs(*(c[side] for c in e), side):
                    py, px, sy, sx, gy, gx, z = y[p], x[p], y1[s], x1[s], dy[s], dx[s], size[s]
                    off = (px - sx) * gy - (py - sy) * gx
                    keep = off * off <= best[p] * z * 1.000001 + 1
                    if alike is not None:
                        keep &= alike(s, p)
                    keep = np.flatnonzero(keep)
                    s, p, py, px, sy, sx, gy, gx, z = (c[keep] for c in (s, p, py, px, sy, sx, gy, gx, z))
                    share = np.where(z == 0, 0.0, np.maximum(0.0, np.minimum(1.0, ((py - sy) * gy + (px - sx) * gx) / np.where(z == 0, 1.0, z))))
                    ry, rx = py - (sy + share * gy), px - (sx + share * gx)
                    d2 = ry * ry + rx * rx
                    near = np.flatnonzero((d2 < best[p]) | ((d2 == best[p]) & ((found[p] < 0) | (s < found[p]))))
                    if not len(near):
                        continue
                    s, p, d2, share = s[near], p[near], d2[near], share[near]
                    by = np.lexsort((s, d2, p))
                    by = by[np.concatenate([[True], p[by][1:] != p[by][:-1]])]
                    best[p[by]], found[p[by]], shares[p[by]] = d2[by], s[by], share[by]
        a, step = a + step, min(step * 8, 1 << 16)
    return found, best, shares


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[c].to_numpy().astype(np.float64) for c in names]


def nearest_in_group(most: int, named: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def kernel(points: pa.Table, segments: pa.Table) -> pa.Table:
        segments = segments.take(pc.sort_indices(segments, [("road", "ascending"), ("pos", "ascending")]))
        alike = None
        if named:
            codes = pa.chunked_array(points["name"].chunks + segments["name"].chunks, type=points["name"].type).combine_chunks().dictionary_encode()
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
            own, other = codes[: len(points)], codes[len(points) :]
            alike = lambda s, p: other[s] == own[p]
        found, d2, share = nearest_rows(*_numbers(points, "lat", "lon"), *_numbers(segments, "lat", "lon", "to_lat", "to_lon"), most, alike)
        hit = np.flatnonzero(found >= 0)
        chosen = segments.take(pa.array(found[hit]))
        return pa.table({"id": points["id"].take(pa.array(hit)), "road": chosen["road"], "pos": chosen["pos"], "d2": d2[hit], "share": share[hit]})

    return kernel


def _buckets(c: np.ndarray) -> list[np.ndarray]:
    """Numbers of borders (rows of y, x, y, x) by length and place, some 256 or a thousandth together."""
    y, x = (c[0] + c[2]) // 2, (c[1] + c[3]) // 2
    n = len(y)
    grade = np.ceil(np.log2(np.maximum(np.maximum(np.abs(c[2] - c[0]), np.abs(c[3] - c[1])), 1.0)))
    space = ((np.ptp(y) + 1.0) * (np.ptp(x) + 1.0) * max(256, n / 1000) / n) ** 0.5
    side = np.exp2(np.maximum(grade, np.floor(np.log2(max(space, 1.0)))))
    order = np.lexsort((x // side, y // side, side))
    keys = np.stack([side[order], (y // side)[order], (x // side)[order]])
    return np.split(order, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)


def met(a: np.ndarray, c: np.ndarray):
    """(hits, na, by) of segments a and borders c, both rows of y, x, y, x: a matrix of what meets and the parts of its share along a."""
    ya, xa, yb, xb = (v[:, None] for v in a)
    yc, xc, yd, xd = c
    b1, b2, s1, s2 = yd - yc, xd - xc, yb - ya, xb - xa
    base = b2 * yd - b1 * xd
    na = b1 * xa - b2 * ya
    na += base
    nb = b1 * xb - b2 * yb
    nb += base
    mc = s2 * yc - s1 * xc
    mc += s1 * xa - s2 * ya
    by = na - nb
    opposite = (lambda p, q: p * q <= 0) if a.dtype == np.float64 else (lambda p, q: np.sign(p) * np.sign(q) <= 0)
    return opposite(na, nb) & opposite(mc, mc - by) & (by != 0), na, by


def _places(a, hits, na, by, snap):
    """(segment, border, y, x, at) of the hits; at is 0 for the start, 1 for the end, 2 between."""
    i, j = np.nonzero(hits)
    ya, xa, yb, xb = (v[i] for v in a)
    share = na[i, j] / by[i, j]
    y, x = np.floor(ya + share * (yb - ya) + 0.5), np.floor(xa + share * (xb - xa) + 0.5)
    d1, d2 = (y - ya) ** 2 + (x - xa) ** 2, (y - yb) ** 2 + (x - xb) ** 2
    return i, j, y, x, np.where((d1 <= d2) & (d1 <= snap * snap), 0, np.where(d2 <= snap * snap, 1, 2))


_AT = np.array(["start", "end", "between"], dtype=object)


def _blocks(segments: pa.Table, borders: pa.Table, snap: int):
    """(segments, borders, near): numbers that may meet, in blocks; near tells whether ends are so near that they may take a place."""
    a, c = (np.stack([t[n].to_numpy().astype(np.int64) for n in ("lat", "lon", "to_lat", "to_lon")]) for t in (segments, borders))
    # Products of 24-bit units are exact in doubles, wider ones in longs only.
    exact = max(np.abs(a).max(), np.abs(c).max()) <= 1 << 24
    a, c = (v.astype(np.float64) if exact else v for v in (a, c))
    low, high = np.minimum(a[:2], a[2:]), np.maximum(a[:2], a[2:])
    for mine in _buckets(c.astype(np.float64)):
        s, w = (np.minimum(c[k, mine], c[k + 2, mine]).min() for k in (0, 1))
        n, e = (np.maximum(c[k, mine], c[k + 2, mine]).max() for k in (0, 1))
        some = np.flatnonzero((low[0] <= n) & (high[0] >= s) & (low[1] <= e) & (high[1] >= w))
        y1, x1, y2, x2 = a[:, some].astype(np.float64)
        sides = [(y2 - y1) * (x - x1) - (x2 - x1) * (y - y1) for y in (s, n) for x in (w, e)]
        some = some[(np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)]
        y1, x1, y2, x2 = a[:, some]
        r = snap + 2
        ends = ((y1 >= s - r) & (y1 <= n + r) & (x1 >= w - r) & (x1 <= e + r)) | ((y2 >= s - r) & (y2 <= n + r) & (x2 >= w - r) & (x2 <= e + r))
        for near in (True, False):
            part = some[ends == near]
            for m in range(0, len(mine), 1 << 10):
                few = mine[m : m + (1 << 10)]
                step = max(1, (1 << 15) // len(few))
                for k in range(0, len(part), step):
                    yield a, c, part[k : k + step], few, near


def counts_in_group(snap: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def kernel(borders: pa.Table, segments: pa.Table) -> pa.Table:
        n = np.zeros((3, len(borders)), np.int64)
        if len(borders) and len(segments):
            for a, c, i, j, near in _blocks(segments, borders, snap):
                hits, na, by = met(a[:, i], c[:, j])
                if near:
                    _, at, _, _, kind = _places(a[:, i], hits, na, by, snap)
                    np.add.at(n, (kind, j[at]), 1)
                else:
                    n[2, j] += hits.sum(axis=0)
        kind, at = np.nonzero(n)
        return pa.table({"border": borders["border"].take(pa.array(at)), "at": pa.array(_AT[kind], pa.string()), "n": n[kind, at]})

    return kernel


def rows_in_group(snap: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def kernel(borders: pa.Table, segments: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 5]
        if len(borders) and len(segments):
            for a, c, i, j, _ in _blocks(segments, borders, snap):
                s, b, y, x, at = _places(a[:, i], *met(a[:, i], c[:, j]), snap)
                out.append((i[s], j[b], y, x, at))
        s, b, y, x, at = (np.concatenate(v) for v in zip(*out))
        of, by = segments.take(pa.array(s.astype(np.int64))), borders.take(pa.array(b.astype(np.int64)))
        return pa.table({"road": of["road"], "pos": of["pos"], "border": by["border"], "b_pos": by["pos"], "lat": y.astype(np.int32), "lon": x.astype(np.int32), "at": pa.array(_AT[at.astype(int)], pa.string())})

    return kernel
