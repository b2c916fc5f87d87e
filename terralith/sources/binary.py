"""Binary map files: PBF blocks and o5m streams, read by tasks over Spark's binary files.

A PBF file is a row of blobs, each of which is compressed for itself, so its blobs are dealt to tasks. An o5m
file refers back to its own strings and ids and is read by one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Features that a PBF header may require. Fixed values.
FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
_MEMBERS = ("node", "way", "relation")
ELEMENT = "kind string, id long, lat double, lon double, tags map<string,string>, refs array<long>, members array<struct<member_type:string,member_id:long,role:string>>"


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def signed(n: int) -> int:
    """A number whose lowest bit is its sign."""
    return (n >> 1) ^ -(n & 1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message: numbers, or the bytes of texts, messages and packed lists."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        else:
            raise ValueError(f"a field of an unknown kind {kind}")
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = varint(data, at)
        out.append(n)
    return out


def summed(data: bytes) -> list[int]:
    """A packed list of signed differences as absolute numbers."""
    out, last = [], 0
    for n in packed(data):
        last += signed(n)
        out.append(last)
    return out


def _int64(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def pbf_blobs(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(type, uncompressed bytes) of the blobs of a PBF file."""
    at = 0
    while at < len(data):
        (size,) = struct.unpack(">i", data[at : at + 4])
        header = dict(fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        blob = dict(fields(data[at : at + header[3]]))
        at += header[3]
        if 3 not in blob and 1 not in blob:
            raise ValueError("a blob is neither plain nor compressed by zlib")
        yield header[1].decode(), zlib.decompress(blob[3]) if 3 in blob else blob[1]


def check_header(data: bytes) -> None:
    unknown = [v.decode() for k, v in fields(data) if k == 4 and v.decode() not in FEATURES]
    if unknown:
        raise ValueError(f"the file requires unknown features: {', '.join(unknown)}")


def pbf_block(data: bytes) -> Iterator[tuple]:
    """The elements of a block of data."""
    strings, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for k, v in fields(data):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for n, s in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k == 19:
            lat0 = _int64(v)
        elif k == 20:
            lon0 = _int64(v)
    degrees = lambda n, start: (start + n * grain) * 1e-9
    tags_of = lambda parts: dict(zip((strings[i] for i in packed(parts.get(2, b""))), (strings[i] for i in packed(parts.get(3, b"")))))
    for group in groups:
        for kind, message in fields(group):
            parts = dict(fields(message))
            if kind == 1:
                yield "node", signed(parts[1]), degrees(signed(parts[8]), lat0), degrees(signed(parts[9]), lon0), tags_of(parts), None, None
            elif kind == 2:
                pairs, at = packed(parts.get(10, b"")), 0
                for i, y, x in zip(summed(parts[1]), summed(parts[8]), summed(parts[9])):
                    tags = {}
                    while at < len(pairs) and pairs[at]:
                        tags[strings[pairs[at]]] = strings[pairs[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, degrees(y, lat0), degrees(x, lon0), tags, None, None
            elif kind == 3:
                yield "way", _int64(parts[1]), None, None, tags_of(parts), summed(parts.get(8, b"")), None
            elif kind == 4:
                members = zip(packed(parts.get(10, b"")), summed(parts.get(9, b"")), packed(parts.get(8, b"")))
                yield "relation", _int64(parts[1]), None, None, tags_of(parts), None, [{"member_type": _MEMBERS[t], "member_id": i, "role": strings[r]} for t, i, r in members]


class O5m:
    """The reader of one o5m stream."""

    def __init__(self, data: bytes):
        self.data = data
        self._reset()

    def _reset(self) -> None:
        self.table: list[tuple[bytes, ...]] = []
        self.id = self.lat = self.lon = self.way_ref = 0
        self.refs = [0, 0, 0]

    def _strings(self, at: int, n: int) -> tuple[tuple[bytes, ...], int]:
        """n texts that end with a zero each, or a reference to earlier ones."""
        ref, after = varint(self.data, at)
        if ref:
            return self.table[-ref], after
        out, at = [], at + 1
        for _ in range(n):
            end = self.data.index(b"\0", at)
            out.append(self.data[at:end])
            at = end + 1
        found = tuple(out)
        if sum(map(len, found)) <= 250:
            self.table.append(found)
            if len(self.table) > 15_000:
                del self.table[0]
        return found, at

    def _version(self, at: int) -> int:
        """Behind the version, the time, the change set and the author of an element; all are left out."""
        version, at = varint(self.data, at)
        if version:
            stamp, at = varint(self.data, at)
            if stamp:
                _, at = varint(self.data, at)
                _, at = self._strings(at, 2)
        return at

    def _tags(self, at: int, end: int) -> dict[str, str]:
        tags = {}
        while at < end:
            (k, v), at = self._strings(at, 2)
            tags[k.decode("utf-8", "replace")] = v.decode("utf-8", "replace")
        return tags

    def elements(self) -> Iterator[tuple]:
        at, data = 1, self.data
        if not data or data[0] != 0xFF:
            raise ValueError("the stream does not begin with a reset")
        while at < len(data):
            kind = data[at]
            at += 1
            if kind == 0xFF:
                self._reset()
                continue
            if kind == 0xFE:
                return
            if kind >= 0xF0:
                continue
            size, at = varint(data, at)
            end = at + size
            if kind in (0x10, 0x11, 0x12):
                step, p = varint(data, at)
                self.id += signed(step)
                p = self._version(p)
                if p < end:
                    yield from self._element(kind, p, end)
            at = end

    def _element(self, kind: int, p: int, end: int) -> Iterator[tuple]:
        data = self.data
        if kind == 0x10:
            x, p = varint(data, p)
            y, p = varint(data, p)
            self.lon, self.lat = self.lon + signed(x), self.lat + signed(y)
            yield "node", self.id, self.lat * 1e-7, self.lon * 1e-7, self._tags(p, end), None, None
            return
        size, p = varint(data, p)
        stop, refs, members = p + size, [], []
        while p < stop:
            step, p = varint(data, p)
            if kind == 0x11:
                self.way_ref += signed(step)
                refs.append(self.way_ref)
            else:
                (text,), p = self._strings(p, 1)
                what = text[0] - 48
                self.refs[what] += signed(step)
                members.append({"member_type": _MEMBERS[what], "member_id": self.refs[what], "role": text[1:].decode("utf-8", "replace")})
        tags = self._tags(p, end)
        yield ("way", self.id, None, None, tags, refs, None) if kind == 0x11 else ("relation", self.id, None, None, tags, None, members)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "id", "lat", "lon", "tags", "refs", "members"])
    return out.astype({"id": "int64", "lat": "float64", "lon": "float64"})


def read_pbf(spark: SparkSession, path: str) -> DataFrame:
    """The elements of PBF files; blobs are dealt to tasks. A header that requires an unknown feature is an error."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                for kind, data in pbf_blobs(content):
                    if kind == "OSMHeader":
                        check_header(data)
                    elif kind == "OSMData":
                        yield pd.DataFrame({"block": [data]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["block"]:
                yield _frame(list(pbf_block(data)))

    blocks = spark.read.format("binaryFile").load(path).select("content").mapInPandas(split, "block binary")
    return blocks.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, ELEMENT)


def read_o5m(spark: SparkSession, path: str) -> DataFrame:
    """The elements of o5m files, one task a file; elements without content, which delete others, are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = []
                for e in O5m(content).elements():
                    rows.append(e)
                    if len(rows) == 10_000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ELEMENT)


def tables_of(elements: DataFrame) -> dict[str, DataFrame]:
    """nodes, ways, way_nodes, relations and members of elements, as ``read_xml`` gives them."""
    of = lambda kind: elements.where(F.col("kind") == kind)
    return {
        "nodes": of("node").select("id", "lat", "lon", "tags"),
        "ways": of("way").select("id", "tags"),
        "way_nodes": of("way").select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id")),
        "relations": of("relation").select("id", "tags"),
        "members": of("relation").select(F.col("id").alias("rel_id"), F.posexplode("members").alias("pos", "m")).select("rel_id", "pos", "m.member_type", "m.member_id", "m.role"),
    }
