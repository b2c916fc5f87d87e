"""OSM XML by Spark's XML source; Polish text files and polygon files by small parsers."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAGS = "tag array<struct<_k:string,_v:string>>"


def _map(tags) -> F.Column:
    """Tags as a map; of a repeated key the last value counts."""
    pairs = F.coalesce(tags, F.array().cast("array<struct<_k:string,_v:string>>"))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, v: k != t["_k"]), F.create_map(t["_k"], t["_v"])))


def _number(id_: F.Column, kind) -> F.Column:
    """An id as a number; one that is none becomes a hash of itself, from 2**62 on, the same wherever it is named."""
    made = F.shiftrightunsigned(F.xxhash64(F.lit(kind) if isinstance(kind, str) else kind, id_), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(id_.try_cast("long"), made)


def _numbered(elements: DataFrame, kind: str) -> DataFrame:
    return elements.withColumn("_id", _number(F.col("_id"), kind))


def read_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """bounds, nodes, ways, way_nodes, relations and members of an OSM XML file, compressed ones too."""
    scan = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = _numbered(scan("node", f"_id string, _lat double, _lon double, {_TAGS}"), "node")
    ways = _numbered(scan("way", f"_id string, nd array<struct<_ref:string>>, {_TAGS}"), "way")
    ways = ways.withColumn("nd", F.transform("nd", lambda n: F.struct(_number(n["_ref"], "node").alias("_ref"))))
    relations = _numbered(scan("relation", f"_id string, member array<struct<_type:string,_ref:string,_role:string>>, {_TAGS}"), "relation")
    relations = relations.withColumn("member", F.transform("member", lambda m: F.struct(m["_type"].alias("_type"), _number(m["_ref"], m["_type"]).alias("_ref"), m["_role"].alias("_role"))))
    bounds = scan("bounds", "_minlat double, _minlon double, _maxlat double, _maxlon double")
    return {
        "bounds": bounds.select(*[F.col(f"_{c}").alias(c) for c in ("minlat", "minlon", "maxlat", "maxlon")]),
        "nodes": nodes.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _map(F.col("tag")).alias("tags")),
        "ways": ways.select(F.col("_id").alias("id"), _map(F.col("tag")).alias("tags")),
        "way_nodes": ways.select(F.col("_id").alias("way_id"), F.posexplode("nd").alias("pos", "n")).select("way_id", "pos", F.col("n._ref").alias("node_id")),
        "relations": relations.select(F.col("_id").alias("id"), _map(F.col("tag")).alias("tags")),
        "members": relations.select(F.col("_id").alias("rel_id"), F.posexplode("member").alias("pos", "m")).select("rel_id", "pos", F.col("m._type").alias("member_type"), F.col("m._ref").alias("member_id"), F.col("m._role").alias("role")),
    }


#: Kinds of sections by their names in a file. Fixed values.
SECTIONS = {"POI": "POI", "RGN10": "POI", "RGN20": "POI", "POLYLINE": "POLYLINE", "RGN40": "POLYLINE", "POLYGON": "POLYGON", "RGN80": "POLYGON", "RESTRICT": "RESTRICT", "IMG ID": "IMG ID"}


def parse_polish(content: str, most: int = 250) -> Iterator[dict]:
    """Elements of a Polish file: kind, ordinal, fields, level and points.

    Each ``DataN`` or ``OriginN`` line is an element at level N; lines of over ``most`` points that are no roads are cut, the end
    of one piece being the start of the next; polygons are closed.
    """
    kind, fields, data, ordinal = None, {}, [], 0
    for line in content.splitlines():
        line = line.strip()
        if not line or line.startswith(";"):
            continue
        if line.upper().startswith("[END"):
            if kind:
                for level, points in data or [(None, [])]:
                    if kind == "POLYGON" and points and points[0] != points[-1]:
                        points = [*points, points[0]]
                    step = most - 1
                    cut = kind == "POLYLINE" and "RoadID" not in fields and len(points) > most
                    pieces = [points[i : i + most] for i in range(0, len(points) - 1, step)] if cut else [points]
                    for p in pieces:
                        yield {"kind": kind, "ordinal": ordinal, "fields": dict(fields), "level": level, "points": [{"lat": a, "lon": b} for a, b in p]}
                ordinal += 1
            kind, fields, data = None, {}, []
        elif line.startswith("["):
            kind, fields, data = SECTIONS.get(line.strip("[]").strip().upper()), {}, []
        elif "=" in line and kind:
            key, _, value = (part.strip() for part in line.partition("="))
            if m := re.fullmatch(r"(?:Data|Origin)(\d+)", key):
                found = [tuple(float(x) for x in p.split(",")[:2]) for p in re.findall(r"\(([^)]*)\)", value)]
                data.append((int(m[1]), found))
            else:
                fields[key] = value


def polish_charset(content: bytes) -> str:
    """The character set that a Polish file names: its CodePage line, else Latin 1."""
    found = re.search(rb"(?im)^\s*CodePage\s*=\s*(\S+)", content)
    page = found[1].decode("ascii", "replace") if found else ""
    return "utf-8" if page == "65001" else f"cp{page}" if page.isdigit() and page != "0" else "latin-1"


def read_polish(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, ordinal, fields, level, points) of all sections of Polish files; a file is one task's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                if p.endswith(".gz"):
                    content = gzip.decompress(content)
                rows = list(parse_polish(content.decode(polish_charset(content), "replace")))
                out = pd.DataFrame([{"path": p, **r} for r in rows], columns=["path", "kind", "ordinal", "fields", "level", "points"])
                yield out.astype({"level": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, kind string, ordinal int, fields map<string,string>, level long, points array<struct<lat:double,lon:double>>")


def polish_roads(sections: DataFrame) -> DataFrame:
    """(road_id, nodes, road_class, road_speed, oneway, toll, denied): roads by their RoadID, NodN and RouteParam lines.

    nodes has (place, node_id, on_boundary) of each NodN; RouteParam is speed, class, one way, toll, then vehicles that are denied.
    """
    f = F.col("fields")
    get = lambda k: F.try_element_at(f, F.lit(k))
    nods = F.filter(F.map_entries(f), lambda e: e["key"].rlike("(?i)^nod[0-9]+$"))
    parts = F.transform(nods, lambda e: F.split(e["value"], r"\s*,\s*"))
    nodes = F.array_sort(F.transform(parts, lambda p: F.struct(p[0].try_cast("int").alias("place"), p[1].try_cast("long").alias("node_id"), F.coalesce(F.get(p, F.lit(2)) == "1", F.lit(False)).alias("on_boundary"))))
    route = F.split(F.coalesce(get("RouteParam"), get("RouteParams"), F.lit("0,0,0,0")), r"\s*,\s*")
    number = lambda i: F.coalesce(F.get(route, F.lit(i)).try_cast("int"), F.lit(0))
    roads = sections.where((F.col("kind") == "POLYLINE") & get("RoadID").isNotNull())
    denied = F.transform(F.filter(F.transform(route, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: (x["i"] > 3) & (x["v"] == "1")), lambda x: x["i"] - 4)
    return roads.select(get("RoadID").try_cast("long").alias("road_id"), nodes.alias("nodes"), number(1).alias("road_class"), number(0).alias("road_speed"), (number(2) != 0).alias("oneway"), (number(3) != 0).alias("toll"), denied.alias("denied"))


def polish_restrictions(sections: DataFrame, roads: DataFrame) -> DataFrame:
    """(ordinal, from_road, from_node, via_node, to_node, to_road): turn restrictions whose roads hold the nodes that they name.

    TraffPoints names from, via and to nodes, TraffRoads the roads; a line in which one of them lacks is left out.
    """
    f = F.col("fields")
    get = lambda *ks: F.coalesce(*[F.try_element_at(f, F.lit(k)) for k in ks])
    nodes, ways = F.split(get("TraffPoints", "Nod"), r"\s*,\s*"), F.split(get("TraffRoads"), r"\s*,\s*")
    at = lambda a, i: F.get(a, F.lit(i)).try_cast("long")
    rows = sections.where(F.col("kind") == "RESTRICT").select("ordinal", at(nodes, 0).alias("from_node"), at(nodes, 1).alias("via_node"), at(nodes, 2).alias("to_node"), at(ways, 0).alias("from_road"), at(ways, 1).alias("to_road"))
    on = roads.select("road_id", F.transform("nodes", lambda n: n["node_id"]).alias("ids"))
    for side in ("from", "to"):
        rows = rows.join(on.select(F.col("road_id").alias(f"{side}_road"), F.col("ids").alias(f"{side}_ids")), f"{side}_road")
        rows = rows.where(F.array_contains(f"{side}_ids", F.col(f"{side}_node")) & F.array_contains(f"{side}_ids", F.col("via_node")))
    return rows.select("ordinal", "from_road", "from_node", "via_node", "to_node", "to_road")


def parse_polygon(content: str) -> list[tuple[bool, list[tuple[float, float]]]]:
    """(is a hole, [(lat, lon)]) of the sections of a polygon file."""
    out, lines = [], [x.strip() for x in content.splitlines()][1:]
    at = 0
    while at < len(lines) and lines[at] != "END":
        hole, ring, at = lines[at].startswith("!"), [], at + 1
        while lines[at] != "END":
            lon, lat = map(float, lines[at].split()[:2])
            ring.append((lat, lon))
            at += 1
        out.append((hole, ring))
        at += 1
    return out


def keep_tags(tags: F.Column, deleted: list[tuple[str, str]], ignore_fixme: bool = False) -> F.Column:
    """Tags without the listed key=value (or key=*) pairs and, if asked, without fix-me values."""

    def stays(k, v):
        gone = F.lit(False)
        for key, value in deleted:
            gone = gone | ((k == key) & (F.lit(True) if value == "*" else v == value))
        if ignore_fixme:
            gone = gone | (v.rlike(r"\A(?i)fix[ _]?+me\z") & (k != "fixme"))
        return ~gone

    return F.map_filter(tags, stays)
