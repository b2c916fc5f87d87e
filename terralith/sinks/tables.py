"""Logical tables of a map and their Parquet files, catalogues over tiles, and text for other programs."""

from __future__ import annotations

import re
from functools import reduce
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.names import global_rank


def write_map(tables: dict[str, DataFrame], path: str, by: list[str] | None = None, sort: dict[str, list[str]] | None = None) -> None:
    """Writes each table to a folder of its own, split by the columns of ``by`` that it has and sorted within files.

    Rows of one split are brought together first, so that a split is few files.
    """
    for name, table in tables.items():
        own = [c for c in by or [] if c in table.columns]
        out = table.repartition(*own) if own else table
        order = own + (sort or {}).get(name, [])
        out = out.sortWithinPartitions(*order) if order else out
        writer = out.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*own) if own else writer).parquet(f"{path}/{name}")


def place_tables(features: DataFrame) -> dict[str, DataFrame]:
    """labels, countries, regions, cities and zips of features (label, country, region, city, zip), each distinct and numbered from 1.

    A region has the number of its country, a city that of its region; numbers follow the order of names.
    """
    numbered = lambda df, keys: global_rank(df.distinct(), [F.col(k).asc_nulls_first() for k in keys], "id")
    labels = numbered(features.where("label is not null").select("label"), ["label"])
    countries = numbered(features.where("country is not null").select("country"), ["country"])
    up = lambda df, parent, key: df.join(parent.select(*key, F.col("id").alias("parent")), key, "left")
    regions = numbered(features.where("region is not null").select("country", "region"), ["country", "region"])
    regions = up(regions, countries, ["country"])
    cities = numbered(features.where("city is not null").select("country", "region", "city"), ["country", "region", "city"])
    cities = cities.alias("c").join(regions.alias("r"), F.col("c.country").eqNullSafe(F.col("r.country")) & F.col("c.region").eqNullSafe(F.col("r.region")), "left").select("c.*", F.col("r.id").alias("parent"))
    return {"labels": labels, "countries": countries, "regions": regions, "cities": cities, "zips": numbered(features.where("zip is not null").select("zip"), ["zip"])}


def network_tables(roads: DataFrame, arcs: DataFrame, centres: DataFrame) -> dict[str, DataFrame]:
    """roads, arcs and route_centres; each arc has the centre of its start node. centres has node_id and centre."""
    own = arcs.join(centres.select(F.col("node_id").alias("from_node"), "centre"), "from_node", "left")
    count = centres.groupBy("centre").agg(F.count(F.lit(1)).alias("n_nodes"))
    return {"roads": roads, "arcs": own, "route_centres": count.join(own.groupBy("centre").agg(F.count(F.lit(1)).alias("n_arcs")), "centre", "left")}


def height_samples(heights: DataFrame, step: int) -> DataFrame:
    """(lat, lon, row, col, height): every step-th height of a grid as ``read_heights`` gives it."""
    each = heights.where(F.col("row") % step == 0).select("lat", "lon", "row", F.posexplode("heights").alias("col", "height"))
    return each.where((F.col("col") % step == 0) & F.col("height").isNotNull())


def catalogue(features: DataFrame) -> DataFrame:
    """(tile, n, n_points, n_lines, n_shapes, min_lat, min_lon, max_lat, max_lon, bytes): one row for each tile of features (tile, kind, points).

    Partial sums are made by tile where the rows are; bytes are those that features are expected to take.
    """
    box, n = geo.bounds(F.col("points")), F.size("points")
    size = F.when(F.col("kind") == "point", 9).otherwise(11 + n * 4)
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return features.withColumn("b", box).groupBy("tile").agg(
        F.count(F.lit(1)).alias("n"), of("point").alias("n_points"), of("line").alias("n_lines"), of("shape").alias("n_shapes"),
        F.min("b.min_lat").alias("min_lat"), F.min("b.min_lon").alias("min_lon"), F.max("b.max_lat").alias("max_lat"), F.max("b.max_lon").alias("max_lon"), F.sum(size).alias("bytes"),
    )


def combined(tiles: list[DataFrame]) -> DataFrame:
    """The features of all tiles in one table; a column that a tile lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tiles)


#: The type of the polygon that outlines a tile on an overview. Fixed value.
TILE_TYPE = 0x4A


def overview(features: DataFrame, tiles: DataFrame, most: int) -> DataFrame:
    """What an overview map shows: features that are visible at a resolution of ``most`` or coarser, and the outline of each tile.

    features has tile, kind, type, min_res, label and points; tiles is ``catalogue``.
    """
    corner = lambda y, x: F.struct(F.col(y).alias("lat"), F.col(x).alias("lon"))
    ring = F.array(corner("min_lat", "min_lon"), corner("max_lat", "min_lon"), corner("max_lat", "max_lon"), corner("min_lat", "max_lon"), corner("min_lat", "min_lon"))
    outline = tiles.select("tile", F.lit("shape").alias("kind"), F.lit(TILE_TYPE).alias("type"), F.lit(most).alias("min_res"), F.col("tile").cast("string").alias("label"), ring.alias("points"))
    seen = features.where(F.col("min_res") <= most).select("tile", "kind", "type", "min_res", "label", F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))
    return seen.unionByName(outline)


def overview_types(features: DataFrame) -> DataFrame:
    """(kind, type, min_res): the least resolution of each type."""
    return features.groupBy("kind", "type").agg(F.min("min_res").alias("min_res"))


def _degrees(units: Column) -> Column:
    return F.format_string("%.6f", geo.degrees(units))


def geo_json(features: DataFrame) -> DataFrame:
    """(value): one GeoJSON feature a line, of features (id, kind, label, points); write it as text."""
    at = lambda p: F.concat(F.lit("["), _degrees(p["lon"]), F.lit(","), _degrees(p["lat"]), F.lit("]"))
    list_ = F.array_join(F.transform("points", at), ",")
    shape = F.when(F.col("kind") == "point", F.concat(F.lit('{"type":"Point","coordinates":'), at(F.element_at("points", 1)), F.lit("}")))
    shape = shape.when(F.col("kind") == "line", F.concat(F.lit('{"type":"LineString","coordinates":['), list_, F.lit("]}")))
    shape = shape.otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":[['), list_, F.lit("]]}")))
    label = F.to_json(F.struct(F.col("label").alias("label")))
    return features.select(F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.lit(',"properties":'), label, F.lit(',"geometry":'), shape, F.lit("}")).alias("value"))


def gpx(track: list[tuple[float, float]], name: str) -> str:
    """A track of (lat, lon) in degrees as GPX text, for looking at single ways."""
    points = "".join(f'<trkpt lat="{lat:.6f}" lon="{lon:.6f}"/>' for lat, lon in track)
    return f'<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="terralith" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>{quoteattr(name)[1:-1]}</name><trkseg>{points}</trkseg></trk></gpx>'


def osm_xml(nodes: list[tuple[int, float, float]], ways: list[tuple[int, list[int], dict[str, str]]]) -> str:
    """Nodes (id, lat, lon) and ways (id, node ids, tags) as map XML, for looking at small cuts."""
    out = [f'<node id="{i}" lat="{lat:.7f}" lon="{lon:.7f}"/>' for i, lat, lon in nodes]
    for i, refs, tags in ways:
        out.append(f'<way id="{i}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + "".join(f"<tag k={quoteattr(k)} v={quoteattr(v)}/>" for k, v in sorted(tags.items())) + "</way>")
    return '<?xml version="1.0" encoding="UTF-8"?><osm version="0.6">' + "".join(out) + "</osm>"


def parse_sort(source: str) -> dict:
    """A sort description: its code page, and for each character its (primary, secondary, tertiary) place.

    ``<`` begins a new primary place, ``;`` a new secondary and ``,`` a new tertiary one; ``=`` gives the same places
    again. A character is itself or four hexadecimal digits; ``expand x to a b`` gives those of other characters.
    """
    page = re.search(r"(?m)^\s*codepage\s+(\d+)", source)
    places: dict[str, tuple[int, int, int]] = {}
    expansions: dict[str, list[str]] = {}
    body, primary, secondary, tertiary = source.partition("characters")[2], 0, 1, 1
    sign = "<"

    def char(word: str) -> str:
        return chr(int(word, 16)) if re.fullmatch(r"[0-9a-fA-F]{4}", word) else word

    for line in body.splitlines():
        if m := re.match(r"\s*expand\s+(\S+)\s+to\s+(.+)$", line):
            expansions[char(m[1])] = [char(w) for w in m[2].split()]
            continue
        if re.match(r"\s*(#|flags|code\b)", line):
            continue
        for token in re.findall(r"[<;,=]|[0-9a-fA-F]{4}|\S", line):
            if token in "<;,=" and len(token) == 1:
                sign = token
                continue
            if sign == "<":
                primary, secondary, tertiary = primary + 1, 1, 1
            elif sign == ";":
                secondary, tertiary = secondary + 1, 1
            elif sign == ",":
                tertiary += 1
            places[char(token)] = (primary, secondary, tertiary)
            sign = ","
    return {"codepage": int(page[1]) if page else None, "places": places, "expansions": expansions}


def sort_bytes(name: Column, description: dict) -> Column:
    """The sort key of a name as hex digits: the primary places of all characters, then the secondary ones, then the tertiary ones.

    Characters without a place are left out; expanded ones stand for several.
    """
    full = dict(description["places"])
    rows = {c: [full[c]] for c in full} | {c: [full[x] for x in xs if x in full] for c, xs in description["expansions"].items()}
    hexed = lambda k: F.create_map(*[v for c, ps in rows.items() for v in (F.lit(c), F.lit("".join(f"{p[k]:02x}" for p in ps)))])
    letters = F.filter(F.split(name, ""), lambda c: c != "")
    part = lambda k: F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(hexed(k), c), F.lit(""))), "")
    return F.concat(part(0), F.lit("00"), part(1), F.lit("00"), part(2))
