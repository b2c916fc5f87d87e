"""Measures of points, segments, boxes and rings, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import element, geo, text
from ..operators.work import spread
from . import tables as t
from .tables import SQL_NODES, SQL_WAY_NODES, read, sql_point

_PI = "pi()"


def _pairs(spark, sf_dir):
    a = t.points(spark, sf_dir, "part", "p_partkey")
    return a.join(a.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "id")


_SQL_PAIRS = f"""p AS (SELECT p_partkey AS id, {sql_point('p_partkey')} FROM part),
q AS (SELECT a.id, a.lat, a.lon, b.lat AS lat2, b.lon AS lon2, radians(a.lat * 360.0::DOUBLE / 16777216) AS y1, radians(a.lon * 360.0::DOUBLE / 16777216) AS x1,
        radians(b.lat * 360.0::DOUBLE / 16777216) AS y2, radians(b.lon * 360.0::DOUBLE / 16777216) AS x2 FROM p a JOIN p b ON b.id = a.id + 1)"""


def rhumb(spark, sf_dir):
    deg = [geo.degrees(F.col(c)) for c in ("lat", "lon", "lat2", "lon2")]
    lat, lon = geo.rhumb_destination(deg[0], deg[1], F.lit(30.0), F.lit(50_000.0))
    up, side = geo.offset_point(deg[0], deg[1], F.lit(-100.0), F.lit(2_000.0))
    return _pairs(spark, sf_dir).select("id", F.round(geo.rhumb_bearing(*deg), 6).alias("bearing"), F.round(lat, 7).alias("dest_lat"), F.round(lon, 7).alias("dest_lon"), F.round(up, 7).alias("off_lat"), F.round(side, 7).alias("off_lon"))


RHUMB_SQL = f"""WITH {_SQL_PAIRS},
r AS (SELECT *, 50000.0::DOUBLE / 6378137.0::DOUBLE AS d, 2000.0::DOUBLE / 6371000.0::DOUBLE AS o, radians(30.0::DOUBLE) AS br, radians(-100.0::DOUBLE) AS bo, ln(tan(y2 / 2 + {_PI} / 4) / tan(y1 / 2 + {_PI} / 4)) AS s FROM q),
u AS (SELECT *, y1 + d * cos(br) AS ny, asin(sin(y1) * cos(o) + cos(y1) * sin(o) * cos(bo)) AS oy FROM r)
SELECT id, round(degrees(atan2(x2 - x1, s)), 6) AS bearing, round(degrees(ny), 7) AS dest_lat,
  round(degrees(x1 + d * sin(br) / (d * cos(br) / ln(tan(ny / 2 + {_PI} / 4) / tan(y1 / 2 + {_PI} / 4)))), 7) AS dest_lon,
  round(degrees(oy), 7) AS off_lat, round(degrees(x1 + atan2(sin(bo) * sin(o) * cos(y1), cos(o) - sin(y1) * sin(oy))), 7) AS off_lon
FROM u"""


def betweens(spark, sf_dir):
    small = [(F.col(c) % 900_000).cast("int") for c in ("lat", "lon", "lat2", "lon2")]
    lat, lon = geo.between(*small, 0.25)
    return _pairs(spark, sf_dir).where((F.abs(small[2] - small[0]) < 1_000_000) & (F.abs(small[3] - small[1]) < 1_000_000)).select("id", lat.alias("lat"), lon.alias("lon"))


BETWEENS_SQL = f"""WITH {_SQL_PAIRS}, s AS (SELECT id, CAST(lat % 900000 AS INT) AS a, CAST(lon % 900000 AS INT) AS b, CAST(lat2 % 900000 AS INT) AS c, CAST(lon2 % 900000 AS INT) AS d FROM q)
SELECT id, CAST(trunc(a + (c - a) * 0.25::DOUBLE) AS INT) AS lat, CAST(trunc(b + (d - b) * 0.25::DOUBLE) AS INT) AS lon FROM s WHERE abs(c - a) < 1000000 AND abs(d - b) < 1000000"""


def segments(spark, sf_dir):
    """A point at some metres from each of many short segments, by flat distances."""
    base = [F.col("lat") / 50_000, F.col("lon") / 50_000]
    p = [base[0] + 0.001 * (F.col("id") % 7 - 3), base[1] + 0.001 * (F.col("id") % 5 - 1)]
    end = [base[0] + 0.002, base[1] + 0.001 * (F.col("id") % 3)]
    f = geo.segment_fraction(*p, *base, *end)
    return t.points(spark, sf_dir, "part", "p_partkey").select("id", F.round(f, 6).alias("share"), F.round(geo.segment_distance(*p, *base, *end), 3).alias("metres"))


def _flat(a: str, b: str, c: str, d: str) -> str:
    return f"6378137.0::DOUBLE * sqrt(pow(radians({d} - {b}) * cos(radians(({a} + {c}) / 2)), 2) + pow(radians({c} - {a}), 2))"


SEGMENTS_SQL = f"""WITH b AS (SELECT p_partkey AS id, {sql_point('p_partkey')} FROM part),
s AS (SELECT id, lat / 50000::DOUBLE AS y1, lon / 50000::DOUBLE AS x1, lat / 50000::DOUBLE + 0.001::DOUBLE * (id % 7 - 3) AS y, lon / 50000::DOUBLE + 0.001::DOUBLE * (id % 5 - 1) AS x,
        lat / 50000::DOUBLE + 0.002::DOUBLE AS y2, lon / 50000::DOUBLE + 0.001::DOUBLE * (id % 3) AS x2 FROM b),
f AS (SELECT *, cos(radians((y + y1 + y2) / 3)) AS k FROM s),
g AS (SELECT *, ((x - x1) * k * (x2 - x1) * k + (y - y1) * (y2 - y1)) / (pow((x2 - x1) * k, 2) + pow(y2 - y1, 2)) AS share,
        {_flat('y1', 'x1', 'y', 'x')} AS a, {_flat('y', 'x', 'y2', 'x2')} AS b, {_flat('y1', 'x1', 'y2', 'x2')} AS c FROM f)
SELECT id, round(share, 6) AS share, round(CASE WHEN share <= 0 THEN a WHEN share >= 1 THEN b ELSE 2 * sqrt(greatest((a + b + c) / 2 * ((a + b + c) / 2 - a) * ((a + b + c) / 2 - b) * ((a + b + c) / 2 - c), 0)) / c END, 3) AS metres FROM g"""


def angles(spark, sf_dir):
    deg = [geo.degrees(F.col(c)) for c in ("lat", "lon", "lat2", "lon2")]
    return _pairs(spark, sf_dir).select("id", F.round(geo.angle_at(F.lit(5.0), F.lit(6.0), *deg), 6).alias("turn"))


ANGLES_SQL = f"""WITH {_SQL_PAIRS}, b AS (SELECT id, degrees(atan2(x2 - x1, ln(tan(y2 / 2 + {_PI} / 4) / tan(y1 / 2 + {_PI} / 4)))) - degrees(atan2(radians(6.0::DOUBLE) - x1, ln(tan(radians(5.0::DOUBLE) / 2 + {_PI} / 4) / tan(y1 / 2 + {_PI} / 4)))) + 180 AS turn FROM q)
SELECT id, round(CASE WHEN turn > 180 THEN turn - 360 WHEN turn < -180 THEN turn + 360 ELSE turn END, 6) AS turn FROM b"""


def crossings(spark, sf_dir):
    s = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    lat, lon = F.col("lat"), F.col("lon")
    a, b = s(lat, lon), s(F.col("lat2"), F.col("lon2"))
    c, d = s(F.lit(-900_000), F.lit(-1_500_000)), s(F.lit(800_000), F.lit(1_900_000))
    met = geo.crossing(a, b, c, d)
    return _pairs(spark, sf_dir).select("id", met["lat"].alias("lat"), met["lon"].alias("lon")).where("lat is not null")


CROSSINGS_SQL = f"""WITH {_SQL_PAIRS}, s AS (SELECT id, CAST(lat AS BIGINT) AS y1, CAST(lon AS BIGINT) AS x1, CAST(lat2 AS BIGINT) AS y2, CAST(lon2 AS BIGINT) AS x2, -900000::BIGINT AS y3, -1500000::BIGINT AS x3, 800000::BIGINT AS y4, 1900000::BIGINT AS x4 FROM q),
d AS (SELECT *, (y2 - y1) * (x4 - x3) - (y4 - y3) * (x2 - x1) AS dv FROM s),
h AS (SELECT *, ((y4 - y3) * (x1 - x4) - (y1 - y4) * (x4 - x3)) / CAST(dv AS DOUBLE) AS h, ((y2 - y1) * (x1 - x3) - (y1 - y3) * (x2 - x1)) / CAST(dv AS DOUBLE) AS g FROM d WHERE dv <> 0)
SELECT id, CAST(floor(y1 + h * (y2 - y1) + 0.5) AS INT) AS lat, CAST(floor(x1 + h * (x2 - x1) + 0.5) AS INT) AS lon FROM h WHERE h BETWEEN 0 AND 1 AND g BETWEEN 0 AND 1"""


def boxes(spark, sf_dir):
    k = F.col("id")
    a = F.struct((F.col("lat") - 300_000).alias("min_lat"), (F.col("lon") - 200_001).alias("min_lon"), (F.col("lat") + 300_000).alias("max_lat"), (F.col("lon") + 200_000).alias("max_lon"))
    b = F.struct(F.lit(-500_000).alias("min_lat"), F.lit(-500_000).alias("min_lon"), F.lit(500_000).alias("max_lat"), F.lit(500_000).alias("max_lon"))
    common, parts = geo.box_common(a, b), geo.box_split(a, 2, 3)
    edge = F.col("lat") + F.when(k % 2 == 0, 300_000).otherwise(299_999)
    return t.points(spark, sf_dir, "part", "p_partkey").select(
        "id", geo.boxes_meet(a, b).alias("meets"), common["min_lat"].alias("common_lat"), common["max_lon"].alias("common_lon"), geo.box_contains(b, F.col("lat"), F.col("lon")).alias("inside"),
        geo.box_edge(a, edge, F.col("lon")).alias("on_edge"), geo.box_inside(a, edge, F.col("lon")).alias("strictly"), parts[3]["min_lon"].alias("part_lon"), parts[5]["max_lat"].alias("part_lat"),
    )


BOXES_SQL = f"""WITH p AS (SELECT p_partkey AS id, {sql_point('p_partkey')} FROM part), m AS (SELECT *, lat - 300000 <= 500000 AND lat + 300000 >= -500000 AND lon - 200001 <= 500000 AND lon + 200000 >= -500000 AS meets FROM p)
SELECT id, meets, CASE WHEN meets THEN greatest(lat - 300000, -500000) END AS common_lat, CASE WHEN meets THEN least(lon + 200000, 500000) END AS common_lon, lat BETWEEN -500000 AND 500000 AND lon BETWEEN -500000 AND 500000 AS inside,
  id % 2 = 0 AS on_edge, id % 2 <> 0 AS strictly, lon - 200001 + 200000 AS part_lon, lat + 300000 AS part_lat FROM m"""


def rings(spark, sf_dir):
    """Element functions and centres of ways over their points."""
    from ..operators import ways

    lines = ways.assembled(t.way_nodes(spark, sf_dir), t.nodes(spark, sf_dir))
    pts = F.col("points")
    of = element.functions_of("way", lambda k: F.lit("30 mph"), F.col("way_id"), pts, F.col("complete"))
    centre, box = geo.centre_of(pts), geo.bounds(pts)
    return lines.select(
        "way_id", F.round(of["length()"].cast("double"), 1).alias("metres"), of["is_closed()"].alias("is_closed"), of["is_complete()"].alias("is_complete"), of["area_size()"].alias("area_size"), of["osmid()"].alias("osmid"), of["type()"].alias("type"),
        of["maxspeedkmh()"].alias("kmh"), of["maxspeedmph()"].alias("mph"), centre["lat"].alias("lat"), centre["lon"].alias("lon"), box["min_lat"].alias("min_lat"), box["max_lon"].alias("max_lon"),
    )


RINGS_SQL = f"""WITH {SQL_NODES}, {SQL_WAY_NODES},
p AS (SELECT way_id, pos, node_id, CAST(lat AS BIGINT) AS lat, CAST(lon AS BIGINT) AS lon, count(*) OVER w AS n, first_value(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS first, last_value(node_id) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
  FROM way_nodes JOIN nodes USING (node_id) WINDOW w AS (PARTITION BY way_id)),
s AS (SELECT a.way_id, a.n, radians(a.lat * 360.0::DOUBLE / 16777216) AS y1, radians(a.lon * 360.0::DOUBLE / 16777216) AS x1, radians(b.lat * 360.0::DOUBLE / 16777216) AS y2, radians(b.lon * 360.0::DOUBLE / 16777216) AS x2 FROM p a JOIN p b ON a.way_id = b.way_id AND b.pos = a.pos + 1),
r AS (SELECT *, sqrt(pow((x2 - x1) * cos((y1 + y2) / 2), 2) + pow(y2 - y1, 2)) * 6378137.0::DOUBLE AS flat, ln(tan(y2 / 2 + pi() / 4) / tan(y1 / 2 + pi() / 4)) AS k FROM s),
m AS (SELECT way_id, sum(CASE WHEN flat < 10000 THEN flat ELSE 6378137.0::DOUBLE * sqrt(pow(y2 - y1, 2) + pow(CASE WHEN abs(k) > 1e-10 THEN (y2 - y1) / k ELSE cos(y1) END * (x2 - x1), 2)) END) AS metres FROM r GROUP BY 1),
z AS (SELECT a.way_id, abs(sum((b.lon - a.lon) * (a.lat + b.lat))) / 2.0 AS area FROM p a JOIN p b ON a.way_id = b.way_id AND b.pos = (a.pos + 1) % a.n GROUP BY 1),
g AS (SELECT way_id, max(n) AS n, any_value(first = last) AS same, any_value(first = last) AND max(n) > 2 AS closed, sum(lat) AS sy, sum(lon) AS sx, min(lat) AS min_lat, max(lon) AS max_lon, any_value(lat) FILTER (pos = 0) AS y0, any_value(lon) FILTER (pos = 0) AS x0 FROM p GROUP BY 1),
h AS (SELECT *, CASE WHEN same AND n > 1 THEN n - 1 ELSE n END AS c FROM g)
SELECT h.way_id, round(coalesce(metres, 0), 1) AS metres, CASE WHEN closed THEN 'true' ELSE 'false' END AS is_closed, 'true' AS is_complete, CASE WHEN closed AND n >= 4 THEN format('{{:.3f}}', CAST(area AS DOUBLE)) ELSE '0' END AS area_size, CAST(h.way_id AS VARCHAR) AS osmid, 'way' AS type,
  '48.3' AS kmh, '30.0' AS mph, CAST(floor(CAST(CASE WHEN c < n THEN sy - y0 ELSE sy END AS DOUBLE) / c + 0.5) AS INT) AS lat, CAST(floor(CAST(CASE WHEN c < n THEN sx - x0 ELSE sx END AS DOUBLE) / c + 0.5) AS INT) AS lon, CAST(min_lat AS INT) AS min_lat, CAST(max_lon AS INT) AS max_lon
FROM h LEFT JOIN m USING (way_id) LEFT JOIN z USING (way_id)"""


def places(spark, sf_dir):
    k = F.col("p_partkey")
    lat, lon = (k * 7919 % 4093 - 2000).cast("int"), (k * 104729 % 8191 - 4000).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(geo.alternative_places(lat, lon)).alias("p")).select("p_partkey", "p.lat", "p.lon")


PLACES_SQL = """WITH a AS (SELECT p_partkey, CAST(p_partkey * 7919 % 4093 - 2000 AS INT) AS y, CAST(p_partkey * 104729 % 8191 - 4000 AS INT) AS x FROM part),
b AS (SELECT *, (y + 32) >> 6 AS lat, (x + 32) >> 6 AS lon FROM a),
c AS (SELECT *, CASE WHEN lat * 64 - y > 16 THEN lat - 1 WHEN lat * 64 - y < -16 THEN lat + 1 END AS lat2, CASE WHEN lon * 64 - x > 16 THEN lon - 1 WHEN lon * 64 - x < -16 THEN lon + 1 END AS lon2 FROM b)
SELECT p_partkey, lat2 AS lat, lon2 AS lon FROM c WHERE lat2 IS NOT NULL AND lon2 IS NOT NULL UNION ALL SELECT p_partkey, lat2, lon FROM c WHERE lat2 IS NOT NULL UNION ALL SELECT p_partkey, lat, lon2 FROM c WHERE lon2 IS NOT NULL"""


def heights(spark, sf_dir):
    """Heights within cells whose corners come from a formula; every eleventh corner is void."""
    k = F.col("p_partkey")
    corner = lambda n: F.when((k + n) % 11 != 0, ((k * 31 + n * 77) % 900).cast("int"))
    x, y = (k % 10) / 10.0, (k % 7) / 7.0
    return read(spark, sf_dir, "part").select("p_partkey", geo.bilinear(corner(0), corner(1), corner(2), corner(3), x, y).alias("height"))


_C = "CASE WHEN (p_partkey + {n}) % 11 <> 0 THEN (p_partkey * 31 + {n} * 77) % 900 END"
HEIGHTS_SQL = f"""WITH a AS (SELECT p_partkey, {_C.format(n=0)} AS lb, {_C.format(n=1)} AS rb, {_C.format(n=2)} AS lt, {_C.format(n=3)} AS rt, (p_partkey % 10) / 10.0::DOUBLE AS x, (p_partkey % 7) / 7.0::DOUBLE AS y FROM part),
b AS (SELECT p_partkey, x, y, coalesce(lb, rb + lt - rt) AS lb, coalesce(rb, lb + rt - lt) AS rb, coalesce(lt, lb + rt - rb) AS lt, coalesce(rt, rb + lt - lb) AS rt FROM a)
SELECT p_partkey, CAST(floor(lb * (1 - x) * (1 - y) + rb * x * (1 - y) + lt * (1 - x) * y + rt * x * y + 0.5) AS INT) AS height FROM b"""


def more_filters(spark, sf_dir):
    """Value filters of names, codes and signs."""
    name, brand = F.col("p_name"), F.col("p_brand")
    items = F.replace(F.col("p_type"), F.lit(" "), F.lit(";"))
    street = F.concat(F.lit("Rue de la "), name, F.when(F.col("p_size") % 2 == 0, F.lit(" Road")).otherwise(F.lit("weg")))
    # A small file is one split, so its rows are dealt to all tasks first.
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey", text.parts_before(items, -1).alias("before"), text.parts_after(items, 1).alias("after"), text.parts_after(items, 9).alias("none"), F.concat(F.lit(text.prefix_of("2a")), name).alias("hexed"),
        text.to_ascii(F.concat(name, F.lit("Ångström Łódź œuvre 日"))).alias("ascii"), text.to_latin1(F.concat(brand, F.lit("ÅŁő日"))).alias("latin1"), text.country_iso(F.when(F.col("p_size") % 2 == 0, F.lit("France")).otherwise(brand)).alias("iso"),
        text.name_parts(street, ["Rue ", "Rue de la "], [" Road", "weg", "oad"]).alias("marked"), text.highway_symbol(F.col("p_type"), "oval", 3, 40).alias("shield"), F.hex(text.encoded(F.concat(brand, F.lit("é")), "ISO-8859-1")).alias("coded"),
        text.encoded6(F.lit("Ab 7")).alias("six"), text.converted(F.concat(F.col("p_size").cast("string"), F.lit(" parsec")), "m", "ft").alias("unit"),
    )


MORE_FILTERS_SQL = """WITH a AS (SELECT *, string_split(p_type, ' ') AS w, 'Rue de la ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' Road' ELSE 'weg' END AS street FROM part)
SELECT p_partkey, array_to_string(list_transform(w[:-2], lambda x: x || ';'), '') AS before, array_to_string(list_transform(w[2:], lambda x: x || ';'), '') AS after, NULL::VARCHAR AS none, '*' || p_name AS hexed,
  p_name || 'Angstrom Lodz oeuvre ?' AS ascii, p_brand || 'ÅLo?' AS latin1, CASE WHEN p_size % 2 = 0 THEN 'FRA' ELSE p_brand END AS iso,
  'Rue de la' || chr(30) || p_name || CASE WHEN p_size % 2 = 0 THEN chr(31) || 'Road' ELSE chr(28) || 'weg' END AS marked, chr(6) || replace(p_type, ' ', '') AS shield, hex(encode(p_brand)) || 'E9' AS coded,
  '042027FC' AS six, p_size || ' parsec' AS unit FROM a"""

QUERIES = {
    "geo_rhumb_and_offset": (rhumb, RHUMB_SQL),
    "geo_between": (betweens, BETWEENS_SQL),
    "geo_segment_distance": (segments, SEGMENTS_SQL),
    "geo_angle": (angles, ANGLES_SQL),
    "geo_crossing": (crossings, CROSSINGS_SQL),
    "geo_boxes": (boxes, BOXES_SQL),
    "geo_ring_functions": (rings, RINGS_SQL),
    "geo_alternative_places": (places, PLACES_SQL),
    "elevation_bilinear": (heights, HEIGHTS_SQL),
    "value_filters_more": (more_filters, MORE_FILTERS_SQL),
}
