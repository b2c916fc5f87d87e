"""Binary and text formats, read back from files written here."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from terralith.sinks import tables as sinks
from terralith.sources import binary, dispatch, osm


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def zigzag(n):
    return varint((n << 1) ^ (n >> 63) if n >= 0 else (-n << 1) - 1)


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def steps(numbers):
    return b"".join(zigzag(b - a) for a, b in zip([0, *numbers], numbers))


def blob(kind, data, packed=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if packed else field(1, data)
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">i", len(head)) + head + body


STRINGS = [b"", b"highway", b"primary", b"name", "Straße".encode(), b"outer", b"type", b"m"]


def block():
    dense = field(1, steps([10, 12, 5])) + field(8, steps([500_000_000, 500_000_010, -7])) + field(9, steps([80_000_000, 80_000_010, -9])) + field(10, b"".join(map(varint, [1, 2, 0, 0, 3, 4, 0])))
    node = field(1, (77 << 1)) + field(2, varint(3)) + field(3, varint(4)) + field(8, (100 << 1)) + field(9, (200 << 1))
    way = field(1, 900) + field(2, varint(1) + varint(3)) + field(3, varint(2) + varint(4)) + field(8, steps([10, 12, 5, 10]))
    relation = field(1, 901) + field(2, varint(6)) + field(3, varint(7)) + field(8, varint(5) + varint(0)) + field(9, steps([900, 10])) + field(10, varint(1) + varint(0))
    groups = [field(2, dense), field(1, node), field(3, way), field(4, relation)]
    return field(1, b"".join(field(1, s) for s in STRINGS)) + b"".join(field(2, g) for g in groups)


def test_pbf(spark, tmp_path):
    data = blob(b"OSMHeader", field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes")) + blob(b"OSMData", block()) + blob(b"OSMData", block(), packed=False)
    (tmp_path / "a.osm.pbf").write_bytes(data)
    got = dispatch.read_map(spark, str(tmp_path / "a.osm.pbf"))
    nodes = sorted({(r.id, round(r.lat, 7), round(r.lon, 7), tuple(sorted(r.tags.items()))) for r in got["nodes"].collect()})
    assert nodes == [(5, -7e-07, -9e-07, (("name", "Straße"),)), (10, 50.0, 8.0, (("highway", "primary"),)), (12, 50.000001, 8.000001, ()), (77, 1e-05, 2e-05, (("name", "Straße"),))]
    assert got["nodes"].count() == 8
    assert sorted({(r.way_id, r.pos, r.node_id) for r in got["way_nodes"].collect()}) == [(900, 0, 10), (900, 1, 12), (900, 2, 5), (900, 3, 10)]
    assert got["ways"].first().tags == {"highway": "primary", "name": "Straße"}
    assert sorted({(r.rel_id, r.pos, r.member_type, r.member_id, r.role) for r in got["members"].collect()}) == [(901, 0, "way", 900, "outer"), (901, 1, "node", 10, "")]
    with pytest.raises(ValueError):
        binary.check_header(field(4, b"HistoricalInformation"))


def test_o5m(spark, tmp_path):
    pair = lambda a, b: b"\0" + a + b"\0" + b + b"\0"
    sized = lambda kind, body: bytes([kind]) + varint(len(body)) + body
    one = zigzag(10) + varint(3) + zigzag(100) + zigzag(5) + pair(varint(1020), b"Jo") + zigzag(80_000_000) + zigzag(500_000_000) + pair(b"highway", b"primary")
    two = zigzag(2) + varint(1) + zigzag(1) + zigzag(1) + b"\0\0\0" + zigzag(10) + zigzag(-10) + varint(2) + pair(b"name", b"n")
    gone = zigzag(1) + varint(0)
    refs = zigzag(10) + zigzag(2)
    way = zigzag(5) + varint(0) + varint(len(refs)) + refs + varint(2)
    role = zigzag(18) + b"\0" + b"1outer\0" + zigzag(0) + varint(1)
    relation = zigzag(1) + varint(0) + varint(len(role)) + role + pair(b"type", b"m")
    data = b"\xff" + sized(0xE0, b"o5m2") + sized(0x10, one) + sized(0x10, two) + sized(0x10, gone) + b"\xff" + sized(0x11, zigzag(18) + varint(0) + varint(len(refs)) + refs + pair(b"k", b"v")) + sized(0x12, relation) + b"\xfe"
    del way
    (tmp_path / "a.o5m").write_bytes(data)
    got = dispatch.read_map(spark, str(tmp_path / "a.o5m"))
    assert sorted((r.id, round(r.lat, 6), round(r.lon, 6), r.tags) for r in got["nodes"].collect()) == [(10, 50.0, 8.0, {"highway": "primary"}), (12, 49.999999, 8.000001, {"highway": "primary", "name": "n"})]
    assert [(r.way_id, r.node_id) for r in got["way_nodes"].orderBy("pos").collect()] == [(18, 10), (18, 12)]
    assert [(r.rel_id, r.member_type, r.member_id, r.role) for r in got["members"].orderBy("pos").collect()] == [(19, "way", 18, "outer"), (19, "way", 18, "outer")]


def test_xml_ids_and_bounds(spark, tmp_path):
    text = '<osm><bounds minlat="1" minlon="2" maxlat="3" maxlon="4"/><node id="x1" lat="1.5" lon="2"/><node id="2" lat="1" lon="2"/><way id="w"><nd ref="x1"/><nd ref="2"/></way></osm>'
    (tmp_path / "a.osm.gz").write_bytes(gzip.compress(text.encode()))
    got = dispatch.read_map(spark, str(tmp_path / "a.osm.gz"))
    assert tuple(got["bounds"].first()) == (1.0, 2.0, 3.0, 4.0)
    ids = {r.lat: r.id for r in got["nodes"].collect()}
    assert ids[1.0] == 2 and ids[1.5] >= 1 << 62
    assert [r.node_id for r in got["way_nodes"].orderBy("pos").collect()] == [ids[1.5], 2]


def test_polish(spark, tmp_path):
    long = ",".join(f"(1.0,{i})" for i in range(600))
    text = f"""[IMG ID]\nCodePage=1252\n[END]\n; comment\n[POLYLINE]\nType=0x1\nLabel=Straße\nData0=(1,2),(3.5,4)\nData10=(5,6),(7,8)\nData2=(9,9),(8,8)\n[END]
[POLYGON]\nData0=(0,0),(0,1),(1,1)\n[END]\n[POLYLINE]\nData0={long}\n[END]\n[POLYLINE]\nRoadID=7\nRouteParam=3,2,1,0,0,1,0\nNod1=0,11,0\nNod2=1,12,1\nData0=(1,1),(2,2)\n[END]
[POLYLINE]\nRoadID=8\nNod1=0,12,0\nNod2=1,13,0\nData0=(2,2),(3,3)\n[END]\n[Restrict]\nTraffPoints=11,12,13\nTraffRoads=7,8\n[END-Restrict]\n[Restrict]\nTraffPoints=99,12,13\nTraffRoads=7,8\n[END-Restrict]\n"""
    (tmp_path / "a.mp").write_bytes(text.encode("cp1252"))
    got = osm.read_polish(spark, str(tmp_path / "a.mp")).cache()
    first = sorted((r.level, len(r.points), r.points[0].lat) for r in got.collect() if r.fields.get("Label") == "Straße")
    assert first == [(0, 2, 1.0), (2, 2, 9.0), (10, 2, 5.0)]
    assert [len(r.points) for r in got.collect() if r.kind == "POLYGON"] == [4]
    assert sorted(len(r.points) for r in got.collect() if r.ordinal == 3) == [102, 250, 250]
    roads = osm.polish_roads(got)
    road = roads.where("road_id = 7").first()
    assert ([tuple(n) for n in road.nodes], road.road_class, road.road_speed, road.oneway, road.toll, road.denied) == ([(0, 11, False), (1, 12, True)], 2, 3, True, False, [1])
    assert [tuple(r)[1:] for r in osm.polish_restrictions(got, roads).collect()] == [(7, 11, 12, 13, 8)]


def test_heights(spark, tmp_path):
    side = 5
    grid = [[(r * 10 + c) if (r, c) != (2, 2) else -32768 for c in range(side)] for r in range(side)]
    (tmp_path / "N50E008.hgt").write_bytes(b"".join(struct.pack(">h", h) for row in grid for h in row))
    read = dispatch.read_heights(spark, str(tmp_path / "N50E008.hgt"))
    assert read.where("row = 0").first().heights == [40, 41, 42, 43, 44] and read.where("row = 2").first().heights[2] is None
    points = spark.createDataFrame([(1, 50.0, 8.0), (2, 50.125, 8.125), (3, 50.375, 8.375), (4, 10.0, 10.0)], "id int, lat double, lon double")
    got = {r.id: r.height for r in dispatch.heights_at(points, read).collect()}
    assert got == {1: 40, 2: 36, 3: 27, 4: 0}
    plane = F.array(*[F.array(*[F.lit(10 * i + j) for j in range(4)]) for i in range(4)])
    assert spark.range(1).select(dispatch.bicubic(plane, F.lit(0.5), F.lit(0.5))).first()[0] == 17
    assert sinks.height_samples(read, 2).count() == 8


def test_dispatch_and_made_up(spark):
    assert dispatch.bare_name("/x/A.OSM.GZ") == "a.osm"
    got = dispatch.read_map(spark, "test-map:4")
    assert got["nodes"].count() == 16 and got["ways"].count() == 4 and got["way_nodes"].where("way_id = 3").count() == 4


def test_boundary_files(spark, tmp_path):
    ring = lambda y, x: [{"lat": y, "lon": x}, {"lat": y + 15, "lon": x}, {"lat": y, "lon": x + 15}]
    df = spark.createDataFrame([(1, ring(0, 0)), (2, ring(100, 100))], "id int, ring array<struct<lat:int,lon:int>>")
    dispatch.partitioned_boundaries(df, str(tmp_path / "b"), 10)
    assert [r.id for r in dispatch.read_boundaries(spark, str(tmp_path / "b"), (0, 0, 9, 9), 10).collect()] == [1]
    assert dispatch.read_boundaries(spark, str(tmp_path / "b"), (0, 0, 110, 110), 10).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "tile int, name string")
    sinks.write_map({"features": df, "others": df.select("name")}, str(tmp_path / "m"), by=["tile"], sort={"features": ["name"]})
    assert spark.read.parquet(str(tmp_path / "m" / "features")).where("tile = 1").count() == 2
    assert "<trkpt lat=\"1.000000\"" in sinks.gpx([(1.0, 2.0)], "a<b") and "&lt;" in sinks.gpx([], "a<b")
    (tmp_path / "x.osm").write_text(sinks.osm_xml([(1, 1.0, 2.0)], [(5, [1, 1], {"a": 'q"<'})]))
    back = osm.read_xml(spark, str(tmp_path / "x.osm"))
    assert back["ways"].first().tags == {"a": 'q"<'} and back["way_nodes"].count() == 2


def test_sort_description(spark):
    described = sinks.parse_sort("codepage 1252\ncharacters\n=0008\n < a , A ; á , Á\n < b, B\nexpand æ to a b\n")
    assert described["codepage"] == 1252 and described["places"]["á"] == (described["places"]["a"][0], 2, 1)
    words = ["b", "A", "á", "a", "ab", "æ", "Á"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in df.orderBy(sinks.sort_bytes(F.col("w"), described), "w").collect()]
    assert got[:4] == ["a", "A", "á", "Á"] and got[-1] == "b" and set(got[4:6]) == {"ab", "æ"}
