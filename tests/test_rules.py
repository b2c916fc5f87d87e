"""The rule language on small elements, and its errors."""

import pytest
from pyspark.sql import functions as F

from terralith.operators import kernels
from terralith.operators.rules import RuleError, classify, parse_rules
from terralith.sources.osm import parse_polish, parse_polygon


def run(spark, tags, source, **kw):
    df = spark.createDataFrame([(1, tags)], "id long, tags map<string,string>")
    out = classify(df, source, lambda k: F.col("tags")[k], **kw)
    return [(r["type"], *r["labels"]) for r in out.orderBy("ordinal").collect()]


@pytest.mark.parametrize(
    "tags, source, want",
    [
        ({"a": "b"}, "a=b [0x1] a=b [0x2]", [(1,)]),
        ({"a": "b"}, "a=b [0x1 continue] a=b [0x2]", [(1,), (2,)]),
        ({"a": "b", "k": "v"}, "k=v & a!=b [0x1]", []),
        ({"a": "b", "k": "v"}, "k=v & c!=b [0x1]", [(1,)]),
        ({"a": "x9", "k": "v"}, "k=v & !(a<10) [0x1]", []),
        ({"a": "x9"}, "a<10 [0x1]", [(1,)]),
        ({"a": "word", "k": "v"}, "k=v & (a<10 | !(a<10)) [0x1]", []),
        ({"k": "v"}, "k=* & !(a<10) [0x1]", [(1,)]),
        ({"a": "1.2.3"}, "a>0 [0x1]", []),
        ({"a": "b\n"}, "a~'b' [0x1]", []),
        ({"a": "b", "c": "b"}, "a=$c [0x1]", [(1,)]),
        ({"a": "b"}, "a=b {set a=c} a=b [0x1] a=c [0x2]", [(2,)]),
        ({"a": "b"}, "a=b {set a=c} [0x1 continue] a=c [0x2] a=b [0x3]", [(1,), (3,)]),
        ({"a": "b"}, "a=b {set a=c} [0x1 continue with_actions] a=c [0x2] a=b [0x3]", [(1,), (2,)]),
        ({"a": "b"}, "a=b {name '${x}' | '${a}-1'} [0x1]", [(1, "b-1")]),
        ({"a": "b"}, "a=b {addlabel x; addlabel x; addlabel y} [0x1]", [(1, "x", "y")]),
        ({"a": "b"}, "a=b {rename a c; delete z} c=b [0x1]", [(1,)]),
        ({"a": "b"}, "a=b {deletealltags} a=* [0x1]", []),
        ({"a": "b"}, "a=b {setaccess no} feature:bus=no [0x1]", [(1,)]),
        ({"a": "b", "feature:bus": "yes"}, "a=b {addaccess no} feature:bus=no [0x1] feature:taxi=no [0x2]", [(2,)]),
        ({"a": "b"}, "a=b {name x} [0x1][0x2]", [(1, "x"), (2,)]),
        ({"A": "1", "B": "1"}, "if (B=1) then A=1 {set B=0} C!=* {set C=1} end C=1 [0x1]", [(1,)]),
        ({"A": "1", "B": "1"}, "if (B=1) then () {set C=1} end C=1 [0x1]", [(1,)]),
        ({"A": "1", "B": "2"}, "if (B=1) then A=1 {set B=0} C!=* {set C=1} else A=1 [0x2] end C=1 [0x1]", [(2,)]),
        ({"a": "x", "b": "y"}, "if (a=x) then if (b=z) then a=* [0x1] else a=* [0x2] end end", [(2,)]),
        ({"h": "p"}, "h=p {set h=s} h=s {set h=t} [0x2 continue with_actions] h=t {set h=f} h=p [0x1] h=f [0x7]", [(2,), (7,)]),
        ({"h": "p"}, "h=p {set h=s} [0x2 with_actions continue] h=s [0x1] h=p [0x3]", [(2,), (3,)]),
        ({"C": "3", "E": "5"}, "(A=1 | B=2 | C=3 | D=4 | E=5) {set name='${name}b' | '${A} ${B}' | '${C}' | '${E}'} A=1 [0x1] E=5 [0x2] <finalize> name=* {name '${name}'}", [(2, "3")]),
        ({"s": "2", "u": "y"}, "(s=* | u=*) [0x1 continue]", [(1,)]),
        ({"m": "30", "f": "28"}, "$f < $m {set m='${f}'} m=28 [0x1]", [(1,)]),
        ({"t": "3", "u": "1"}, "u=* & t > u [0x1] t > $u [0x2]", [(2,)]),
        ({"n": "Doctor Who"}, """n=* {name '${n|subst:"^(Doctor|Dokter) ~>Dr "}'} [0x1]""", [(1, "Dr Who")]),
        ({"n": "x"}, """n=* {name '${n|prefix:box}'} [0x1]""", [(1, "\x05x")]),
        ({"n": "A;B;C"}, "n=* {name '${n|part:;<2}'; addlabel '${n|part:;>2}'; addlabel '${n|part:;<9}'} [0x1]", [(1, "A;", "C;")]),
        ({"n": "5 furlong", "m": "7"}, "n=* {name '${n|conv:m=>ft}'; addlabel '${m|conv:parsec=>ft}'} [0x1]", [(1, "5 furlong", "7")]),
        ({"n": "B 3;B 4"}, "n=* {name '${n|highway-symbol:box:4}'; addlabel '${n|highway-symbol:odd}'} [0x1]", [(1, "B 3;B 4", "[odd]B3/B4")]),
        ({"n": "Straße №5"}, "n=* {name '${n|ascii}'; addlabel '${n|latin1}'} [0x1]", [(1, "Strasse ?5", "Straße ?5")]),
        ({"c": "Germany", "d": "Atlantis"}, "c=* {name '${c|country-ISO}'; addlabel '${d|country-ISO}'} [0x1]", [(1, "DEU", "Atlantis")]),
        ({"a": "b"}, "a=b [0x1 default_name 'n'] <finalize> feature:default_name=n {addlabel d}", [(1, "d")]),
        ({"a": "b"}, "include=x [0x1] a=b [0x2]", [(2,)]),
        ({"a": "b"}, "a=b {name x} [0x1 continue] a=b {addlabel y} [0x2] <finalize> a=b {addlabel z}", [(1, "x", "z"), (2, "y", "z")]),
        ({"a": "b"}, "if (a=b) then a=b {set a=c} a=c [0x1] else a=* [0x2] end", [(1,)]),
        ({"a": "z"}, "if (a=b) then a=* [0x1] else a=* [0x2] end", [(2,)]),
        ({"a": "b"}, "a=b [0x1 default_name 'n']", [(1, "n")]),
        ({"a": "b"}, "a=b [0x1] <finalize> a=b {name f}", [(1, "f")]),
        ({"a": "p;q; r"}, "a=* {name '${a|part:;:-1}'} [0x1]", [(1, "r")]),
        ({"a": "b"}, "# comment\na=b [0x1 level 1-2] # more", [(1,)]),
    ],
)
def test_rules(spark, tags, source, want):
    assert run(spark, tags, source) == want


def test_include_and_options(spark):
    assert run(spark, {"a": "b"}, "include 'x'; a=b [0x2]", includes={"x": "a=b & feature:option:f=1 [0x1]"}, options={"f": "1"}) == [(1,)]
    two = {"x": "if (a=b) then a=b [0x1 continue] end", "y": "if (a=z) then a=b [0x2] end a=b [0x3]"}
    assert run(spark, {"a": "b"}, "include 'x'; include 'y';", includes=two) == [(1,), (3,)]
    assert run(spark, {"a": "b"}, "if (a=z) then include 'x'; end", includes={"x": "a=b [0x1]"}) == []
    assert run(spark, {"a": "b"}, "a=b [0x1] include 'x';", includes={"x": "<finalize> a=b {name f}"}) == [(1, "f")]
    with pytest.raises(RuleError):
        parse_rules("include 'x';", {"x": "include 'x';"})


def test_functions(spark):
    from terralith.functions.element import functions_of

    points = [{"lat": a, "lon": b, "node_id": n} for a, b, n in ((0, 0, 1), (0, 1000, 2), (1000, 1000, 3), (0, 0, 1))]
    df = spark.createDataFrame([(7, {"maxspeed": "30 mph", "a": "b"}, points, True)], "id long, tags map<string,string>, points array<struct<lat:int,lon:int,node_id:long>>, complete boolean")
    tag = lambda k: F.col("tags")[k]
    own = functions_of("way", tag, F.col("id"), F.col("points"), F.col("complete"))
    rules = "a=b & length()>8150 & length()<8160 [0x1 continue] a=b & is_closed()=true [0x2 continue] a=b & area_size()=500000.000 [0x3 continue] maxspeedkmh()=48.3 [0x4 continue] a=b & type()=way & osmid()=7 [0x5 continue] a=b & is_complete()=false [0x6]"
    got = classify(df, rules, tag, functions=own)
    assert [r.type for r in got.orderBy("ordinal").collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(RuleError):
        classify(df, "a=b & length()>1 [0x1]", tag)


def test_statistics_and_final_tags(spark):
    from terralith.operators.rules import run_rules, statistics

    df = spark.createDataFrame([(1, {"a": "b"}), (2, {"a": "c"})], "id long, tags map<string,string>")
    tag = lambda k: F.col("tags")[k]
    rules, _ = parse_rules("a=* {set x=1; set feature:execute_finalize_rules=true} a=b {set x=2} [0x1] a=c {set y=3} <finalize> x=1 {set z='${y}'}")
    assert [tuple(r) for r in statistics(df, rules, tag).orderBy("rule").collect()] == [(0, 2), (1, 1), (2, 1)]
    got = {r.id: r.tags_after for r in run_rules(df, rules, tag, with_tags=True).collect()}
    assert got[1] == {"a": "b", "x": "2", "feature:execute_finalize_rules": "true"} and got[2]["z"] == "3" and got[2]["y"] == "3"


def test_styles(spark, tmp_path):
    from terralith.operators import style

    base = {"version": "1", "options": "name-tag-list = name:en, name\nlevels = 0:24, 1:20", "lines": "a=b [0x1 level 1] a=c [0x2]", "inc/common": "a=d [0x5]"}
    own = {"version": "2", "info": "summary: mine\nbase-style: base", "lines": "a=c [0x3] include 'inc/common' from base;", "polygons": "a=* {name '${name}'} [0x4]", "overlays": "0x5: 0x6 0x7  # two"}
    for name, text in own.items():
        (tmp_path / name).write_text(text)
    styles = {"base": base, "mine": str(tmp_path), "bad": {"version": "1", "lines": "a!=b [0x1]"}, "double": {"version": "1", "lines": "a=b [0x1] a=b [0x2]"}}
    got = style.load_style("mine", styles)
    assert [r.types[0].code for r in got.rules["line"]] == [3, 5, 1, 2] and got.name_tags == ["name:en", "name"] and got.overlays == {5: [6, 7]}
    assert (got.rules["line"][2].types[0].min_res, got.levels) == (20, {0: 24, 1: 20})
    assert style.check_style("bad", styles) and len(style.check_style("mine", styles)) == 1 and len(style.check_style("double", styles)) == 1
    assert [n for n, *_ in style.list_styles(styles)] == ["bad", "base", "double", "mine"]
    with pytest.raises(RuleError):
        style.load_style("x", {"x": {"version": "1", "info": "base-style: x"}})
    rows = [(1, {"a": "d", "name": "n", "name:en": "e"}, True, 5), (2, {"a": "c"}, True, 3), (3, {"a": "q", "name": "n"}, True, 4), (4, {"a": "d", "feature:stylefilter": "polygon"}, False, 2)]
    ways = spark.createDataFrame(rows, "id long, tags map<string,string>, closed boolean, n int")
    out = style.classify_ways(ways, got, lambda k: F.col("tags")[k], F.col("closed"), F.col("n"))
    assert sorted((r.id, r.kind, r.type, *r.labels) for r in out.collect()) == [(1, "line", 6), (1, "line", 7), (2, "line", 3), (3, "polygon", 4, "n"), (4, "polygon", 4)]


@pytest.mark.parametrize("source", [
    "a [0x1]", "a=b {fly} [0x1]", "!a=b [0x1]", "if (a=b) then a=b [0x1]", "a= [0x1]", "a=b [0x1 strange]", "c!=b [0x1]", "a!=* [0x1]", "!(a<10) [0x1]", "a=b | c!=d [0x1]", "a=b [0x7f]",
    "length()>5 [0x1]", "a~$b [0x1]", "a=b {set c=d} [0x1][0x2]", "a=b {setaccess maybe}", "a=b {apply {set c=d}}", "a=b", "a=b && c=d [0x1]", "<finalize> a=b [0x1]", "a=b [0x1 road_class=9]", "a=b [0x1 level 9]",
])
def test_errors(source):
    with pytest.raises((RuleError, IndexError)):
        parse_rules(source)


def test_kernels():
    assert kernels.without_obsolete([(0, 0), (0, 0), (1, 1), (2, 2), (5, 0)]) == [(0, 0), (2, 2), (5, 0)]
    assert kernels.clipped_line((60, 70, 150, 230), [(20, 30), (160, 280)]) == [[(60, 101), (132, 230)]]
    assert kernels.clipped_line((0, 0, 10, 10), [(1, 1), (2, 2)]) == [[(1, 1), (2, 2)]]
    assert sorted(kernels.clipped_ring((0, 0, 10, 10), [(-5, -5), (-5, 15), (15, 15), (15, -5)])) == [(0, 0), (0, 10), (10, 0), (10, 10)]
    assert kernels.joined_rings([[1, 2], [3, 2], [3, 1]]) == [[1, 2, 3, 1]]
    assert kernels.contains([(0, 0), (0, 4), (4, 4), (4, 0)], (2, 2)) and not kernels.contains([(0, 0), (0, 4), (4, 4), (4, 0)], (5, 2))
    line = [(i, (i * i) % 7) for i in range(40)]
    thin = kernels.simplified(line, 3.0)
    assert thin[0] == line[0] and thin[-1] == line[-1] and len(thin) < len(line)


def test_text_formats():
    got = list(parse_polish("; c\n[POLYLINE]\nType=0x1\nData0=(1,2),(3.5,4)\n[END]\n[POI]\nLabel=x\n[END]\n"))
    assert [g["kind"] for g in got] == ["POLYLINE", "POI"] and got[0]["points"][1] == {"lat": 3.5, "lon": 4.0}
    assert parse_polygon("name\n1\n 1.0 2.0\n 3.0 4.0\nEND\n!2\n 5 6\nEND\nEND\n") == [(False, [(2.0, 1.0), (4.0, 3.0)]), (True, [(6.0, 5.0)])]


def test_xml_and_stream(spark, tmp_path):
    from terralith.sources.osm import read_xml
    from terralith.streaming.classify import classify_stream

    (tmp_path / "a.osm").write_text('<osm><node id="1" lat="1.5" lon="2"><tag k="a" v="b"/></node><node id="2" lat="1" lon="2"/><way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="x"/><tag k="name" v="n"/></way><relation id="9"><member type="way" ref="7" role="outer"/><tag k="type" v="m"/></relation></osm>')
    got = read_xml(spark, str(tmp_path / "a.osm"))
    assert [(r.id, r.tags) for r in got["nodes"].orderBy("id").collect()] == [(1, {"a": "b"}), (2, {})]
    assert [tuple(r) for r in got["way_nodes"].orderBy("pos").collect()] == [(7, 0, 1), (7, 1, 2)]
    assert got["ways"].first().tags == {"highway": "x", "name": "n"} and got["members"].first().role == "outer"

    spark.createDataFrame([(1, "x"), (2, "y")], "id long, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, kind string").parquet(str(tmp_path / "in"))
    out = classify_stream(stream, "kind=x [0x1] kind=* [0x2]", lambda k: F.col(k))
    query = out.writeStream.format("memory").queryName("features").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.id, r.type) for r in spark.table("features").collect()) == [(1, 1), (2, 2)]
