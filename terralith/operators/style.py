"""Styles: folders of rule files, base styles, options, and the dispatch of elements to rules."""

from __future__ import annotations

import re
import zipfile
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import LEVELS, NAMESPACE, Both, Rule, RuleError, Test, overlaid, parse_rules, run_rules

#: Rule files of a style and the kind of their rules. Fixed values.
FILES = {"points": "point", "lines": "line", "polygons": "polygon", "relations": "relation"}


def style_files(location: str | dict[str, str]) -> dict[str, str]:
    """The files of a style by their paths: of a folder, a zip file, one file of ``<<<name>>>`` sections, or as given."""
    if isinstance(location, dict):
        return dict(location)
    path = Path(location)
    if path.is_dir():
        return {f.relative_to(path).as_posix(): f.read_text("utf-8") for f in sorted(path.rglob("*")) if f.is_file()}
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
            top = names[0].split("/")[0] + "/" if names and all("/" in n and n.split("/")[0] == names[0].split("/")[0] for n in names) else ""
            return {n.removeprefix(top): z.read(n).decode("utf-8") for n in names}
    parts = re.split(r"(?m)^<<<([^>]+)>>>[ \t]*\n", path.read_text("utf-8"))
    return dict(zip(parts[1::2], parts[2::2]))


def options_of(source: str) -> dict[str, str]:
    """``key = value`` or ``key: value`` lines; blank lines and comments are left out."""
    found = (re.match(r"\s*([\w.-]+)\s*[:=]\s*(.*?)\s*$", line.partition("#")[0]) for line in source.splitlines())
    return {m[1]: m[2] for m in found if m}


def levels_of(source: str) -> dict[int, int]:
    """Levels as ``0:24, 1:22``, or ``0=24``."""
    pairs = [re.split("[:=]", p) for p in re.split(r"[,\s]+", source.strip()) if p]
    out = {int(level): int(bits) for level, bits in pairs}
    if len(out) > 8 or any(not 0 <= level <= 16 or not 0 <= bits <= 24 for level, bits in out.items()):
        raise RuleError(f"levels {source} are out of range")
    return out


def overlays_of(source: str) -> dict[int, list[int]]:
    """``type: type type`` lines: what a line type is replaced by."""
    out = {}
    for line in source.splitlines():
        key, sign, rest = line.partition("#")[0].partition(":")
        if sign:
            try:
                out[int(key.strip(), 0)] = [int(n, 0) for n in re.split("[ ,\t]+", rest) if n]
            except ValueError:
                raise RuleError(f"{line} has no number") from None
    return out


@dataclass
class Style:
    """The rules of a style by kind, those of its base styles behind its own."""

    rules: dict[str, list[Rule]] = field(default_factory=lambda: {k: [] for k in FILES.values()})
    options: dict[str, str] = field(default_factory=dict)
    overlays: dict[int, list[int]] = field(default_factory=dict)
    levels: dict[int, int] = field(default_factory=lambda: dict(LEVELS))
    info: dict[str, str] = field(default_factory=dict)
    namespace: str = NAMESPACE

    @property
    def name_tags(self) -> list[str]:
        return [t for t in re.split(r"[,\s]+", self.options.get("name-tag-list", "")) if t]

    def way_rules(self) -> list[Rule]:
        """Lines, then polygons: which of them a way may match is told by ``by_lines()`` and ``by_polygons()``."""
        side = lambda rules, name: [replace(r, expression=Both("&", Test("=", name, "true"), r.expression)) for r in rules]
        return side(self.rules["line"], "by_lines()") + side(self.rules["polygon"], "by_polygons()")


def load_style(name: str, styles: dict[str, str | dict[str, str]], namespace: str = NAMESPACE, _open: tuple[str, ...] = ()) -> Style:
    """A style by its name; styles gives the location of each, for base styles and ``include .. from``.

    A style needs a ``version`` file. ``info`` names base styles, one a line: their options hold
    where the style has none of its own, their rules come after its own.
    """
    if name not in styles:
        raise RuleError(f"no style {name}")
    if name in _open:
        raise RuleError(f"style {name} is its own base")
    files = style_files(styles[name])
    if "version" not in files:
        raise RuleError(f"style {name} has no version file")
    info = options_of(files.get("info", ""))
    bases = re.findall(r"(?m)^\s*base-style\s*[:=]\s*(\S+)", files.get("info", ""))
    merged = [load_style(b, styles, namespace, (*_open, name)) for b in bases]
    out = Style(info=info, namespace=namespace)
    for b in merged:
        out.options |= b.options
    out.options |= options_of(files.get("options", ""))
    if "levels" in out.options:
        out.levels = levels_of(out.options["levels"])
    out.overlays = overlays_of(files.get("overlays", ""))

    def load(file: str, style: str | None) -> str:
        if style is not None and style not in styles:
            raise RuleError(f"no style {style}")
        of = style_files(styles[style]) if style is not None else files
        if file not in of:
            raise RuleError(f"no file {file} to include")
        return of[file]

    for file, kind in FILES.items():
        if file in files:
            out.rules[kind] = parse_rules(files[file], load, kind, out.levels, frozenset(out.overlays), namespace)[0]
    for b in reversed(merged):
        for kind, rules in b.rules.items():
            out.rules[kind] = out.rules[kind] + rules
    return out


def check_style(name: str, styles: dict[str, str | dict[str, str]]) -> list[str]:
    """What is wrong with a style; an empty list if nothing is."""
    try:
        style = load_style(name, styles)
    except RuleError as e:
        return [str(e)]
    out = []
    for kind, rules in style.rules.items():
        seen = set()
        for n, r in enumerate(rules):
            plain = repr(r.expression)
            if plain in seen and r.types:
                out.append(f"{kind} rule {n} never matches: an earlier one has the same predicate")
            if r.types and not r.types[0].goes_on:
                seen.add(plain)
    return out


def list_styles(styles: dict[str, str | dict[str, str]]) -> list[tuple[str, str, str]]:
    """(name, version, summary) of each style that has a version."""
    out = []
    for name in sorted(styles):
        files = style_files(styles[name])
        if "version" in files:
            out.append((name, files["version"].strip(), options_of(files.get("info", "")).get("summary", "")))
    return out


def with_name(tag_of, name_tags: list[str]):
    """tag_of whose name is that of the first tag of the list that the element has."""
    if not name_tags:
        return tag_of
    return lambda key: F.coalesce(*[tag_of(k) for k in name_tags], tag_of("name")) if key == "name" else tag_of(key)


def classify_ways(ways: DataFrame, style: Style, tag_of, closed: Column, n_points: Column, options: dict[str, str] | None = None, functions: dict[str, Column] | None = None) -> DataFrame:
    """The features of ways: ordinal, kind, type, labels, resolutions, road class and speed.

    The tag ``stylefilter`` of the namespace sends a way to the rules of lines or polygons alone;
    else an open way or one of under four points goes to the lines, any other one to both.
    """
    tag_of = with_name(tag_of, style.name_tags)
    only = F.coalesce(tag_of(f"{style.namespace}:stylefilter"), F.lit(""))
    open_ = ~F.coalesce(closed, F.lit(False)) | (n_points < 4)
    truth = lambda c: F.when(c, "true").otherwise("false")
    sides = {"by_lines()": truth(only != "polygon"), "by_polygons()": truth((only == "polygon") | ((only != "polyline") & ~open_))}
    out = run_rules(ways, style.way_rules(), tag_of, options, (functions or {}) | sides, style.namespace)
    out = out.select(*ways.columns, F.posexplode_outer("emitted").alias("ordinal", "e")).where("ordinal is not null").select(*ways.columns, "ordinal", "e.*")
    replaced = overlaid(out.where("kind = 'line'"), style.overlays)
    return replaced.unionByName(out.where("kind <> 'line'")) if style.overlays else out


#: Address fields of a feature and the tags of the namespace that they come from. Fixed values.
ADDRESS = {"country": "country", "region": "region", "city": "city", "zip": "postal_code", "street": "street", "house_number": "housenumber", "phone": "phone", "is_in": "is_in"}


def element_setup(features: DataFrame, tags: Column, namespace: str = NAMESPACE, highest_only: bool = False) -> DataFrame:
    """The final columns of a feature: address fields, skip_size_filter and the extended attributes.

    Extended attributes are the tags ``<namespace>:xt-*``, without that beginning, and
    ``seamark:*``; with highest_only the least resolution is the highest one.
    """
    own = f"{namespace}:xt-"
    keys = F.map_filter(tags, lambda k, v: k.startswith(own) | k.startswith("seamark:"))
    extended = F.transform_keys(keys, lambda k, v: F.when(k.startswith(own), F.substring(k, len(own) + 1, 1 << 30)).otherwise(k))
    get = lambda key: F.try_element_at(tags, F.lit(f"{namespace}:{key}"))
    out = features.withColumns({name: get(key) for name, key in ADDRESS.items()})
    out = out.withColumn("skip_size_filter", F.coalesce(get("skipSizeFilter").isin("yes", "true", "1"), F.lit(False))).withColumn("extended", extended)
    return out.withColumn("min_res", F.col("max_res")) if highest_only else out


def points_out(features: DataFrame, box: tuple[int, int, int, int], ref: Column, name: Column, order: list[str]) -> DataFrame:
    """Point features within (min_lat, min_lon, max_lat, max_lon): exits are told, and doubles are left out.

    Types 0x2000 to 0x27ff with a road number are exits. A feature is a double if the first one of
    its type and name, in the given order, is at the same place.
    """
    inside = F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3])
    found = features.where(inside).withColumn("is_exit", F.col("type").between(0x2000, 0x27FF) & ref.isNotNull()).withColumn("_name", name)
    place = F.struct(*order, F.struct("lat", "lon").alias("at"))
    first = found.groupBy("type", "_name").agg(F.min(place).alias("first"))
    out = found.join(first.select(F.col("type").alias("_type"), F.col("_name").alias("_first_name"), "first"), F.col("type").eqNullSafe(F.col("_type")) & F.col("_name").eqNullSafe(F.col("_first_name")))
    double = (F.struct("lat", "lon") == F.col("first.at")) & (F.struct(*order) != F.struct(*[F.col(f"first.{c}") for c in order]))
    return out.where(~double).drop("_name", "_type", "_first_name", "first")


def background(box: tuple[int, int, int, int], spark, transparent: bool = False) -> DataFrame:
    """The rectangle of a map as a polygon feature of type 0x4b; no row for a transparent map."""
    low_lat, low_lon, high_lat, high_lon = box
    ring = [(low_lat, low_lon), (high_lat, low_lon), (high_lat, high_lon), (low_lat, high_lon), (low_lat, low_lon)]
    return spark.createDataFrame([] if transparent else [(0x4B, ring)], "type int, points array<struct<lat:int,lon:int>>")
