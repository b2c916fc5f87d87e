"""Stages between reading a map and classifying it, in a fixed order, and the options that steer them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame

Tables = dict[str, DataFrame]
#: The order in which stages run, whatever the order they were added in. Fixed values.
ORDER = ("sea", "multipolygon", "relation_style", "link_destination", "unused", "housenumber", "highway", "residential", "location", "poi", "other")


@dataclass
class Options:
    """What a run is told; names are those of the command line, with _ for -."""

    levels: str = "0:24, 1:22, 2:20, 3:18, 4:16"
    style: str = "default"
    style_option: dict[str, str] = field(default_factory=dict)
    name_tag_list: tuple[str, ...] = ("name",)
    delete_tags: tuple[tuple[str, str], ...] = ()
    ignore_fixme_values: bool = False
    add_pois_to_areas: bool = False
    add_pois_to_lines: bool = False
    housenumbers: bool = False
    location_autofill: tuple[str, ...] = ()
    order_by_decreasing_area: bool = False
    merge_lines: bool = False
    reduce_point_density: float = 2.6
    reduce_point_density_polygon: float = 8.0
    min_size_polygon: int = 8
    drive_on: str = "detect,right"
    split_name_index: bool = False
    transparent: bool = False
    other: dict[str, str] = field(default_factory=dict)


def _value(kind: str, text: str):
    if kind == "bool":
        return text.lower() not in ("no", "false", "0")
    if kind in ("int", "float"):
        return (int if kind == "int" else float)(text)
    if kind.startswith("dict"):
        return {k.strip(): v.strip() for k, _, v in (p.partition("=") for p in text.split(";") if p.strip())}
    if kind == "tuple[str, ...]":
        return tuple(x for x in re.split(r"[,\s]+", text) if x)
    return text


def parse_options(source: str | list[str], into: Options | None = None) -> Options:
    """Options from ``--name=value`` arguments or from the lines of a file: ``name=value``, ``name: value`` or a bare ``name``.

    ``no-name`` switches an option off. Names that are not known are kept in ``other``; a later value replaces an earlier one.
    """
    out = into or Options()
    kinds = {f.name: f.type for f in fields(Options)}
    items = source if isinstance(source, list) else [line.partition("#")[0].strip() for line in source.splitlines()]
    for item in items:
        item = item.strip().removeprefix("--")
        if not item:
            continue
        name, _, text = re.sub(r"\s*[:=]\s*", "=", item, count=1).partition("=")
        key = name.replace("-", "_")
        if key == "delete_tags_file":
            out.delete_tags = delete_tags(Path(text).read_text("utf-8"))
        elif key.startswith("no_") and key[3:] in kinds:
            setattr(out, key[3:], Options.__dataclass_fields__[key[3:]].default if kinds[key[3:]] != "bool" else False)
        elif key in kinds and key not in ("other", "delete_tags"):
            setattr(out, key, _value(kinds[key], text) if text or kinds[key] != "bool" else True)
        else:
            out.other[name] = text
    return out


def delete_tags(source: str) -> tuple[tuple[str, str], ...]:
    """The ``key=value`` and ``key=*`` lines of a file of tags to leave out at scan."""
    pairs = (line.partition("#")[0].strip().partition("=") for line in source.splitlines())
    return tuple((k.strip(), v.strip()) for k, sign, v in pairs if sign)


class Stages:
    """Functions from tables to tables, run in ORDER; each may replace or add tables."""

    def __init__(self):
        self.known: list[tuple[int, int, str, Callable[[Tables, Options], Tables], Callable[[Options], bool]]] = []

    def add(self, name: str, stage: Callable[[Tables, Options], Tables], wanted: Callable[[Options], bool] = lambda o: True) -> Stages:
        """Adds a stage; a name that ORDER lacks runs with the last ones. wanted tells from the options whether it runs."""
        place = ORDER.index(name) if name in ORDER else len(ORDER)
        self.known.append((place, len(self.known), name, stage, wanted))
        return self

    def run(self, tables: Tables, options: Options | None = None) -> Tables:
        options = options or Options()
        for _, _, _, stage, wanted in sorted(self.known, key=lambda s: s[:2]):
            if wanted(options):
                tables = tables | stage(tables, options)
        return tables


def chain(*filters: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Filters of features one after the other; each takes rows and gives none, one or many for each."""

    def run(features: DataFrame) -> DataFrame:
        for f in filters:
            features = features.transform(f)
        return features

    return run
