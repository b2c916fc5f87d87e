"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel distance.

An item of n characters may be matched with up to e = floor(error_rate * n) edits. It is
split into e + 1 pieces; by the pigeonhole principle a passage within e edits holds at least
one piece unchanged. Piece hits are found by the first eight characters of every place of a
text at once. The stretch around a hit is then verified by Myers' bit-parallel search, first
for the hit piece with its neighbour, then for twice as many pieces and so on up to the whole
item: j adjacent pieces may hold j - 1 edits, by the same principle, so nothing is lost.
Items under MIN_CHARS characters may have no edits: they are one piece, found as they are
between word bounds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, small_batches, stored

ERROR_RATE = 0.1
#: Items shorter than this (after folding) are searched for without edits, at word bounds.
MIN_CHARS = 40
#: Characters of benchmark items that one pass over the texts carries; more items take more passes.
BLOCK_CHARS = 4_000_000

#: Every piece of an item with edits has at least so many characters, as MIN_CHARS and ERROR_RATE are now.
PREFIX = 8
_TABLE_BITS, _MIX = 22, np.uint64(0x9E3779B97F4A7C15)


def folded(text: str | None) -> str:
    """A-Z in lower case, runs of blanks as one space, none at the ends."""
    return b" ".join(text.encode("utf-8", "replace").lower().split()).decode() if isinstance(text, str) else ""


def prefixes(text: str) -> np.ndarray:
    """One number for the eight characters from each place; equal for equal characters."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if len(code) < PREFIX:
        return np.zeros(0, dtype=np.uint64)
    # One byte a character, so the low k bytes stand for the first k characters.
    one = (code ^ (code >> 7)).astype(np.uint8).astype(np.uint16)
    two = one[:-1] | (one[1:] << 8)
    two = two.astype(np.uint32)
    four = (two[:-2] | (two[2:] << 16)).astype(np.uint64)
    return four[:-4] | (four[4:] << np.uint64(32))


def spread(numbers: np.ndarray) -> np.ndarray:
    return ((numbers * _MIX) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def at_word_bounds(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit goes on beyond either end of the passage."""
    before = start == 0 or not (text[start].isalnum() and text[start - 1].isalnum())
    return before and (end == len(text) or not (text[end - 1].isalnum() and text[end].isalnum()))


def cut(item: str, error_rate: float) -> list[tuple[int, str]]:
    """(offset, piece) of the e + 1 pieces, which differ in length by one at most."""
    n = int(len(item) * error_rate) + 1
    bounds = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(item_masks: dict[str, int], n: int, text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of the item to any part of text, and the end of the first
    such part; None if it is over ``most``."""
    ones, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = ones, 0, n
    best, end = most + 1, 0
    get = item_masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        mh <<= 1
        plus = (mh | ~(xv | ph)) & ones
        minus = ph & xv & ones
        if score < best:
            best, end = score, i + 1
            if not best:
                break
    return (best, end) if best <= most else None


class Part:
    """Some adjacent pieces of an item, and the larger part that they belong to."""

    __slots__ = ("at", "n", "most", "masks", "above", "halves")

    def __init__(self, item: str, pieces: list[tuple[int, str]], above: Part | None):
        self.at, self.n, self.most, self.above = pieces[0][0], sum(len(p) for _, p in pieces), len(pieces) - 1, above
        self.masks = masks(item[self.at : self.at + self.n])
        self.halves = [h for _, p in pieces for h in (p[: len(p) // 2], p[len(p) // 2 :])] if len(pieces) <= 4 else []

    def may_match(self, window: str) -> bool:
        """Of 2j halves, j - 1 edits leave at least j + 1 unchanged."""
        return not self.halves or sum(h in window for h in self.halves) >= self.most + 2

    def match(self, text: str, start: int) -> tuple[int, int] | None:
        """Distance and end of the best match near the place where the item would start."""
        low = max(0, start + self.at - self.most)
        window = text[low : max(0, start + self.at + self.n + self.most)]
        found = best_match(self.masks, self.n, window, self.most) if self.may_match(window) else None
        return (found[0], low + found[1]) if found else None


class Matcher:
    """The pieces of a block of items, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = items
        self.pieces: dict[int, list[tuple[str, int, int, Part | None]]] = defaultdict(list)
        #: Items without edits: by the length of their prefix, then by its number.
        self.short: dict[int, dict[int, list[tuple[str, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, text) in enumerate(items):
            if len(text) < MIN_CHARS:
                size = min(len(text), PREFIX)
                self.short[size][int(prefixes(text[:size].ljust(PREFIX, "\0"))[0])].append((text, k))
            else:
                self._split(k, text, cut(text, error_rate), None)
        self.table = self._table(self.pieces)
        self.short_tables = {size: self._table(numbers) for size, numbers in self.short.items()}

    @staticmethod
    def _table(numbers: dict) -> np.ndarray:
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[spread(np.array(list(numbers), dtype=np.uint64))] = True
        return table

    def _split(self, k: int, text: str, pieces: list[tuple[int, str]], above: Part | None) -> None:
        """A binary tree over the pieces, whose leaves know the part above them."""
        if len(pieces) == 1:
            at, piece = pieces[0]
            if len(piece) < PREFIX:
                raise ValueError(f"a piece has fewer than {PREFIX} characters: the error rate is too high")
            self.pieces[int(prefixes(piece[:PREFIX])[0])].append((piece, at, k, above))
            return
        part = Part(text, pieces, above)
        half = len(pieces) // 2
        self._split(k, text, pieces[:half], part)
        self._split(k, text, pieces[half:], part)

    def found(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the folded text) of each item that the text holds."""
        text = folded(text)
        if not text or not self.items:
            return []
        numbers = prefixes(text)
        places = np.flatnonzero(self.table[spread(numbers)])
        best: dict[int, tuple[int, int]] = self._found_short(text) if self.short else {}
        known: dict[tuple[int, int], tuple[int, int] | None] = {}
        for at, number in zip(places.tolist(), numbers[places].tolist()):
            for piece, offset, k, part in self.pieces.get(number, ()):
                if not text.startswith(piece, at) or best.get(k, (1,))[0] == 0:
                    continue
                start = at - offset
                hit: tuple[int, int] | None = (0, at + len(piece))
                while part is not None and hit is not None:
                    if (key := (id(part), start)) not in known:
                        known[key] = part.match(text, start)
                    hit, part = known[key], part.above
                if hit is not None and hit < best.get(k, (1 << 60, 0)):
                    best[k] = hit
        return sorted((self.items[k][0], d, end) for k, (d, end) in best.items())

    def _found_short(self, text: str) -> dict[int, tuple[int, int]]:
        """Distance 0 and the first end of each item without edits."""
        best: dict[int, tuple[int, int]] = {}
        numbers = prefixes(text + "\0" * (PREFIX - 1))
        for size, by_number in self.short.items():
            own = numbers & np.uint64((1 << 8 * size) - 1)
            places = np.flatnonzero(self.short_tables[size][spread(own)])
            for at, number in zip(places.tolist(), own[places].tolist()):
                for item, k in by_number.get(number, ()):
                    if k not in best and text.startswith(item, at) and at_word_bounds(text, at, at + len(item)):
                        best[k] = (0, at + len(item))
        return best


def blocks(benchmark: DataFrame, error_rate: float, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The folded items in blocks of bounded size, read one after the other."""
    block, size = [], 0
    for r in benchmark.select(col("item_id").alias("item_id"), col("text").alias("text")).where("item_id is not null and text is not null").toLocalIterator():
        text = folded(r["text"])
        if not text:
            continue
        block.append((r["item_id"], text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    yield block


def searcher(items: list[tuple[int, str]], error_rate: float):
    """A column function: the matches of a text with a block of items."""

    @F.pandas_udf("array<struct<item_id:long,distance:int,end:long>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items, error_rate)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": d, "end": e} for i, d, e in matcher.found(t)] for t in texts], dtype=object)

    return search


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, match_end) of each document and item that it holds.

    distance is the least number of edits, match_end the place in the folded text where the
    first such passage ends. Case of A-Z and runs of blanks make no difference.

    Items under MIN_CHARS characters are held without any edit only, and between word bounds:
    no letter or digit goes on beyond their own first or last one.

    Defined cases: null and empty texts hold nothing; items that are null, blank or without
    item_id are not searched for; a row without doc_id is searched and
    keeps a null doc_id; repeated rows and repeated items give repeated rows; empty tables
    give an empty result; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    own = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    found = None
    for block in blocks(benchmark, error_rate, block_chars):
        if found is not None and not block:
            break
        part = own.select("doc_id", F.explode(searcher(block, error_rate)("text")).alias("m")).select("doc_id", "m.item_id", "m.distance", F.col("m.end").alias("match_end"))
        # A block's matches are written before the next block is read, so the driver has one block at a time.
        found = part if found is None else stored(found, "leaks").unionByName(stored(part, "leaks"))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    small_batches(docs.sparkSession)
    first = True
    for block in blocks(benchmark, error_rate, block_chars):
        if block:
            docs = docs if first else stored(docs, "clean")
            docs, first = docs.where(F.size(searcher(block, error_rate)(col("text"))) == 0), False
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
