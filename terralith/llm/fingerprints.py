"""Document fingerprints from prefix polynomial hashes.

H(i) is the sum of c[j] * B**j for j < i, modulo two primes. With the prefix array of a
text any two spans are compared in constant time, and the longest common extension from two
places is found by binary search. A fingerprint keeps the hashes of the prefixes and of the
suffixes whose lengths are multiples of a step, the least power of two that gives at most
GRID of them; the steps of two texts divide one another, so the same binary search over the
common lengths gives the longest common beginning and end of two texts from their
fingerprints alone.

near_edited and near_next come from the prefix arrays of both texts, not from fingerprints:
the common beginning and end, and in between every common span that holds a block of SPAN
code points, wherever it is. Blocks are found by the hashes of all spans of that length and
drawn out by longest common extensions; after a mismatch the search goes on behind it.

For the document that follows each one, documents are dealt into ranges of doc_id, each
sorted by one task; the first document of a range is also sent to the range before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, small_batches

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525013)
GRID, CHUNK, RANGE_ROWS, MOST_RANGES = 32, 1 << 15, 4000, 20_000
#: Common spans of at least 2 * SPAN - 1 code points are found wherever they are.
SPAN = 32


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += step
    return out


_POWERS = [_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES)]
_INVERSES = [pow(b, -1, p) for b, p in zip(BASES, PRIMES)]
#: B**-i of the first modulus.
_SCALES = _powers(_INVERSES[0], PRIMES[0], CHUNK)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def prefix_hashes(code: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """H at the given places, sorted, for each prime; memory does not grow with the text."""
    out = [np.zeros(len(places), dtype=np.uint64) for _ in PRIMES]
    for k, (base, prime) in enumerate(zip(BASES, PRIMES)):
        p, before, lead = np.uint64(prime), 0, 1
        for at in range(0, len(code), CHUNK):
            part = code[at : at + CHUNK].astype(np.uint64) + np.uint64(1)
            sums = np.cumsum(part * _POWERS[k][: len(part)] % p)
            low, high = np.searchsorted(places, [at + 1, at + len(part) + 1])
            inside = sums[places[low:high] - at - 1] % p
            out[k][low:high] = (np.uint64(before) + inside * np.uint64(lead)) % p
            before = (before + int(sums[-1] % p) * lead) % prime
            lead = lead * pow(base, CHUNK, prime) % prime
    return out


class PrefixArray:
    """All prefix hashes of one text, for span equality and longest common extensions."""

    def __init__(self, text: str):
        self.n = len(code := code_points(text))
        self.h = [h.astype(np.uint32) for h in prefix_hashes(code, np.arange(self.n + 1))]

    def span(self, at: int, length: int) -> tuple[int, int]:
        """The hash of a span, the same wherever the span is."""
        return tuple((int(h[at + length]) - int(h[at])) * pow(i, at, p) % p for h, i, p in zip(self.h, _INVERSES, PRIMES))

    def same(self, at: int, other: PrefixArray, there: int, length: int) -> bool:
        return self.span(at, length) == other.span(there, length)

    def _longest(self, same, most: int) -> int:
        """The greatest length, most at most, for which same holds: doubled, then halved in."""
        low, high = 0, 1
        while high <= most and same(high):
            low, high = high, 2 * high
        high = min(high - 1, most)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(mid) else (low, mid - 1)
        return low

    def extension(self, at: int, other: PrefixArray, there: int) -> int:
        """The length of the longest common span from the two places."""
        return self._longest(lambda k: self.same(at, other, there, k), min(self.n - at, other.n - there))

    def extension_back(self, end: int, other: PrefixArray, there: int, most: int) -> int:
        """The length of the longest common span up to the two places, most at most."""
        return self._longest(lambda k: self.same(end - k, other, there - k, k), most)

    def spans(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
        """(place, first residues of the spans of SPAN code points from there on), in chunks.

        All spans lie within low and high; the residues are the same wherever a span is.
        """
        p, h = np.uint64(PRIMES[0]), self.h[0]
        for at in range(low, high - SPAN + 1, CHUNK):
            to = min(at + CHUNK, high - SPAN + 1)
            inner = (h[at + SPAN : to + SPAN].astype(np.uint64) + p - h[at:to]) * _SCALES[: to - at] % p
            yield at, inner * np.uint64(pow(_INVERSES[0], at, PRIMES[0])) % p


def shared_spans(a: PrefixArray, b: PrefixArray) -> int:
    """How many code points of the longer text are in spans that it shares with the other.

    The common beginning and end count at any length, spans in between if they hold a block
    of SPAN code points of the shorter text's middle, cut every SPAN; never more than the
    shorter text has.
    """
    if a.n > b.n:
        a, b = b, a
    front = a.extension(0, b, 0)
    back = a.extension_back(a.n, b, b.n, a.n - front)
    low, high_a, high_b, shared = front, a.n - back, b.n - back, front + back
    if high_a - low < SPAN:
        return shared
    blocks = np.concatenate([x[(low - at) % SPAN :: SPAN] for at, x in a.spans(low, high_a)])
    known, first = np.unique(blocks, return_index=True)
    done, diagonal = low, None
    for at, marks in b.spans(low, high_b):
        spot = np.minimum(np.searchsorted(known, marks), len(known) - 1)
        hits = np.flatnonzero(known[spot] == marks)
        k = int(np.searchsorted(hits, done - at))
        while k < len(hits):
            j = at + int(hits[k])
            i = low + int(first[spot[hits[k]]]) * SPAN
            # The diagonal of the span before goes first, so that an edit does not change it.
            if diagonal is not None and low <= j - diagonal <= high_a - SPAN and a.same(j - diagonal, b, j, SPAN):
                i = j - diagonal
            length = min(a.extension(i, b, j), high_a - i, high_b - j)
            if length >= SPAN:
                before = a.extension_back(i, b, j, min(i - low, j - done))
                shared, done, diagonal = shared + before + length, j + length, j - i
                k = int(np.searchsorted(hits, done - at))
            else:
                k += 1
    return min(shared, a.n)


def nearness(a: PrefixArray, b: PrefixArray) -> float:
    """The shared spans of two texts as a share of the longer one, 0 to 1."""
    return shared_spans(a, b) / max(a.n, b.n) if max(a.n, b.n) else 1.0


def step_of(n: int) -> int:
    return max(1, 1 << max(0, (n - 1) // GRID).bit_length())


def fingerprint(text: str) -> str:
    """n, the hash of the whole, those of the prefixes and those of the suffixes, in hex."""
    code = code_points(text)
    n = len(code)
    step = step_of(n)
    lengths = np.arange(step, n + 1, step)
    if not n:
        return "0:::"
    places = np.unique(np.concatenate([lengths, n - lengths, [n]]))
    hashes = prefix_hashes(code, places)
    fronts, backs, whole = np.zeros(len(lengths), dtype=np.uint64), np.zeros(len(lengths), dtype=np.uint64), ""
    for k, (h, base, prime) in enumerate(zip(hashes, BASES, PRIMES)):
        p = np.uint64(prime)
        front = h[np.searchsorted(places, lengths)]
        start = h[np.searchsorted(places, n - lengths)]
        # A suffix of length L starts at n - L: its hash times B**(L - n).
        lead, by, scale = pow(pow(base, -1, prime), n, prime), pow(base, step, prime), []
        for _ in lengths:
            lead = lead * by % prime
            scale.append(lead)
        back = (h[-1] + p - start) % p * np.array(scale, dtype=np.uint64) % p
        fronts ^= front << np.uint64(k)
        backs ^= back << np.uint64(k)
        whole += f"{int(h[-1]):08x}"
    text_of = lambda x: x.astype(">u4").tobytes().hex()
    return f"{n}:{whole}:{text_of(fronts)}:{text_of(backs)}"


def _common(a: str, b: str, step_a: int, step_b: int, most: int) -> int:
    """The greatest common length, a multiple of both steps, by binary search."""
    step = max(step_a, step_b)
    at = lambda s, own, k: s[(k * step // own - 1) * 8 : (k * step // own) * 8]
    low, high = 0, most // step
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if at(a, step_a, mid) == at(b, step_b, mid) else (low, mid - 1)
    return low * step


def likeness(a: str, b: str) -> float:
    """From fingerprints alone, on their grid: the common beginning and end of two texts as a
    share of the longer one, 0 to 1."""
    if a == b:
        return 1.0
    n_a, _, front_a, back_a = a.split(":")
    n_b, _, front_b, back_b = b.split(":")
    n, m = int(n_a), int(n_b)
    if not n or not m:
        return 0.0
    steps = step_of(n), step_of(m)
    shared = _common(front_a, front_b, *steps, min(n, m)) + _common(back_a, back_b, *steps, min(n, m))
    return min(shared, min(n, m)) / max(n, m)


def edited(text: str, following: str) -> str:
    """The last third of the text gives way to as much of the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, part, ahead): every document in its range of falling doc_id, and the
    first document of each range once more, as ahead, in the range before it."""
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    n = docs.count()
    parts = max(1, min(MOST_RANGES, n // RANGE_ROWS + 1))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    cuts = sorted({float(c) for c in cuts or []})
    # A missing doc_id comes last, with the smallest.
    rows = docs.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308))).withColumn("bucket", F.lit(0))
    if cuts:
        splits = [-float("inf"), *cuts, float("inf")]
        rows = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(rows.drop("bucket"))
    rows = rows.withColumn("part", F.lit(len(cuts)) - F.col("bucket").cast("int")).drop("place", "bucket")
    # At most MOST_RANGES rows come to the driver.
    firsts = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("first")).collect())
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    heads = spark.createDataFrame(before, "first long, before int")
    rows = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    here, there = F.struct("part", F.lit(False).alias("ahead")), F.struct(F.col("before").alias("part"), F.lit(True).alias("ahead"))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at"))
    return rows.select("doc_id", "text", "at.part", "at.ahead"), len(cuts) + 1


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the nearness of the text to the
    edited and to the next one.

    The edited text replaces the last floor(n_chars / 3) code points by the first as many, or
    all, of the next document in falling doc_id; after the last comes the first. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Defined cases: a null text counts as empty; the nearness of two empty texts is 1, of an
    empty and another one 0; rows without doc_id come last; repeated rows follow one another
    in the order of their texts; a single row is its own next one; an empty table gives an
    empty result; further columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (part, doc_id, text, fingerprint, prefix array) of the row that waits for its next one
        for batch in batches:
            out = []
            for part, doc_id, text, ahead in zip(batch["part"], batch["doc_id"], batch["text"], batch["ahead"]):
                mark = array = None
                if last is not None and last[0] == part:
                    mark = fingerprint(text)
                    changed = edited(last[2], text)
                    array = last[4] if text == last[2] else PrefixArray(text)
                    near_edited, near_next = nearness(last[4], PrefixArray(changed)), nearness(last[4], array)
                    out.append((last[1], len(last[2]), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), last[3], fingerprint(changed), near_edited, near_next))
                if ahead:
                    last = None if last is None or last[0] == part else last
                else:
                    last = (part, doc_id if doc_id is not None and doc_id == doc_id else None, text, mark or fingerprint(text), array or PrefixArray(text))
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    small_batches(docs.sparkSession)
    own = docs.select(col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
    rows, parts = _ranges(own)
    dealt = rows.repartitionById(parts, F.col("part"))
    dealt = dealt.sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
