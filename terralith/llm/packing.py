"""Best-fit packing planned over a histogram of lengths.

Texts are tokenised once into pieces of at most ``max_len`` tokens. Only the count of
pieces of each length (at most ``max_len`` numbers) reaches the driver, where best-fit
decreasing runs over counts: bins with the same room are one class, so a whole run of equal
pieces is placed in one step. The plan is a list of runs (length, first rank, pieces per
bin, first bin, first offset); its size depends on max_len alone. Each piece then takes the
slot of its rank within its length, by a join with the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, small_batches, stored

MAX_LEN, END_ID = 4096, 1
#: Words kept in a worker's cache, and pieces that share one rank window on average.
CACHE_WORDS, RANK_ROWS = 250_000, 200_000

#: str.split() also splits at these, which the tokenizer does not take for white space.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Words whose normal form and lower case are plain: the other ones go to the tokenizer itself.
_PLAIN = re.compile("[\x21-\x7e\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u0148\u014a-\u017f]+")
#: The tokenizer's own split of a plain word: endings, letters, single digits, marks.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall


class FastWords:
    """The merges of a word-end BPE file, run by tiktoken's merge loop.

    The end of a word is one more byte, 0xff, that is joined to the last byte first of all;
    then merges follow in the file's order, as they do in the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, end = config["model"], config["model"]["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}

        def raw(token: str) -> bytes:
            word = token.removesuffix(end)
            return bytes(byte_of[c] for c in word) + b"\xff" * (word != token)

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(256)}
        for merge in model["merges"]:
            first, second = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault(raw(first + second), len(ranks))
        special = {t["content"] for t in config["added_tokens"]}
        self.id_of = {ranks[raw(t)]: i for t, i in model["vocab"].items() if t not in special}
        self.merged = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def ids(self, word: str) -> tuple[int, ...]:
        id_of, merged, word = self.id_of, self.merged, word.lower()
        if word.isalpha():
            return tuple([id_of[t] for t in merged(word.encode() + b"\xff")])
        return tuple([id_of[t] for piece in _PIECES(word) for t in merged(piece.encode() + b"\xff")])


class WordCache(dict):
    """Ids of a text from the ids of its blank-separated words; the dict is the cache.

    Right for tokenizers that drop white space and never join across it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), FastWords(path)
        self.older: dict[str, tuple[int, ...]] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: str) -> tuple[int, ...]:
        if (ids := self.older.get(word)) is None:
            ids = self.fast.ids(word) if _PLAIN.fullmatch(word) else tuple(self.whole(word))
        self[word] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        # Special tokens are looked for in the text as it is, blanks and all.
        if "<|" in text or _ODD_SPACE.search(text):
            return np.array(self.whole(text), dtype="<u4")
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        return np.fromiter(chain.from_iterable(map(self.__getitem__, text.split())), dtype="<u4")


def pieces_of(ids: np.ndarray, max_len: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the ids with the closing id."""
    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
    return [(i, at, len(part := ids[at : at + max_len]), zlib.crc32(part.tobytes())) for i, at in enumerate(range(0, len(ids), max_len))]


def tokenised(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all texts; a null text counts as empty."""
    if not 1 <= max_len:
        raise ValueError("max_len must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCache(tokenizer_path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for piece in pieces_of(cache.ids(text or ""), max_len):
                    out.append((int(doc_id) if doc_id is not None and doc_id == doc_id else None, *piece))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    small_batches(docs.sparkSession)
    own = docs.select(col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
    return own.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_runs(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs (length, first_rank, n_pieces, per_bin, first_bin, first_offset): the
    piece of rank first_rank + r goes to bin first_bin + r // per_bin, at offset
    first_offset + (r % per_bin) * length.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: [(first bin, bins)]
    bins = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, n: int, room: int) -> None:
            """Fills up to n bins with so much room, from the first."""
            nonlocal left, rank
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, full * per, per, first, max_len - room))
                rooms.setdefault(room - per * length, []).append((first, full))
                left, rank = left - full * per, rank + full * per
            if full < n and left:
                runs.append((length, rank, left, left, first + full, max_len - room))
                rooms.setdefault(room - left * length, []).append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                rooms.setdefault(room, []).append((first + full, n - full))

        for room in sorted(r for r in rooms if r >= length):
            if not left:
                break
            for first, n in rooms.pop(room):
                if left:
                    place(first, n, room)
                else:
                    rooms.setdefault(room, []).append((first, n))
        if left:
            n = -(-left // (max_len // length))
            first, bins = bins, bins + n
            place(first, n, max_len)
    return runs


def ranked(pieces: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``rank``, gapless from 0 within each value of ``by``.

    Rows of a value are dealt to hashed groups, whose sizes are summed to offsets, so that
    a value held by a third of the rows is ranked by many tasks.
    """
    groups = max(1, pieces.count() // RANK_ROWS + 1)
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64(*order), F.lit(groups)))
    sizes = dealt.groupBy(by, "deal").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(by).orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(by, "deal").orderBy(*order)) - 1
    out = dealt.withColumn("within", within).join(offsets, [by, "deal"])
    return out.withColumn("rank", F.col("before") + F.col("within")).drop("before", "within", "deal")


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN) -> DataFrame:
    """Packs the token pieces of all documents into sequences of at most max_len tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row a piece.

    Defined cases: a null or empty text is the closing id alone; a row without doc_id keeps
    a null doc_id and is packed; repeated rows are packed as often as they occur; ties in
    length are dealt by hash and take any slot of their length; an empty table gives an
    empty result; further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    pieces = stored(tokenised(docs, tokenizer_path, max_len), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "length long, first_rank long, n_pieces long, per_bin long, first_bin long, first_offset long"
    plan = spark.createDataFrame(plan_runs(counts, max_len), schema)
    slots = ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"])
    at = F.col("rank") - F.col("first_rank")
    mine = (slots["length"] == plan["length"]) & (at >= 0) & (at < F.col("n_pieces"))
    # The plan has a few runs for each length up to max_len, however many documents there are.
    out = slots.join(F.broadcast(plan), mine).drop(plan["length"])
    sequence = F.col("first_bin") + F.expr("(rank - first_rank) div per_bin")
    offset = F.col("first_offset") + (at % F.col("per_bin")) * F.col("length")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
