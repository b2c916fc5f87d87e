"""Toxicity: a sparse logistic classifier held steady under swaps of identity terms.

Features are the distinct lower-case words of a text and their first letters, hashed. For each labelled text that
names an identity term, counterfactuals are made by swapping each such term for others of
its kind; the loss adds ``steady`` times the squared change of the logit between the text and
each of them, which takes weight off the terms themselves. An L1 penalty (proximal gradient steps), lighter
on words of strong evidence, keeps only words that matter, so long texts gather no score from their many neutral words.
Evidence is counted over the labelled rows by Spark; only features that have some reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, held_out, remainder_is_training, small_batches, stored

BITS, STEADY, SPARSE, STEPS, LEAST_EVIDENCE = 20, 4.0, 1e-4, 600, 4.0
#: About so many labelled rows are learned from at most; a hash of doc_id picks them.
MAX_ROWS = 12_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
#: Counterfactuals of a text at most: the k-th swaps each term for the k-th after it in its kind.
SWAPS = 2

#: Kinds of identity terms in English, German, French and Spanish; a swap stays within a kind. Fixed values.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("immigrants", "refugees", "citizens", "foreigners", "natives"),
    ("immigrant", "refugee", "citizen", "foreigner", "native"),
    ("african", "asian", "european", "american", "arab", "latino"),
    ("elderly", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwul", "lesbisch", "hetero", "bisexuell"),
    ("einwanderer", "flüchtlinge", "bürger", "ausländer"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "citoyens", "étrangers"),
    ("africain", "asiatique", "européen", "américain", "arabe"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
    ("africano", "asiático", "europeo", "americano", "árabe"),
)

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if isinstance(text, str) else set()


def buckets(word: str) -> list[int]:
    """Of the word and of its beginnings, so that inflected and joined forms share evidence."""
    keys = [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [crc32(k.encode("utf-8", "replace")) & ((1 << BITS) - 1) for k in keys]


def row(found: set[str]) -> np.ndarray:
    return np.array(sorted({b for w in found for b in buckets(w)}), dtype=np.int32)


class Swaps:
    """The counterfactuals of sets of words, by kinds of terms."""

    def __init__(self, kinds: Sequence[Sequence[str]], most: int = SWAPS):
        self.maps: list[dict[str, str]] = [{} for _ in range(most)]
        for kind in kinds:
            for k in range(min(most, len(kind) - 1)):
                for i, term in enumerate(kind):
                    self.maps[k].setdefault(term, kind[(i + k + 1) % len(kind)])

    def of(self, found: set[str]) -> list[set[str]]:
        return [{m.get(w, w) for w in found} for m in self.maps if found & m.keys()]


class Rows:
    """Sparse 0/1 rows over numbered features."""

    def __init__(self, rows: list, width: int):
        self.at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.cols = np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(r, dtype=np.int64) for r in rows)])
        self.n, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=w[self.cols], minlength=self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=v[self.at], minlength=self.width)


def train(rows: list, others: list[list], y: np.ndarray, strength: np.ndarray, steady: float = STEADY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias; others[i] has the counterfactuals of rows[i].

    strength is a feature's evidence: how many standard errors apart its shares in the
    classes are. The L1 penalty of a feature falls with the square of it.
    """
    if not len(y):
        return np.zeros(len(strength)), 0.0
    pos, total = float(y.sum()), float(len(y))
    bias = float(np.log((pos + 0.5) / (total - pos + 0.5)))
    penalty = SPARSE * (LEAST_EVIDENCE / strength) ** 2
    pairs = [(i, other, 1 / len(mine)) for i, mine in enumerate(others) for other in mine]
    x = Rows(rows, len(strength))
    own, swapped = Rows([rows[i] for i, _, _ in pairs], len(strength)), Rows([other for _, other, _ in pairs], len(strength))
    share = np.array([s for _, _, s in pairs])
    w = np.zeros(len(strength))
    g2, gb2 = np.full(len(strength), 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + bias, -30, 30)))
        g = (p - y) / total
        grad = x.back(g)
        if len(pairs):
            change = (own.times(w) - swapped.times(w)) * share * 2 * steady / total
            grad = grad + own.back(change) - swapped.back(change)
        g2 += grad * grad
        rate = 0.5 / np.sqrt(g2)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        gb = g.sum()
        gb2 += gb * gb
        bias -= 0.5 * gb / np.sqrt(gb2)
    return w, float(bias)


class Model:
    """The words' weights (at most 2**BITS of them, whatever the input) and the bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts, known: dict[str, tuple[int, ...]]) -> list[float]:
        """Scores of whole texts; known caches the weighted buckets of words."""
        out = []
        for text in texts:
            found: set[int] = set()
            for w in words(text):
                if (mine := known.get(w)) is None:
                    if len(known) > 300_000:
                        known.clear()
                    mine = known[w] = tuple(b for b in buckets(w) if b in self.weights)
                if mine:
                    found.update(mine)
            logit = self.bias + sum(self.weights[b] for b in sorted(found))
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))))
        return out


def evidence(rows: DataFrame) -> dict[int, float]:
    """The features whose shares in the classes differ by LEAST_EVIDENCE standard errors, and by how many they do.

    rows has y and own; there are at most 2**BITS features.
    """
    counts = rows.select((F.col("y") > 0).alias("toxic"), F.explode("own").alias("bucket"))
    counts = counts.groupBy("bucket").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    n = rows.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    a, b = max(1, n[0]), max(1, n[1])
    p = (F.col("a") + F.col("b") + 1) / (a + b + 2)
    apart = F.abs(F.col("a") / a - F.col("b") / b) / F.sqrt(p * (1 - p) * (1 / a + 1 / b))
    return {r["bucket"]: r["strength"] for r in counts.select("bucket", apart.alias("strength")).where(F.col("strength") >= LEAST_EVIDENCE).collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, kinds: Sequence[Sequence[str]] = IDENTITY_TERMS, steady: float = STEADY) -> Model:
    """Learns from labelled rows whose crc32(doc_id) mod 3 is not 1."""
    small_batches(docs.sparkSession)
    y = labels.select(col("doc_id").alias("doc_id"), col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    y = stored(y.where(remainder_is_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")), "labels")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    y = y.where(share < math.ceil(min(1.0, 0.95 * max_rows / max(y.count(), 1)) * (1 << 20)))
    texts = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text")).where(remainder_is_training(F.col("doc_id")))
    swaps = Swaps(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [words(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "own": [row(f) for f in found], "others": [[row(o) for o in swaps.of(f)] for f in found]})

    # About max_rows rows of 16 bytes at most are broadcast, so that no text is shuffled.
    got = texts.join(F.broadcast(y), "doc_id").select("doc_id", "text", "y").mapInPandas(run, "doc_id long, y double, own array<int>, others array<array<int>>")
    rows = stored(got, "toxic-words")
    strength = evidence(rows)
    kept = np.array(sorted(strength), dtype=np.int64)

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(1 << BITS, -1)
        place[kept] = np.arange(len(kept))

        def mine(buckets_: np.ndarray) -> np.ndarray:
            c = place[np.asarray(buckets_, dtype=np.int64)]
            return c[c >= 0].astype(np.int32)

        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "own": [mine(r) for r in batch["own"]], "others": [[mine(o) for o in side] for side in batch["others"]]})

    # Of each row the features with evidence alone; doc_id gives the order, so that sums come out alike.
    table = rows.mapInPandas(known, rows.schema).orderBy(F.xxhash64("doc_id"), "doc_id", F.size("own")).toArrow()
    own = [r.values.to_numpy() for r in table["own"]]
    others = [[o for o in (np.asarray(v, dtype=np.int64) for v in r.as_py()) if not np.array_equal(o, mine)] for r, mine in zip(table["others"], own)]
    weights, bias = train(own, others, table["y"].to_numpy(), np.array([strength[k] for k in kept.tolist()]), steady)
    return Model({int(kept[i]): float(weights[i]) for i in np.flatnonzero(weights)}, bias)


def scorer(model: Model):
    """A column function: the score of a text, from the text alone."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            yield pd.Series(model.scores(texts, known), dtype=float)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Defined cases: null and empty texts have no words and get the score of the bias alone; a
    row without doc_id is scored, never learned from, and not held out; repeated rows get
    equal rows; of several labels of a document the largest counts; without labels all
    scores are 0.5; an empty table gives an empty result; further columns are ignored. Options
    are those of ``fit``: the kinds of identity terms, the weight of the swaps, the row bound.
    """
    score = scorer(fit(docs, labels, **options))
    out = docs.select(col("doc_id").alias("doc_id"), score(col("text")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
