"""Quality classifier: random Fourier features, ridge by normal equations, isotonic scores.

Each text becomes a vector of document statistics. Random Fourier features approximate a
Gaussian kernel over the standardised statistics; every partition sums its part of the
normal equations, one set for each fold of the labelled rows, the sums of a matrix row are
added by one task each, and the driver solves systems of ``features`` unknowns. For the
calibration each labelled row is scored by the weights of the other folds. These scores are
binned, pooled to a monotone sequence (pool adjacent violators) and joined by straight lines
from bin to bin, which turns raw scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, held_out, remainder_is_training, small_batches, stored

FEATURES, WIDTH, RIDGE, BINS, SEED, FOLDS = 256, 3.0, 1e-3, 1000, 11, 4
#: At most about so many labelled rows are learned from; beyond, a hash of doc_id picks them.
MAX_ROWS = 200_000
THRESHOLD = 0.5
N_STATS = 16

_LETTER, _UPPER, _DIGIT, _BLANK, _LINE, _MARK, _HIGH = range(7)
_CLASS = np.full(256, _MARK, dtype=np.uint8)
_CLASS[128:] = _HIGH
for _c in range(128):
    if chr(_c).islower():
        _CLASS[_c] = _LETTER
    elif chr(_c).isupper():
        _CLASS[_c] = _UPPER
    elif chr(_c).isdigit():
        _CLASS[_c] = _DIGIT
    elif chr(_c) in " \t\r\x0b\x0c":
        _CLASS[_c] = _BLANK
_CLASS[10] = _LINE
_PLAIN_MARKS = np.zeros(256, dtype=bool)
_PLAIN_MARKS[[ord(c) for c in ".,;:'\"?-()"]] = True


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text; those of an empty one are all 0."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(N_STATS)
    if not data:
        return out
    raw = np.frombuffer(data, dtype=np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    by_class = np.bincount(_CLASS, weights=by_byte, minlength=7)
    n = len(raw)
    words = data.split()
    n_words = max(1, len(words))
    distinct = len(set(words))
    lines = data.split(b"\n")
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    sentence_marks = by_byte[46] + by_byte[33] + by_byte[63]
    out[0] = np.log1p(len(words))
    out[1] = sizes.mean()
    out[2] = sizes.std()
    out[3] = by_class[_UPPER] / n
    out[4] = by_class[_DIGIT] / n
    out[5] = by_class[_MARK] / n
    out[6] = (by_class[_MARK] - by_byte[_PLAIN_MARKS].sum()) / n
    out[7] = distinct / n_words
    out[8] = len(set(lines)) / len(lines)
    out[9] = np.log1p(len(words) / len(lines))
    out[10] = np.log1p(sentence_marks) - np.log1p(len(words))
    out[11] = by_byte[ord("!")] / n_words
    out[12] = by_byte[ord("|")] / n_words
    out[13] = by_class[_HIGH] / n
    out[14] = np.log1p(sizes.max())
    out[15] = len(set(zip(words, words[1:]))) / n_words
    return out


def matrix(texts) -> np.ndarray:
    rows = [statistics(t if isinstance(t, str) else None) for t in texts]
    return np.array(rows).reshape(len(rows), N_STATS)


@dataclass
class Model:
    """Everything that scoring needs; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([f, np.ones((len(f), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0, 1)


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of least weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, y, fold, stats) of the labelled training rows, one label a document."""
    y = labels.select(col("doc_id").alias("doc_id"), col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    y = stored(y.where(remainder_is_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")), "labels")
    if (n := y.count()) > max_rows:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    texts = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text")).where("doc_id is not null").where(remainder_is_training(F.col("doc_id")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "fold": b["fold"], "stats": list(matrix(b["text"]))})

    # About max_rows rows of 16 bytes at most are broadcast, so that no text is shuffled.
    mine = texts.join(F.broadcast(y), "doc_id").select("doc_id", "text", "y", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(FOLDS)).alias("fold"))
    return stored(mine.mapInPandas(run, "doc_id long, y double, fold long, stats array<double>"), "labelled-statistics")


def _sums(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations of each fold, summed in each partition and then by matrix row."""
    size = len(model.phases) + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for fold, group in b.groupby("fold"):
                total = totals.setdefault(int(fold), np.zeros((size, size + 1)))
                f = model.features(np.array(group["stats"].tolist()))
                total[:, :size] += f.T @ f
                total[:, size] += f.T @ group["y"].to_numpy()
        for fold, total in totals.items():
            yield pd.DataFrame({"fold": fold, "i": np.arange(size), "sums": list(total)})

    def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [key[0]], "i": [key[1]], "sums": [np.sum(np.stack(group["sums"].to_list()), axis=0)]})

    schema = "fold long, i long, sums array<double>"
    whole = np.zeros((FOLDS, size, size + 1))
    for r in rows.mapInPandas(part, schema).groupBy("fold", "i").applyInPandas(added, schema).collect():
        whole[r["fold"], r["i"]] = r["sums"]
    return whole[:, :, :size], whole[:, :, size]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", features: int = FEATURES, max_rows: int = MAX_ROWS) -> Model:
    """Learns from labelled rows whose crc32(doc_id) mod 3 is not 1.

    Without any labelled row the model scores everything 0.5.
    """
    small_batches(docs.sparkSession)
    rows = _labelled(docs, labels, label, max_rows)
    rng = np.random.default_rng(SEED)
    moments = rows.agg(F.count(F.lit(1)), *[F.avg(F.col("stats")[i]) for i in range(N_STATS)], *[F.stddev_pop(F.col("stats")[i]) for i in range(N_STATS)]).first()
    n = moments[0]
    mean = np.array([m or 0.0 for m in moments[1 : 1 + N_STATS]])
    scale = np.array([s if s and s > 1e-9 else 1.0 for s in moments[1 + N_STATS :]])
    waves = rng.normal(size=(N_STATS, features)) / WIDTH
    model = Model(mean, scale, waves, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.full(1, 0.5))
    if not n:
        return model

    a, b = _sums(rows, model)
    solved = lambda a, b: np.linalg.solve(a + RIDGE * n * np.eye(len(a)), b)
    model.weights = solved(a.sum(axis=0), b.sum(axis=0))
    others = np.array([solved(a.sum(axis=0) - a[k], b.sum(axis=0) - b[k]) for k in range(FOLDS)])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = (model.features(np.array(batch["stats"].tolist())) * others[batch["fold"].to_numpy()]).sum(axis=1)
                bins = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
                yield pd.DataFrame({"bin": bins, "raw": raw, "y": batch["y"]})

    got = sorted(tuple(r) for r in rows.mapInPandas(binned, "bin long, raw double, y double").groupBy("bin").agg(F.avg("raw"), F.avg("y"), F.count(F.lit(1))).collect())
    model.edges = np.array([r[1] for r in got])
    model.values = pooled(np.array([r[2] for r in got]), np.array([r[3] for r in got], dtype=float))
    return model


def scorer(model: Model):
    """A column function: the score of a text, from the text alone."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(matrix(texts))) if len(texts) else pd.Series([], dtype=float)

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Defined cases: null and empty texts have the statistics 0 and are scored; a row without
    doc_id is scored, never learned from, and not held out; repeated rows get equal rows; of
    several labels of a document the largest counts; without labels all scores are 0.5; an
    empty table gives an empty result; further columns are ignored, whatever their names.
    """
    score = scorer(fit(docs, labels))
    out = docs.select(col("doc_id").alias("doc_id"), score(col("text")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    score = scorer(fit(docs, labels))
    return docs.where(score(col("text")) >= THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
