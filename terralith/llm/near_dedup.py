"""Near duplicates by an inverted join over the coordinates of MinHash signatures.

1. Rows with equal sets of five-word shingles are one class, named by its least doc_id (by a
   hash where rows of one doc_id have different texts, which would share that name).
2. Each class is posted under every (coordinate, value) of its signature. Values that only
   one class has are skipped; a class with fewer than MATCHES shared values can reach no
   other and is left out at once. Of the m shared values of a class, ordered from rare to
   common, only the first m - MATCHES + 1 are merged: two classes that agree on MATCHES
   coordinates must meet in that prefix, so very common values are hardly ever merged.
3. Each posting list is split by set size and first merged with its most central class alone, so a group of n near
   copies costs n pairs, not n * n / 2. Pairs that agree on MATCHES coordinates are confirmed
   on their full shingle sets, and confirmed links are closed to components.
4. Lists whose classes are then all in one component are done. The classes of the others are
   compared across components by an exact prefix filter on their differences from the list's
   most central class (on the sets themselves where a class is unlike it), so that no link
   between different components is lost; the components are closed again. Copies with edits
   of their own share most of their text, but little of what was edited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, col, marks_of, may_be_in, packed, small_batches, stored, unpacked

WORDS, SIMILAR = 5, 75
#: Coordinates, and how many must agree. A pair at the bound agrees on 48 of 64 on average;
#: the odds that it agrees on fewer than 30 are below one in a million.
COORDINATES, MATCHES = 64, 30
CACHE_WORDS = 300_000

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2)
_MULTIPLY = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of shingle hashes, sorted; the hashes of words are cached."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def set_of(self, text: str | None) -> np.ndarray:
        # bytes.lower() and bytes.split() know ASCII alone: A-Z, and blank 0x20 and 0x09-0x0D.
        words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(set(words))
        for w in new:
            known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(WORDS, len(hashes))
        total = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            total = mixed(total * _STEP + hashes[i : len(hashes) - n + 1 + i])
        return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's order over the set."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = (shingles[at : at + 4096, None] ^ _XOR) * _MULTIPLY
        np.minimum(out, part.min(axis=0), out=out)
    return mixed(out + np.arange(COORDINATES, dtype=np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, f1, f2, keys) of each row with a doc_id.

    f1 and f2 are 128 bits of hash of the set; keys are the posting keys, one a coordinate.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.set_of(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "text_hash": batch["text_hash"],
                    "n_shingles": [len(s) for s in sets],
                    "f1": _signed(np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)),
                    "f2": _signed(np.array([mixed(s ^ _STEP).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)),
                    "keys": [_signed(signature(s)) if len(s) else np.zeros(0, dtype=np.int64) for s in sets],
                }
            )

    own = docs.where("doc_id is not null").select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    return own.mapInPandas(run, "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, keys array<long>")


def text_hash(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.lit(3), text)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of (node, text): the sorted set as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingler.set_of(t).tobytes() for t in batch["text"]]})

    return docs.mapInPandas(run, "node long, shingles binary")


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether 100 * intersection >= SIMILAR * union for two sorted sets."""

    def one(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        if not len(p) or not len(q):
            return False
        both = np.concatenate([p, q])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= SIMILAR * (len(p) + len(q) - common)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, matches: int = 0) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; nodes has node, n and keys.

    Sizes are compared first, and signatures if a number of matches is asked for. A set travels
    with each of its pairs, but sizes of a pair differ by a third at most, so no long set is
    dealt out to many short ones.
    """
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), *([F.col("keys").alias(f"keys_{name}")] if matches else []))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where((100 * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b")))
    if matches:
        agree = F.size(F.filter(F.zip_with("keys_a", "keys_b", lambda x, y: x == y), lambda same: same))
        both = both.where(agree >= matches)
    both = both.select("a", "b")
    of = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))
    return both.join(of("a"), "a").join(of("b"), "b").where(_alike("set_a", "set_b")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b): the least node that can be reached.

    Each round takes the least label among the neighbours, then jumps to the label's label.
    Every round is written to the shared folder.
    """
    both = stored(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        near = labels.join(around, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = stored(near.join(jump, "next").select("node", F.least("next", "far").alias("label"), "was"), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels


def _postings(nodes: DataFrame, matches: int) -> DataFrame:
    """(key, node, weight): the prefix of each class's shared values, from rare to common.

    weight is the number of values that the class shares; the most central class of a group
    of copies, from which the others were made, shares the most.
    """
    posted = nodes.select("node", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = posted.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("mine"))  # 64 at most
    mine = mine.where(F.size("mine") >= matches)
    prefix = F.slice("mine", 1, F.size("mine") - matches + 1)
    return mine.select("node", F.size("mine").alias("weight"), F.explode(prefix).alias("p")).select("p.key", "node", "weight")


def _banded(postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, band, node, weight): posting lists split by set size, each class in two neighbouring bands.

    A band is a little wider than the ratio of the sizes of similar sets, so two such are at most
    one band apart and share a list; a list has a centre of about its members' size.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(101 / SIMILAR)).cast("int")
    sized = postings.join(nodes.select("node", band.alias("low")), "node")
    return sized.select("key", F.explode(F.array("low", F.col("low") + 1)).alias("band"), "node", "weight")


@F.pandas_udf(T.BinaryType())
def _difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """The shingles that just one of two sorted sets has; null if the sets are less than half alike."""

    def one(x: bytes, y: bytes) -> bytes | None:
        both = np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])
        both.sort()
        again = both[1:] == both[:-1]
        common = int(again.sum())
        if 2 * common < len(both) - common:
            return None
        return both[~(np.append(again, False) | np.append(False, again))].tobytes()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)


def _exploded(sets: DataFrame) -> DataFrame:
    """One row a shingle of (centre, node, label, n, base, far, shingles); size is the number of shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of = [np.frombuffer(data, dtype=np.int64) for data in batch["shingles"]]
            size = np.array([len(s) for s in of], dtype=np.int64)
            out = batch.drop(columns="shingles").assign(size=size)
            out = out.loc[out.index.repeat(size)]
            yield out.assign(shingle=np.concatenate([np.zeros(0, dtype=np.int64), *of]))

    own = sets.select("centre", "node", "label", "n", "base", "far", "shingles")
    return own.mapInPandas(run, "centre long, node long, label long, n long, base long, far boolean, size long, shingle long")


def _meet(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of one centre and different labels that may be similar, by an exact prefix filter.

    shingles is the difference D of a node's set from the centre's, base the centre's size.
    Similar sets of n and m shingles differ in (n + m) / 7 at most (for a bound of 0.75), so the
    differences of two such share t = (|D| + |E| - (n + m) / 7) / 2 shingles, and meet within
    the first |D| - t + 1 and |E| - t + 1 in an order from rare to common. The set with the
    smaller difference needs the shorter prefix: just that is joined with the longer ones.
    Two sets both similar to the centre have one label, which shortens the prefixes of these.
    """
    apart, total = 100 - SIMILAR, 100 + SIMILAR
    each = stored(_exploded(sets), "open-shingles")
    # Shingles within one label, single ones among them, can join nothing; they come first in the order.
    common = each.groupBy("centre", "shingle").agg(F.count(F.lit(1)).alias("df"), (F.min("label") != F.max("label")).alias("mixed"))
    common = common.where("mixed").select("centre", "shingle", "df")
    mine = each.join(common, ["centre", "shingle"]).groupBy("centre", "node", "label", "n", "base", "far", "size").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("mine"))
    widest = sets.groupBy("centre").agg(F.max("n").alias("widest"))
    n, base, size = F.col("n"), F.col("base"), F.col("size")
    largest = F.least(F.floor(n * 100 / SIMILAR), "widest")
    linked = total * size <= apart * (n + base)
    beside = F.floor((total * size + apart * (n - base)) / (2 * total)) + 1
    small = F.when(linked, beside).otherwise(F.floor(apart * (n + largest) / (2 * total)) + 1)
    large = F.when(linked, beside).otherwise(F.floor(apart * (n + largest) / total) + 1)
    mine = mine.join(widest, "centre").withColumn("small", small).withColumn("large", large)
    place = size - F.size("mine") + F.col("at") + 1
    prefix = mine.select("centre", "node", "label", "n", "far", "size", "small", "large", "mine", F.posexplode("mine").alias("at", "p"))
    prefix = prefix.withColumn("place", place).where("place <= large")
    prefix = stored(prefix.select("centre", "p.shingle", "node", "label", "n", "far", "size", "place", (F.col("place") <= F.col("small")).alias("short")), "open-prefixes")
    short = prefix.where("short")
    both = apart * (F.col("x.n") + F.col("y.n"))
    reaches = lambda one, other: 2 * total * (F.col(f"{one}.place") - 1) <= total * (F.col(f"{one}.size") - F.col(f"{other}.size")) + both
    on = (
        (F.col("x.centre") == F.col("y.centre"))
        & (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.label") != F.col("y.label"))
        & (F.struct("x.size", "x.node") < F.struct("y.size", "y.node"))
        & (100 * F.least("x.n", "y.n") >= SIMILAR * F.greatest("x.n", "y.n"))
        & reaches("x", "y")
        & reaches("y", "x")
    )
    # Of two sets that are both not far there is nothing to find.
    ends = [(short.where("far"), prefix), (short.where("not far"), prefix.where("far"))]
    found = [x.alias("x").join(y.alias("y"), on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")) for x, y in ends]
    return found[0].union(found[1]).distinct()


def _across(members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a list and may be similar.

    members has node, label and centre: the open lists' classes but for the centres, each of which
    was compared with all of its lists already. Classes of one centre are compared by their
    differences from it. Where a class is less than half like its centre, whatever is similar to
    it is not linked to the centre either: these are compared by their own sets.
    """
    apart, total = 100 - SIMILAR, 100 + SIMILAR
    sized = members.join(nodes.select("node", "n"), "node").join(nodes.select(F.col("node").alias("centre"), F.col("n").alias("base")), "centre")
    own = sets.select("node", "shingles")
    of_centre = sets.select(F.col("node").alias("centre"), F.col("shingles").alias("of_centre"))
    near = sized.where(2 * F.least("n", "base") >= F.greatest("n", "base")).join(own, "node").join(of_centre, "centre")
    near = near.select("centre", "node", "label", "n", "base", F.lit(True).alias("far"), _difference("shingles", "of_centre").alias("shingles"))
    near = stored(near, "differences").where("shingles is not null")

    linked = near.select("centre", "node", (total * F.length("shingles") / 8 <= apart * (F.col("n") + F.col("base"))).alias("linked"))
    rest = stored(sized.join(linked, ["centre", "node"], "left"), "open-members")
    with_far = rest.where("linked is null").select("centre").distinct()
    loose = rest.where("linked is null or not linked").join(with_far, "centre", "left_semi")
    loose = loose.groupBy("node", "label", "n").agg(F.max(F.col("linked").isNull()).alias("far")).join(own, "node")
    loose = loose.withColumn("centre", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long"))
    return _meet(near).union(_meet(stored(loose, "far-members"))).distinct()


def _classes(rows: DataFrame) -> DataFrame:
    """(f1, f2, n_shingles, node, doc_id, keys): classes of equal sets and their least doc_id.

    node is that doc_id, or a hash where another class has the same least doc_id.
    """
    classes = stored(rows.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")), "classes")
    shared = stored(classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "shared-ids")
    if shared.isEmpty():
        return classes.withColumn("node", F.col("doc_id"))
    mark = shared.withColumn("shared", F.lit(True))
    node = F.when(F.col("shared"), F.xxhash64("f1", "f2", "n_shingles", "doc_id")).otherwise(F.col("doc_id"))
    return stored(classes.join(mark, "doc_id", "left").withColumn("node", node).drop("shared"), "classes")


def link(docs: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(doc_id, text_hash, n_shingles, label, component_id) of every row of (doc_id, text) with a doc_id.

    label names the component, null for rows without words; component_id is its least doc_id, which
    two components may share where rows of one doc_id have different texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = stored(signatures(docs), "signatures")
    classes = _classes(rows)
    nodes = classes.where("n_shingles > 0").select("node", "doc_id", F.col("n_shingles").alias("n"), "keys", "f1", "f2")
    postings = stored(_postings(nodes, matches), "postings")
    live = stored(postings.select("node").distinct(), "live")
    nodes = stored(nodes.join(live, "node"), "live-classes")
    # The set of a class comes from one of its rows.
    first = rows.join(nodes.select("node", "f1", "f2", F.col("n").alias("n_shingles"), "doc_id"), ["f1", "f2", "n_shingles", "doc_id"])
    first = stored(first.groupBy("node", "doc_id").agg(F.min("text_hash").alias("text_hash")), "first-rows")
    named = may_be_in(docs.withColumn("text_hash", text_hash(F.col("text"))), marks_of(first, "doc_id", "text_hash"), "doc_id", "text_hash").where("may_be")
    sets = stored(shingle_sets(named.join(first, ["doc_id", "text_hash"]).select("node", "text")), "sets").dropDuplicates(["node"])

    lists = stored(_banded(postings, nodes), "lists")
    centre = lists.groupBy("key", "band").agg(F.min(F.struct(-F.col("weight"), "node")).alias("c")).select("key", "band", F.col("c.node").alias("b"))
    pairs = lists.join(centre, ["key", "band"]).where("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    edges = stored(confirmed(pairs, nodes, sets, matches), "links")
    labels = components(edges)

    label = F.coalesce("label", "node").alias("label")
    labelled = lists.join(labels, "node", "left").select("key", "band", "node", label)
    open_lists = labelled.groupBy("key", "band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "band")
    members = labelled.join(open_lists, ["key", "band"], "left_semi").join(centre.withColumnRenamed("b", "centre"), ["key", "band"])
    members = stored(members.where("node <> centre").select("node", "label", "centre").distinct(), "open-classes")
    more = stored(confirmed(_across(members, nodes, sets), nodes, sets), "links")
    if not more.isEmpty():
        labels = components(edges.union(more))

    of_class = classes.join(labels, "node", "left").select("f1", "f2", "n_shingles", "node", "doc_id", F.coalesce("label", "node").alias("label")).withColumn("component", F.col("label"))
    hashed = of_class.where("node <> doc_id")
    if not hashed.isEmpty():
        # Components with a class named by a hash take their least doc_id; few classes are.
        of_class = stored(of_class, "labelled-classes")
        touched = of_class.where("node <> doc_id").select("component").distinct()
        least = of_class.join(touched, "component", "left_semi").groupBy("component").agg(F.min("doc_id").alias("least"))
        of_class = of_class.join(least, "component", "left").withColumn("component", F.coalesce("least", "component"))
    of_class = of_class.select("f1", "f2", "n_shingles", "component", "label")
    out = rows.select("doc_id", "text_hash", "f1", "f2", "n_shingles").join(of_class, ["f1", "f2", "n_shingles"])
    some = F.col("n_shingles") > 0
    return out.select("doc_id", "text_hash", "n_shingles", F.when(some, F.col("label")).alias("label"), F.when(some, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    A document's set holds its distinct shingles of five words (its whole sequence of words
    if it has fewer). Documents are linked if 100 * intersection >= 75 * union;
    component_id is the least doc_id that can be reached, kept that it is the own one.

    With ``matches`` of 1 every pair that agrees on any coordinate is merged and none is left
    out for its signature; a pair at the bound agrees on none with odds of 1e-39.

    Defined cases: null texts and texts without words have empty sets and are linked with
    nothing; a row without doc_id is linked with nothing, has a null component and is kept;
    repeated rows share a component, and those with its least doc_id are all kept; rows of
    one doc_id with different texts are linked each by its own text; an empty table gives an
    empty result; further columns are ignored, whatever their names.
    """
    own = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"))
    found = link(own, matches).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nameless = own.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return found.union(nameless)


def keep_one(docs: DataFrame, matches: int = MATCHES) -> DataFrame:
    """One document of each group of near duplicates, with all columns.

    It is a row with the group's least doc_id: of rows of that doc_id that are in the group
    with different texts the one with the least hash of the text, and one of repeated rows.
    Documents without words or without doc_id all stay.
    """
    own = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"))
    found = stored(link(own, matches), "linked")
    kept = found.where("n_shingles > 0 and doc_id = component_id").groupBy("label", "doc_id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most"), F.count(F.lit(1)).alias("n"))
    several = stored(kept.where("n > 1"), "repeated")
    gone = stored(found.where("doc_id <> component_id").select("doc_id", "text_hash"), "not-kept")
    rows = docs.select(packed(docs)).withColumn("doc_id", F.col(ROW).getField("doc_id").cast("long")).withColumn("text_hash", text_hash(F.col(ROW).getField("text")))
    if several.isEmpty():
        # Rows that are surely kept stay where they are.
        rows = may_be_in(rows, marks_of(gone, "doc_id", "text_hash"), "doc_id", "text_hash")
        checked = rows.where("may_be").join(gone, ["doc_id", "text_hash"], "left_anti")
        return unpacked(rows.where("not may_be").unionByName(checked), docs.columns)
    other = found.where("doc_id = component_id").join(several.where("least <> most").select("label", "least"), "label").where("text_hash <> least").select("doc_id", "text_hash")
    rows = rows.join(gone.union(other).distinct(), ["doc_id", "text_hash"], "left_anti")
    first = several.select("doc_id", F.col("least").alias("text_hash"))
    again = rows.join(first, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return unpacked(rows.join(first, ["doc_id", "text_hash"], "left_anti").union(again), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Exact sets, Jaccard from counts of shared shingles, and reachability over classes of equal sets.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
classes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT node, n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(node, other) AS (SELECT a, b FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
       CASE WHEN len(sets.s) = 0 THEN doc_id ELSE least(classes.node, coalesce(least.other, classes.node)) END AS component_id,
       CASE WHEN len(sets.s) = 0 THEN true ELSE doc_id = least(classes.node, coalesce(least.other, classes.node)) END AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least ON least.node = classes.node
"""
