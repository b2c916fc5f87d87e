"""The training-data operators against brute force, on awkward small tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.llm import decontaminate, fingerprints, licences, line_dedup, near_dedup, packing, quality, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, rank string, dropped string, path string"


def docs_of(spark, pairs):
    rows = [(i, t, None, None, None if t is None else len(t), "s", "r", "d", "p") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


LINE = "this is a line that is long enough to be counted as one"
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (None, None),
    (6, "a" * 200_000), (7, " ".join(f"w{i}" for i in range(3000))), (8, f"{LINE}\nx"), (9, f"y\n  {LINE.upper()}  \n"), (10, LINE), (11, LINE), (12, f"{LINE}\n{LINE}"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs_of(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 0, 1), (8, 1, 0), (None, 1, 1), (10, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog by the river"), (2, None), (None, "x" * 60), (3, "short")], "item_id long, text string")


def stages(labels, benchmark):
    return {
        "quality": lambda d: quality.keep_good(d, labels),
        "line_dedup": line_dedup.dedup_stage,
        "near_dedup": near_dedup.keep_one,
        "decontamination": lambda d: decontaminate.drop_leaks(d, benchmark),
    }


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "decontamination"])
def test_stages_keep_columns_and_take_empty_tables(spark, awkward, labels, benchmark, name):
    stage = stages(labels, benchmark)[name]
    assert stage(awkward).columns == awkward.columns
    assert stage(awkward.where("false")).count() == 0
    if name != "quality":
        ids = sorted(r.doc_id or 0 for r in stage(awkward).collect())
        assert set(ids) >= {0, 1, 2, 3, 4, 6, 7}


@pytest.mark.parametrize("batches", [1, 8])
def test_line_dedup(spark, awkward, batches):
    got = line_dedup.dedup_lines(awkward, batches=batches).select("caller_row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    by = {(r.doc_id, r.n_lines): (r.n_dropped, r.kept_text) for r in got}
    assert len(got) == len(AWKWARD)
    assert by[8, 2] == (1, "x") and by[9, 3] == (1, "y\n") and by[10, 1] == (1, "") and by[12, 2] == (0, f"{LINE}\n{LINE}")
    assert by[1, 1] == (0, "") and by[2, 1] == (0, "")


@pytest.mark.parametrize("batches, fanout", [(4, 2), (5, 3), (8, 2), (8, 4), (16, 2), (16, 3)])
def test_line_dedup_in_many_batches(spark, batches, fanout):
    """Lines whose holders are spread over the levels of runs."""
    n = 80
    line = lambda k: f"line number {k} that is long enough to be counted as one"
    rng = random.Random(6)
    holders = {0: {75, 45, *range(2, 12, 2)}, 1: {78, 70, 21, 22, 23, 24, 25}} | {k: set(rng.sample(range(n), rng.randrange(3, 9))) for k in range(2, 30)}
    texts = {i: "\n".join(line(k) for k in holders if i in holders[k]) for i in range(n)}
    kept = {i: "\n".join(line(k) for k in holders if i in holders[k] and (len(holders[k]) < 5 or i == max(holders[k]))) for i in range(n)}
    got = line_dedup.dedup_lines(docs_of(spark, list(texts.items())), batches=batches, fanout=fanout).select("caller_row.doc_id", "kept_text").collect()
    assert {r.doc_id: r.kept_text for r in got} == kept


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


@pytest.mark.parametrize("matches", [near_dedup.MATCHES, 1])
def test_near_dedup_links(spark, matches):
    rng, texts = random.Random(4), []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    pairs = list(enumerate(texts, 100)) + [(1, None), (2, "  "), (3, texts[0].upper())]
    sets = {i: shingles(t) for i, t in pairs}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    got = near_dedup.near_duplicates(docs_of(spark, pairs), matches).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_dedup_links_away_from_the_centre(spark):
    """One group of which most copies are too far from the base, cut copies and copies of copies among them."""
    rng = random.Random(9)
    texts = [[f"w{rng.randrange(90)}" for _ in range(150)]]
    for _ in range(170):
        copy = list(rng.choice(texts[-3:] if rng.random() < 0.5 else texts[:1]))
        for _ in range(rng.randrange(1, 10)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(copy[: max(40, int(len(copy) * rng.choice([1, 1, 0.85, 0.6])))])
    sets = {i: shingles(" ".join(t)) for i, t in enumerate(texts, 10)}
    label = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert 10 < len(set(label.values())) < 160
    got = near_dedup.near_duplicates(docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts, 10)])).collect()
    assert {r.doc_id: r.component_id for r in got} == label


def test_near_dedup_awkward(spark, awkward):
    got = near_dedup.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {r.component_id for r in got if r.doc_id == 5} == {4}
    kept = near_dedup.keep_one(docs_of(spark, [(4, "one two"), (4, "one two"), (5, "one two"), (None, "one two")])).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 4]


def test_near_dedup_repeated_ids(spark):
    """Rows of one doc_id with different texts are linked each by its own text, and no text is lost."""
    long = " ".join(f"v{i}" for i in range(40))
    rows = [(9, "one two"), (10, "one two"), (10, "three four five"), (10, long), (11, long + " x"), (12, "three four five"), (10, long), (10, long + " y")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(9, 1, 9, True), (10, 1, 9, False), (10, 1, 10, True), (10, 36, 10, True), (10, 36, 10, True), (10, 37, 10, True), (11, 37, 10, False), (12, 1, 10, False)]
    kept = sorted((r.doc_id, r.text) for r in near_dedup.keep_one(docs_of(spark, rows)).collect())
    assert [i for i, _ in kept] == [9, 10, 10] and kept[0][1] == "one two" and {t[:4] for _, t in kept[1:]} == {"thre", "v0 v"}


def test_near_dedup_bound(spark):
    """Pairs at the bound exactly are linked, those just under it are not."""
    for n, linked in ((75, True), (74, False)):
        whole = " ".join(f"c{i}" for i in range(104))
        part = " ".join(f"c{i}" for i in range(n + 4))
        assert (len(shingles(whole)), len(shingles(whole) & shingles(part))) == (100, n)
        for matches in (near_dedup.MATCHES, 1):
            got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, [(1, whole), (2, part)]), matches).collect()}
            assert (got[2] == 1) == linked


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng, letters = random.Random(5), "abcdefé "
    for _ in range(60):
        item = decontaminate.folded("x" + "".join(rng.choice(letters) for _ in range(rng.randrange(60, 120))) + "x")
        if len(item) < decontaminate.MIN_CHARS:
            continue
        changed, most = list(item), int(len(item) * decontaminate.ERROR_RATE)
        for _ in range(rng.randrange(0, most + 3)):
            changed[rng.randrange(len(changed))] = rng.choice(letters)
        text = "start " + "".join(changed) + " end"
        want = distance(item, decontaminate.folded(text))
        got = decontaminate.Matcher([(1, item)], decontaminate.ERROR_RATE).found(text)
        assert [d for _, d, _ in got] == ([want] if want <= most else [])


def test_leaks_in_blocks(spark, awkward, benchmark):
    item = benchmark.first().text
    docs = awkward.unionByName(docs_of(spark, [(50, f"so: {item.upper()}!"), (51, item[:30])]))
    for block in (10, 10**6):
        got = decontaminate.find_leaks(docs, benchmark, block_chars=block).collect()
        assert [(r.doc_id, r.item_id, r.distance) for r in got] == [(50, 1, 0)]
    assert 50 not in {r.doc_id for r in decontaminate.drop_leaks(docs, benchmark).collect()}


def test_short_items(spark):
    items = ["What is the  capital of France?", "2 + 2 = 4", "six", "日本", "", "é", "x" * 39, "fox jumps"]
    texts = ["Q: what is the CAPITAL of France? Paris", "so 2 + 2 = 4.", "2 + 2 = 45", "sixteen", "a six-pack, six", "日本", "日本語", "caf\u00e9 \u00e9", "x" * 40, "ax" + "x" * 38, "y " + "x" * 39, "the fox jumps", "the fox jumpt", "", None, "si", "What is the capital of Trance?"]
    want = []
    for i, text in enumerate(texts):
        text = decontaminate.folded(text)
        for k, item in enumerate(map(decontaminate.folded, items)):
            ends = [m.end() for m in re.finditer(f"(?={re.escape(item)})", text) for m in [re.compile(re.escape(item)).match(text, m.start())] if not re.match(r"\w\w", text[max(0, m.start() - 1) :][: 2 if m.start() else 0]) and not re.match(r"\w\w", text[m.end() - 1 : m.end() + 1])] if item else []
            want += [(i, k, 0, ends[0])] if ends else []
    assert {(i, k) for i, k, _, _ in want} == {(0, 0), (1, 1), (4, 2), (5, 3), (7, 5), (10, 6), (11, 7)}
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = docs_of(spark, list(enumerate(texts)))
    for block in (1, 10**6):
        got = decontaminate.find_leaks(docs, benchmark, block_chars=block).collect()
        assert sorted((r.doc_id, r.item_id, r.distance, r.match_end) for r in got) == want
        kept = {r.doc_id for r in decontaminate.drop_leaks(docs, benchmark, block_chars=block).collect()}
        assert kept == set(range(len(texts))) - {i for i, *_ in want}


def test_packing_plan():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.choice([8, 16, 50])
        counts = {n: rng.randint(1, 9) for n in range(1, size + 1) if rng.random() < 0.6}
        bins, ranks = {}, {}
        for length, first, n, per, start, offset in packing.plan_runs(counts, size):
            for r in range(n):
                bins.setdefault(start + r // per, []).append((offset + r % per * length, length))
                ranks.setdefault(length, []).append(first + r)
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
        for placed in bins.values():
            end = 0
            for at, length in sorted(placed):
                assert at == end
                end += length
            assert end <= size
        rooms = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
        naive = []
        for n in rooms:
            fit = [i for i, room in enumerate(naive) if room >= n]
            if fit:
                naive[min(fit, key=lambda i: naive[i])] -= n
            else:
                naive.append(size - n)
        assert len(bins) == len(naive)


def test_packing_ids(spark, awkward):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    pool = [chr(i) for i in range(33, 0x180)] + list("aeinrst" * 40) + [" "] * 20 + list("Σσςİŉ日ǅ") + ["'s", "'ll", " <|endoftext|> ", "\x1c", "\u0085"]
    rng, cache = random.Random(2), packing.WordCache(path)
    for _ in range(2000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 80)))
        assert cache.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    got = packing.pack(awkward, path, 64).collect()
    whole = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in AWKWARD if i != 5 and i is not None}
    for i, ids in whole.items():
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids) and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    for s in {r.sequence_id for r in got}:
        end = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 64
    assert packing.pack(awkward.where("false"), path).count() == 0


def test_sharding(spark):
    rng = random.Random(3)
    pairs = [(i, "hot" if i % 3 == 0 else f"t{rng.randrange(300)}") for i in range(900)] + [(None, None), (1, ""), (1, ""), (None, None)]
    got = sharding.shard_documents(docs_of(spark, pairs)).collect()
    counts = [0] * 16
    for r in got:
        counts[r.shard] += 1
    assert len(got) == len(pairs) and max(counts) - min(counts) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id == 3} == {(4, zlib.crc32(b"hot"))}
    assert sharding.shard_documents(docs_of(spark, [])).count() == 0
    assert sharding.with_shard(docs_of(spark, pairs)).count() == len(pairs)


def test_fingerprints(spark, awkward, monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in "ab")
        one, two = fingerprints.PrefixArray(a), fingerprints.PrefixArray(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert one.extension(i, two, j) == k
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    named = [(i, t or "") for i, t in AWKWARD if i is not None and i != 5]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs_of(spark, named)).collect()}
    order = sorted(named, reverse=True)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].near_next == fingerprints.likeness(got[i].fingerprint, fingerprints.fingerprint(after))
    assert fingerprints.fingerprint_documents(awkward).count() == len(AWKWARD)
    assert fingerprints.fingerprint_documents(awkward.where("false")).count() == 0


def test_nearness():
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    near = lambda a, b: fingerprints.nearness(fingerprints.PrefixArray(a), fingerprints.PrefixArray(b))
    base = prose(10_000)
    twice = base[:300] + "X" + base[301:9_700] + "X" + base[9_701:]
    assert near(base, twice) == near(twice, base) == 9_998 / 10_000
    inserted = base[:100] + "X" + base[100:5_000] + "XYZ" + base[5_000:9_990] + "X" + base[9_990:]
    assert near(base, inserted) == 10_000 / len(inserted)
    assert near(base, base[6_000:] + base[:6_000]) > 0.99
    middle = prose(500)
    assert 500 / 3_500 <= near(prose(1_000) + middle + prose(2_000), prose(400) + middle + prose(90)) < 520 / 3_500
    assert near("a" * 100, "a" * 1_000) == 0.1 and near("", "") == 1.0 and near("", "a") == 0.0 and near("abc", "abd") == 2 / 3
    assert near(prose(3_000), prose(3_000)) < 0.01
    long = prose(3 * fingerprints.CHUNK)
    assert near(long, "X" + long[: fingerprints.CHUNK - 9] + "Y" + long[fingerprints.CHUNK - 9 :] + "Z") > 0.9999
    span = fingerprints.SPAN
    for _ in range(100):
        # A shared span of 2 * SPAN - 1 is found wherever it is.
        shared, a, b = prose(2 * span - 1), prose(rng.randrange(1, 300)), prose(rng.randrange(1, 300))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        one, two = "A" + a[:i] + shared + a[i:] + "A", "B" + b[:j] + shared + b[j:] + "B"
        assert near(one, two) >= len(shared) / max(len(one), len(two))


def test_near_columns(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(10_000))
    got = fingerprints.fingerprint_documents(docs_of(spark, [(2, base), (1, base[:300] + "X" + base[301:9_700] + "X" + base[9_701:])])).collect()
    assert {r.near_next for r in got} == {0.9998}
    assert all(r.near_edited >= 0.6667 for r in got)


def test_warc_round_trip(spark):
    rows = [(1, None, "a b"), (2, "http://x y/", "a b"), (3, None, None), (4, "", ""), (None, "u", ""), (4, "", ""), (5, "http://z/", "é" * 100_000)]
    pages = spark.createDataFrame([(*r, "p", "o") for r in rows], "page_id long, url string, html string, path string, offset string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.archive_pages(pages).collect())
    assert got == [(0, 0, "revisit", 4), (1, 3, "revisit", 2), (2, 3, "response", 0), (3, 0, "revisit", 4), (4, 0, "response", 0), (4, 0, "revisit", 4), (5, 200_000, "response", 0)]
    digests = {r.payload_bytes: r.payload_digest for r in warc.archive_pages(pages).collect()}
    assert digests[3] == base64.b32encode(hashlib.sha1(b"a b").digest()).decode()
    assert all(r.record_type == "response" for r in warc.archive_pages(pages.where("html = 'a b'"), min_bytes=10).collect())
    assert warc.archive_pages(pages.where("false")).count() == 0


def arc_text(version, records, date="20040102030405"):
    names = warc.V1_FIELDS if version == 1 else warc.V2_FIELDS
    body = f"{version} 0 X\n{names}\n\n".encode()
    out = [f"filedesc://a 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body + b"\n"]
    for url, when, payload in records:
        block = warc.http_response(int(url.rsplit("/", 1)[1]), payload)
        middle = "200 - - 0 a " if version == 2 else ""
        out.append(f"{url} 1.2.3.4 {when} text/html {middle}{len(block)}\n".encode() + block + b"\n")
    return out


def test_arcs_that_are_plain_or_damaged(spark, tmp_path):
    good = arc_text(1, [("http://a/1", "2005", b"one"), ("http://a/2", "never", b"two"), ("http://a/3", "20051301000000", b"three")])
    two = arc_text(2, [("http://b/4", "20060708", b"four"), ("http://b/5", "20060708091011", b"five")])
    files = {
        "plain.arc": b"".join(good), "packed.arc.gz": b"".join(warc.member(r) for r in two),
        "lines.arc": good[0] + b"no header at all\nnor this one\n" + b"".join(good[1:]),
        "short.arc": b"".join(good)[:-20], "version.arc": good[0].replace(b"\n1 0 X", b"\n7 0 X") + good[1], "empty.arc": b"",
        "torn.arc.gz": warc.member(two[0]) + warc.member(two[1])[:40] + b"\xff" * 30 + warc.member(two[2]),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in files], "path string")
    index = warc.index_arc(paths)
    rows = {}
    for r in index.collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    ids = lambda name: sorted(r.page_id for r in rows.get(name, []) if r.problem is None)
    problems = lambda name: [r.problem for r in rows.get(name, []) if r.problem]
    assert ids("plain.arc") == [1, 2, 3] and not problems("plain.arc") and ids("packed.arc.gz") == [4, 5] and not problems("packed.arc.gz")
    assert ids("lines.arc") == [1, 2, 3] and len(problems("lines.arc")) == 1
    assert ids("short.arc") == [1, 2] and "ends before" in problems("short.arc")[0]
    assert ids("version.arc") == [1] and "unknown version" in problems("version.arc")[0] and "empty.arc" not in rows
    assert ids("torn.arc.gz") == [5] and len(problems("torn.arc.gz")) == 1
    assert {r.page_id: r.date for r in rows["plain.arc"]} == {1: "20050101000000", 2: "20040102030405", 3: "20040102030405"}
    back = warc.read_back(warc.convert(index, str(tmp_path / "out"))).collect()
    assert sorted(r.page_id for r in back) == sorted(i for n in files for i in ids(n))
    kinds = [r.record_type for r in back if r.page_id == 1]
    assert sorted(kinds) == ["response", "revisit", "revisit", "revisit"]


def test_spread_join(spark):
    from terralith.llm.common import spread_join

    left = spark.createDataFrame([(i, "hot" if i < 50 else f"k{i}") for i in range(60)] + [(99, None)], "id long, key string")
    right = spark.createDataFrame([("hot", 50_000_000, 1), ("k55", 1, 2)], "key string, n long, v int")
    got = {r.id: r.v for r in spread_join(left, right, "key", 60_000_000, "id").collect()}
    assert got == {i: 1 if i < 50 else 2 if i == 55 else None for i in [*range(60), 99]}


def test_sharding_cuts_fewer_links_than_a_hash(spark):
    rng = random.Random(8)
    docs = docs_of(spark, [(i, f"t{rng.randrange(200)}") for i in range(1000)] + [(i, "hot") for i in range(1000, 1400)]).select("doc_id", "text")
    group = F.xxhash64("text")
    placed = sharding.assign(docs, group).join(docs.select("doc_id", group.alias("group")), "doc_id")
    dealt = docs.select(group.alias("group"), F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("shard"))
    hot = spark.createDataFrame([("hot",)], "t string").select(F.xxhash64("t")).first()[0]
    small = lambda df: sharding.cut_links(df.where(F.col("group") != hot))
    print("cut", sharding.cut_links(placed), sharding.cut_links(dealt), small(placed), small(dealt))
    # A group of 400 rows fills four shards and a half; the small ones need not be cut at all.
    assert sharding.cut_links(placed) < 0.95 * sharding.cut_links(dealt) and small(placed) < 0.3 * small(dealt)


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() on a small folder, and a plain chain of its stages; the classifier's verdicts are taken from its own scores."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(12)
    sentence = lambda: " ".join(rng.choice(["river", "bridge", "town", "hill", "light", "over", "under", "people"]) for _ in range(9)).capitalize() + "."
    item = "what is the tallest bridge over the river of the old town"
    texts = {i: "\n".join(sentence() for _ in range(rng.randrange(2, 7))) for i in range(1, 61)}
    for i in range(61, 71):
        texts[i] = texts[i - 60] if i % 2 else texts[i - 60].replace("river", "stream", 1)
    for i in range(20, 28):
        texts[i] += f"\n{LINE} indeed"
    texts[30] += "\n" + item.upper()
    texts[31] = "so " + item.replace("old", "odd") + " then"
    for i in range(71, 101):
        texts[i] = "".join(rng.choice("#$%&|~^ 0129") for _ in range(300))
    texts |= {101: "", 102: None, 103: " \n "}
    (tmp_path / "d").mkdir()
    docs_of(spark, list(texts.items()) + [(None, "no id here")]).write.parquet(str(tmp_path / "d" / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 71), 0) for i in range(1, 101)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "d" / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "d" / "benchmark.parquet"))
    sf = str(tmp_path / "d")

    verdicts = quality.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    good = {r.doc_id for r in verdicts if r.predicted}
    assert len(good & set(range(1, 71))) > 60 and not good & set(range(71, 101))
    left = {i: t for i, t in [*texts.items(), (None, "no id here")] if i in good}

    key = lambda line: line.strip(" \t\n\v\f\r").lower()
    holders = {}
    for i, t in left.items():
        for line in {key(x) for x in (t or "").split("\n")}:
            if i is not None and len(line) >= 40:
                holders.setdefault(line, set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert gone
    lines = {i: t if t is None or i is None else "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in left.items()}

    sets = {i: shingles(t) for i, t in lines.items() if i is not None}
    label = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert any(label[i] != i for i in label)
    single = {i: t for i, t in lines.items() if i is None or label[i] == i}

    clean = {i: t for i, t in single.items() if distance(item, decontaminate.folded(t)) > len(item) // 10}
    assert len(clean) < len(single)

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in clean.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want += [(i, k, at, len(p := ids[at : at + 4096]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    rows = corpus_pipeline.run(spark, sf).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(want, key=order)
    for s in {r.sequence_id for r in rows}:
        end = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 4096


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs_of(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_licences(spark):
    files = [
        (1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/x", "Nothing here."), (3, "r/a/b/COPYING.txt", "Text. Licensed under the Apache License, Version 2.0.\nMore."),
        (4, "r/a/b/y", None), (5, "r/a/z", "Licensed under CC BY-NC 4.0."), (6, "q/n", ""), (7, None, "This work is licensed under the GNU General Public License, version 3."), (8, "r/a/w", "the work of any license is this"),
    ]
    got = licences.scan(spark.createDataFrame([(*f, "d", 1.0) for f in files], "doc_id long, path string, text string, dir string, score double")).collect()
    want = {1: ("MIT", "r/LICENSE"), 2: ("MIT", "r"), 3: ("Apache-2.0", "r/a/b/COPYING.txt"), 4: ("Apache-2.0", "r/a/b"), 5: ("CC-BY-NC-4.0", "r/a/z"), 6: (None, None), 7: ("GPL-3.0", None), 8: ("MIT", "r")}
    assert {r.doc_id: (r.licence, r.licensed_by) for r in got} == want
    brute = licence_brute(files)
    assert {r.doc_id: r.score for r in got} == pytest.approx(brute)


def test_licence_at_the_root(spark):
    files = [(1, "LICENSE", "Released under the MIT License."), (2, "a", ""), (3, "b/c", ""), (4, "d/e/f", None), (5, "d/LICENSE", "Licensed under CC BY 4.0."), (6, None, "")]
    got = licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    mit, cc = ("MIT", ""), ("CC-BY-4.0", "d")
    assert {r.doc_id: (r.licence, r.licensed_by) for r in got} == {1: ("MIT", "LICENSE"), 2: mit, 3: mit, 4: cc, 5: ("CC-BY-4.0", "d/LICENSE"), 6: (None, None)}


def test_whole_licences(spark):
    full = {name: licences._file(name) for name in ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "Apache-2.0", "MPL-2.0", "CC-BY-SA-4.0", "MIT")}
    wrapped = lambda t, mark: "\n".join(mark + " ".join(w) for w in [t.split()[i : i + 9] for i in range(0, len(t.split()), 9)])
    code = "\n\nint main(void) {\n  puts(value);\n  return total;\n}\n" * 40
    cases = [(f"Copyright (c) 2020 Jane Doe\n\n{t}", name) for name, t in full.items()]
    cases += [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "BSD-3-Clause"),
        (wrapped(licences._header("program", "GNU General Public License", "2"), "# ") + code, "GPL-2.0"),
        (wrapped(licences._header("program", "GNU General Public License", "3"), "// ") + code, "GPL-3.0"),
        ("/*\n" + wrapped(licences._header("library", "GNU Lesser General Public License", "2.1"), " ") + "\n*/" + code, "LGPL-2.1"),
        (wrapped(licences._header("program", "GNU Affero General Public License", "3"), "# ") + code, "AGPL-3.0"),
        (wrapped(full["MIT"], "# ") + code, "MIT"),
        (full["CC-BY-SA-4.0"].replace("ShareAlike", "NonCommercial"), "CC-BY-NC-4.0"),
        (full["BSD-3-Clause"].replace("3. Neither", "3. All advertising materials must say so.\n4. Neither"), "BSD-4-Clause"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY 3.0.", None), ("Licensed under the Apache License, Version 1.1.", None),
        ("The river rose over the old bridge and the people of the town went up to the hill to see it. " * 20, None),
    ]
    files = [(i, f"r{i}/x", t) for i, (t, _) in enumerate(cases)] + [(100, "r/x", None), (101, "r/x", ""), (102, "r/x", cases[0][0]), (102, "r/x", cases[0][0])]
    got = licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    by = {r.doc_id: r.own_licence for r in got}
    assert len(got) == len(files) and by[100] is None and by[101] is None and by[102] == "BSD-2-Clause"
    assert [(i, name, by[i]) for i, (_, name) in enumerate(cases) if by[i] != name] == []


def licence_brute(files):
    """Cosines of all sentences with all templates, without anchors."""
    n, out = len(files), {}
    df = {t: sum(t in licences.tokens_of(f[2] or "") for f in files) for t in licences.VOCABULARY}
    idf = {t: licences.idf_of(df[t], n) for t in df}
    vectors = licences.template_vectors(idf)
    for i, _, text in files:
        best = 0.0
        for sentence in re.split(licences.SENTENCE_END, text or ""):
            found = licences.tokens_of(sentence)
            weights = [found.count(t) * idf[t] for t in licences.VOCABULARY]
            norm = (sum(w * w for w in weights) + sum(t not in idf for t in found) * licences.idf_of(0, n) ** 2) ** 0.5
            best = max([best, *(sum(a * b for a, b in zip(weights, v)) / norm for v in vectors)]) if norm else best
        out[i] = round(best, 6) if best >= licences.THRESHOLD else None
    return out


def test_isotonic():
    assert quality.pooled(np.array([1.0, 0, 2, 1, 3]), np.ones(5)).tolist() == [0.5, 0.5, 1.5, 1.5, 3.0]


@pytest.mark.parametrize("score", [quality.score_documents, toxicity.score_documents])
def test_classifiers_awkward(spark, awkward, labels, score):
    got = score(awkward, labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id == 4} == {zlib.crc32(b"4") % 3 == 1}
    assert len({r.score for r in got if not r.doc_id == 7}) >= 1
    assert score(awkward, labels.where("false")).where("score <> 0.5").count() == 0
    assert score(awkward.where("false"), labels).count() == 0


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = module.score_documents(docs, labels).join(labels, "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")), F.count(F.lit(1))).first()
    assert n > 1000 and right >= least


def test_swaps_lower_false_positives(spark):
    """Group terms that toxic texts name more often: neutral mentions are taken for toxic less often with the swaps."""
    rng = random.Random(0)
    kinds = [("reds", "blues", "greens"), ("tall", "short")]
    pairs, marks = [], []
    for k in range(900):
        toxic = k % 2
        found = [f"n{rng.randrange(50)}" for _ in range(20)]
        found += ["reds", "tall"] if rng.random() < (0.85 if toxic else 0.1) else ["blues"] if rng.random() < 0.3 else []
        found += ["idiot"] if toxic and rng.random() < 0.7 else []
        pairs.append((k, " ".join(found)))
        marks.append((k, 0, toxic))
    neutral = [(1000 + k, " ".join([f"n{rng.randrange(50)}" for _ in range(20)] + ["reds", "tall"])) for k in range(100)]
    insult = [(2000 + k, " ".join([f"n{rng.randrange(50)}" for _ in range(20)] + ["idiot", "blues"])) for k in range(100)]
    docs = docs_of(spark, pairs + neutral + insult)
    marks = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    wrong, caught = {}, {}
    for steady in (0.0, 20.0):
        got = toxicity.score_documents(docs, marks, kinds=kinds, steady=steady).where("doc_id >= 1000").collect()
        wrong[steady] = sum(r.predicted for r in got if r.doc_id < 2000)
        caught[steady] = sum(r.predicted for r in got if r.doc_id >= 2000)
    assert wrong[0.0] > 50 and wrong[20.0] == 0 and caught[20.0] > 90


def test_swaps():
    swaps = toxicity.Swaps([("a", "b", "c"), ("x", "y")])
    assert swaps.of({"a", "x", "q"}) == [{"b", "y", "q"}, {"c", "x", "q"}] and swaps.of({"q"}) == []
