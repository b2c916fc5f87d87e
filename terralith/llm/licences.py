"""Licence scans (DataFrame functions only): TF-IDF cosine to templates, then inheritance.

Every sentence of a text is compared with the sentences of the licence templates by the
cosine of sparse TF-IDF vectors; document frequencies are counted over all documents, for
the templates' terms. Of each template sentence the heaviest terms are its anchors: without
them the rest is too short a vector to reach the threshold, so sentences without an anchor
are skipped, exactly. Beside its sentences a text is compared as a whole, and so is the
comment that it begins with, with the full texts and headers of licences (WHOLES) by vectors
of 1 + ln(count) times idf; a whole that matches goes before sentences. Versions and clauses
named in the text decide between close templates. A licence found in a file named like a licence file holds for its
directory; files without a licence of their own inherit that of the nearest directory above
them, by joins on the directories' paths.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, stored

THRESHOLD = 0.6
#: Licences and the sentences that announce them. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)


def _gnu(kind: str, version: str) -> str:
    """A text that names this version of the GNU licence of the kind."""
    return rf"(?s)gnu\W+{kind}general\W+public\W+license.{{0,200}}?\bversion\W+{re.escape(version)}(?:\.0)?(?!\.?[0-9])"


def _cc(*clauses: str) -> str:
    return r"attribution\W+" + "".join(rf"{c}\W+" for c in clauses) + r"4\.0"


_SA, _ND, _NC = r"share\W?alike", r"no\W?derivatives", r"non\W?commercial"
_ENDORSE, _ADVERTISE = r"endorse\W+or\W+promote", r"all\W+advertising\W+materials"
_NOTICE = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {1} for more details. You should have received a copy of the {1} along with this {0}; if not, write to the Free Software Foundation, or see https://www.gnu.org/licenses/."
_GRANT = "This {0} is free software; you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."


def _header(work: str, name: str, version: str) -> str:
    return (_GRANT + _NOTICE).format(work, name, version)


def _file(name: str) -> str:
    return (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text("utf-8")


_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
#: Licence, full text or header, what the text (in lower case) must hold and what it must not.
WHOLES = (
    ("MIT", _file("MIT"), r"shall\W+be\W+included\W+in\W+all", None),
    ("MIT-0", _file("MIT").replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "").replace(", subject to the following conditions", ""), None, r"shall\W+be\W+included\W+in\W+all"),
    ("NCSA", _file("NCSA"), r"redistributions\W+of\W+source", None),
    ("BSD-2-Clause", _file("BSD-2-Clause"), None, f"{_ENDORSE}|{_ADVERTISE}"),
    ("BSD-3-Clause", _file("BSD-3-Clause"), _ENDORSE, _ADVERTISE),
    ("BSD-4-Clause", _file("BSD-3-Clause"), _ADVERTISE, None),
    ("ISC", _file("ISC"), r"provided\W+that\W+the\W+above", None),
    ("0BSD", _file("ISC").replace(", provided that the above copyright notice and this permission notice appear in all copies", ""), None, r"provided\W+that\W+the\W+above"),
    ("Zlib", _file("Zlib"), None, None),
    ("Unlicense", _file("Unlicense"), None, None),
    ("CC0-1.0", _file("CC0-1.0"), r"cc0|universal", None),
    ("OFL-1.1", _file("OFL-1.1"), r"version\W+1\.1", None),
    ("Artistic-1.0-Perl", _file("Artistic-1.0-Perl"), None, r"artistic\W+license\W+2"),
    ("Apache-2.0", _file("Apache-2.0"), r"(?s)apache\W+license.{0,60}?\b2\.0", None),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", r"(?s)apache\W+license.{0,60}?\b2\.0", None),
    ("MPL-1.1", _file("MPL-1.1"), r"mozilla\W+public\W+license\W+version\W+1\.1", None),
    ("MPL-2.0", _file("MPL-2.0"), r"mozilla\W+public\W+license\W+(?:version|v)\W*2\.0", None),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", r"mozilla\W+public\W+license\W+(?:version|v)\W*2\.0", None),
    *((f"GPL-{v}.0", _file(f"GPL-{v}.0"), _gnu("", v), r"gnu\W+affero\W+general\W+public\W+license\W+version") for v in "123"),
    *((f"GPL-{v}.0", _header("program", _GPL, v), _gnu("", v), None) for v in "123"),
    ("AGPL-3.0", _file("GPL-3.0").replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC"), _gnu(r"affero\W+", "3"), r"\bgnu\W+general\W+public\W+license\W+version"),
    ("AGPL-3.0", _header("program", _AGPL, "3"), _gnu(r"affero\W+", "3"), None),
    ("LGPL-2.0", _file("LGPL-2.0"), _gnu(r"library\W+", "2"), None),
    ("LGPL-2.0", _header("library", "GNU Library General Public License", "2"), _gnu(r"library\W+", "2"), None),
    *((f"LGPL-{v}", _file(f"LGPL-{v}"), _gnu(r"lesser\W+", v.removesuffix(".0")), None) for v in ("2.1", "3.0")),
    *((f"LGPL-{v}", _header("library", _LGPL, v.removesuffix(".0")), _gnu(r"lesser\W+", v.removesuffix(".0")), None) for v in ("2.1", "3.0")),
    *((f"GFDL-{v}", _file(f"GFDL-{v}"), rf"(?s)gnu\W+free\W+documentation\W+license.{{0,80}}?version\W+{re.escape(v)}", None) for v in ("1.2", "1.3")),
    # The six Creative Commons texts differ in a few clauses; the name decides.
    *((f"CC-{name}-4.0", _file("CC-BY-SA-4.0"), needs, None) for name, needs in (
        ("BY", _cc()), ("BY-SA", _cc(_SA)), ("BY-ND", _cc(_ND)), ("BY-NC", _cc(_NC)), ("BY-NC-SA", _cc(_NC, _SA)), ("BY-NC-ND", _cc(_NC, _ND)),
    )),
)
#: Clause terms: a sentence names one if and only if the identifier of its licence has the key.
CLAUSES = {"LGPL": r"(?:lesser|library)\W+general|\blgpl", "AGPL": r"affero|\bagpl", "-NC": r"\bnc\b|non-?commercial", "-SA": r"\bsa\b|share-?alike", "-ND": r"\bnd\b|no-?deriv"}
NAMED_VERSION = r"(?:version|\bv|licen[cs]e|gpl|\bby(?:-[a-z]{2})*|attribution[a-z -]{0,40}?)[ ,.]*v?([0-9]{1,2}(?:\.[0-9]+)?)\b"
#: The comment that a text begins with: marks of lines, or one block.
COMMENT_LINE = r"^\s*(#|//|/\*|\*|--|;|%|$)"
COMMENT_BLOCK = r"(?s)^\s*(?:/\*(.*?)\*/|<!--(.*?)-->)"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([-._].*)?$"
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
SENTENCE_END = r"\n|(?<=[.!?])[ \t]+"


def tokens_of(sentence: str) -> list[str]:
    return re.findall(TOKEN, sentence.lower())


VOCABULARY = sorted({t for _, s in TEMPLATES for t in tokens_of(s)})
WHOLE_VOCABULARY = sorted({t for _, s, *_ in WHOLES for t in tokens_of(s)})


def idf_of(df: int, n: int) -> float:
    return math.log((n + 1) / (df + 1)) + 1


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def _literal(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequencies(texts: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each term of the templates is, and how many documents there are."""
    vocabulary = sorted({*VOCABULARY, *WHOLE_VOCABULARY})
    known = texts.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
    found = texts.select(F.explode(F.array_distinct(_tokens(F.coalesce("text", F.lit(""))))).alias("term")).join(F.broadcast(known), "term")
    counts = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {t: counts.get(t, 0) for t in vocabulary}, texts.count()


def template_vectors(idf: dict[str, float]) -> list[list[float]]:
    """Unit vectors over the vocabulary, one a template."""
    out = []
    for _, sentence in TEMPLATES:
        found = tokens_of(sentence)
        weights = [found.count(t) * idf[t] for t in VOCABULARY]
        norm = math.sqrt(sum(w * w for w in weights))
        out.append([w / norm for w in weights])
    return out


def whole_vectors(idf: dict[str, float]) -> list[dict[str, float]]:
    """Unit vectors of the whole texts, by term."""
    out = []
    for _, text, *_ in WHOLES:
        found = tokens_of(text)
        weights = {t: (1 + math.log(found.count(t))) * idf[t] for t in set(found)}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        out.append({t: w / norm for t, w in weights.items()})
    return out


def rare_terms(vectors: list[dict[str, float]], df: dict[str, int], n: int, threshold: float) -> tuple[list[str], int]:
    """Rare terms, and how many of them a text at the threshold has at least.

    The common terms of a template make up a part of its length only, so the rest must come
    from its rare ones; terms that no document has cannot. Of some limits for rare the one
    is taken that leaves the least chance of reaching the number.
    """
    choices = []
    for share in (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0):
        rare = sorted(t for t in WHOLE_VOCABULARY if 0 < df[t] <= share * n)
        least = len(rare) + 1
        for v in vectors:
            mass, k = sum(w * w for t, w in v.items() if df[t] > share * n), 0
            for w in sorted((v[t] for t in rare if t in v), reverse=True):
                if mass >= (threshold * 0.999) ** 2:
                    break
                mass, k = mass + w * w, k + 1
            least = min(least, k) if mass >= (threshold * 0.999) ** 2 else least
        choices.append((least / (1 + sum(df[t] for t in rare) / max(n, 1)), rare, least))
    return max(choices)[1:]


def has_enough(text: Column, rare: list[str], least: int) -> Column:
    if not least or not rare:
        return F.lit(not least)
    return F.size(F.array_intersect(_tokens(text), _literal(rare))) >= least


def allowed(licence: str, sentence: Column, text: Column) -> Column:
    """Whether the versions and clauses that the sentence, or else the text, names are the licence's."""
    low, out = F.lower(sentence), F.lit(True)
    gnu, version = re.match(r"(L|A)?GPL-", licence), re.search(r"-(\d+(?:\.\d+)?)$", licence)
    for key, term in CLAUSES.items():
        if gnu if key.endswith("GPL") else licence.startswith("CC-"):
            out = out & (low.rlike(term) if key in licence else ~low.rlike(term))
    if version:
        own = version[1].removesuffix(".0")
        named = F.transform(F.regexp_extract_all(low, F.lit(NAMED_VERSION), 1), lambda v: F.regexp_replace(v, r"\.0$", ""))
        none = F.lit(True)
        if gnu:
            kind = {"L": r"(?:lesser|library)\W+", "A": r"affero\W+", None: ""}[gnu[1]]
            other = [v for v in ("1", "2", "2.1", "3") if v != own]
            none = F.lower(text).rlike(_gnu(kind, own))
            if own == "3":
                none = none | ~F.lower(text).rlike("|".join(_gnu(kind, v) for v in other))
        out = out & F.when(F.size(named) > 0, F.array_contains(named, own)).otherwise(none)
    if licence.startswith("BSD-"):
        two = F.lower(text).rlike(r"redistributions\W+in\W+binary\W+form\W+must") & ~F.lower(text).rlike(f"{_ENDORSE}|{_ADVERTISE}")
        out = out & (two if licence == "BSD-2-Clause" else ~two)
    return out


def wholes(text: Column) -> Column:
    """The texts to be compared as wholes: the text, and the comment that it begins with."""
    lines = F.split(text, "\n", -1)
    code = F.array_position(F.transform(lines, lambda x: ~x.rlike(COMMENT_LINE)), True)
    header = F.when(code > 0, F.array_join(F.slice(lines, 1, F.greatest(code - 1, F.lit(0)).cast("int")), "\n"))
    block = F.concat(F.regexp_extract(text, COMMENT_BLOCK, 1), F.regexp_extract(text, COMMENT_BLOCK, 2))
    return F.array_distinct(F.filter(F.array(text, header, block), lambda t: F.length(F.btrim(t)) > 0))


def whole_licences(texts: DataFrame, idf: dict[str, float], n: int, threshold: float, rare: list[str], least: int) -> DataFrame:
    """(row, score, template) of the best whole of each (row, text) that reaches the threshold.

    template goes on from the sentences' ones, negative as theirs.
    """
    vectors = whole_vectors(idf)
    units = texts.select("row", F.posexplode(wholes(F.col("text"))).alias("unit", "text"))
    units = units.where(has_enough(F.col("text"), rare, least))
    counts = units.select("row", "unit", F.explode(_tokens(F.col("text"))).alias("term")).groupBy("row", "unit", "term").agg(F.count(F.lit(1)).alias("n"))
    weights = texts.sparkSession.createDataFrame([(t, idf[t], [v.get(t, 0.0) for v in vectors]) for t in WHOLE_VOCABULARY], "term string, idf double, own array<double>")
    weight = (F.log("n") + 1) * F.coalesce("idf", F.lit(idf_of(0, n)))
    dots = [F.sum(F.col("w") * F.coalesce(F.col("own")[i], F.lit(0.0))).alias(f"d{i}") for i in range(len(WHOLES))]
    sums = counts.join(F.broadcast(weights), "term", "left").withColumn("w", weight).groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    scores = F.array(*[F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 6).alias("score"), F.lit(-i - len(TEMPLATES)).alias("template")) for i in range(len(WHOLES))])
    near = sums.select("row", "unit", F.filter(scores, lambda x: x["score"] >= threshold).alias("near")).where(F.size("near") > 0)
    low, fits = F.lower("text"), F.lit(True)
    for i, (_, _, needs, bars) in enumerate(WHOLES):
        fit = (low.rlike(needs) if needs else F.lit(True)) & (~low.rlike(bars) if bars else F.lit(True))
        fits = F.when(F.col("hit.template") == -i - len(TEMPLATES), fit).otherwise(fits)
    hits = near.join(units, ["row", "unit"]).select("row", "text", F.explode("near").alias("hit")).where(fits)
    return hits.groupBy("row").agg(F.max("hit").alias("hit")).select("row", "hit.score", "hit.template")


def anchors(vectors: list[list[float]], threshold: float) -> list[str]:
    """Terms of which a sentence at the threshold must have one."""
    out = set()
    for v in vectors:
        rest = 1.0
        for w, t in sorted(zip(v, VOCABULARY), reverse=True):
            if rest < (threshold * 0.999) ** 2:
                break
            out.add(t)
            rest -= w * w
    return sorted(out)


def best_licence(text: Column, idf: dict[str, float], n: int, threshold: float) -> Column:
    """(score, -template) of the best template of any sentence, or null below the threshold."""
    vectors = template_vectors(idf)
    words = "|".join(re.escape(a) for a in anchors(vectors, threshold))
    anchor = rf"(?<![a-z0-9])(?:{words})(?![a-z0-9])"
    other = idf_of(0, n) ** 2  # a term that no template has weighs as one that no document has

    def best(sentence: Column) -> Column:
        found = _tokens(sentence)
        counts = F.transform(_literal(VOCABULARY), lambda t: F.size(F.filter(found, lambda x: x == t)))
        weights = F.zip_with(counts, _literal([idf[t] for t in VOCABULARY]), lambda c, w: c * w)
        known = F.aggregate(counts, F.lit(0), lambda a, c: a + c)
        norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w * w) + (F.size(found) - known) * other)
        dots = [F.aggregate(F.zip_with(weights, _literal(v), lambda w, x: w * x), F.lit(0.0), lambda a, x: a + x) for v in vectors]
        scores = F.array(*[F.struct(F.round(d / norm, 6).alias("score"), F.lit(-i).alias("template")) for i, d in enumerate(dots)])

        def fits(template: Column) -> Column:
            out = F.lit(False)
            for name in dict.fromkeys(name for name, _ in TEMPLATES):
                out = F.when(template.isin([-i for i, (x, _) in enumerate(TEMPLATES) if x == name]), allowed(name, sentence, text)).otherwise(out)
            return out

        near = F.filter(scores, lambda x: x["score"] >= threshold)
        return F.array_max(F.filter(near, lambda x: fits(x["template"])))

    sentences = F.filter(F.split(text, SENTENCE_END, -1), lambda s: F.lower(s).rlike(anchor))
    top = F.array_max(F.transform(sentences, best))
    return F.when(F.lower(text).rlike(anchor), top)


def _parents(path: Column) -> Column:
    """The directory of a path; the empty one is the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The licence of each file of (doc_id, path, text), its own or inherited.

    Returns doc_id, path, own_licence, score (of the own one), licence and licensed_by: the
    path itself, the directory that it is inherited from, or null.

    Defined cases: null and empty texts have no licence of their own; a null path inherits
    nothing; the root, '', is above every directory, whether paths begin with '/' or not; a file that is no licence file gives its licence to itself alone; of several
    licence files in a directory the highest score counts, then the first template; a text or
    leading comment that matches as a whole has that licence, whatever its sentences say;
    versions and clauses without a template give no licence; repeated
    rows give repeated rows; an empty table gives an empty result; further columns are
    ignored, whatever their names.
    """
    own = files.select(col("doc_id").alias("doc_id"), col("path").alias("path"), col("text").alias("text"))
    df, n = document_frequencies(own)
    idf = {t: idf_of(df[t], n) for t in df}
    names = _literal([name for name, *_ in (*TEMPLATES, *WHOLES)])
    found = own.withColumn("best", best_licence(F.col("text"), idf, n, threshold))
    # Rows with enough rare words of licences keep their texts until they are compared as wholes.
    rare, least = rare_terms(whole_vectors(idf), df, n, threshold)
    enough = has_enough(F.col("text"), rare, least)
    found = stored(found.select("doc_id", "path", "best", F.when(enough, F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row")), "licence-sentences")
    whole = whole_licences(found.where("text is not null").select("row", "text"), idf, n, threshold, rare, least)
    found = found.join(whole.select("row", F.struct("score", "template").alias("whole")), "row", "left").withColumn("best", F.coalesce("whole", "best"))
    found = found.select("doc_id", "path", F.when(F.col("best").isNotNull(), F.element_at(names, 1 - F.col("best.template"))).alias("own_licence"), F.col("best.score").alias("score"), F.col("best.template").alias("template"), _parents(F.col("path")).alias("dir"))
    found = stored(found, "licences")

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    named = found.where(F.col("own_licence").isNotNull() & F.col("dir").isNotNull() & name.rlike(LICENCE_FILE))
    of_dir = named.groupBy("dir").agg(F.max(F.struct("score", "template", F.col("own_licence").alias("licence"))).alias("l")).select(F.col("dir").alias("above"), F.col("l.licence").alias("licence"))
    dirs = found.where("dir is not null").select("dir").distinct()
    steps = F.split("dir", "/", -1)
    chain = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    # The root comes first; the chain of an absolute path begins with it already.
    chain = F.array_distinct(F.concat(F.array(F.lit("")), chain))
    # A directory's chain is as long as its path is deep.
    inherited = dirs.select("dir", F.posexplode(chain).alias("depth", "above")).join(of_dir, "above")
    inherited = inherited.groupBy("dir").agg(F.max(F.struct("depth", "above", "licence")).alias("h")).select("dir", F.col("h.above").alias("above"), F.col("h.licence").alias("from_above"))
    out = found.join(inherited, "dir", "left")
    licence = F.coalesce("own_licence", "from_above")
    by = F.when(F.col("own_licence").isNotNull(), F.col("path")).otherwise(F.col("above"))
    return out.select("doc_id", "path", "own_licence", "score", licence.alias("licence"), by.alias("licensed_by"))


def as_files(docs: DataFrame) -> DataFrame:
    """documents laid out as a tree: source / thousands of ids / hundreds of ids / file.

    Ids divisible by 7 are named as licence files, those divisible by 49 one level higher.
    """
    i = F.col("doc_id")
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("k"), F.expr("doc_id div 2000").cast("string")))
    leaf = F.concat_ws("/", top, F.concat(F.lit("c"), F.expr("doc_id div 200").cast("string")))
    path = F.when(i % 49 == 0, F.concat(top, F.lit("/LICENSE-"), i, F.lit(".txt"))).when(i % 7 == 0, F.concat(leaf, F.lit("/LICENSE-"), i, F.lit(".txt"))).otherwise(F.concat(leaf, F.lit("/doc-"), i, F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(as_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))
