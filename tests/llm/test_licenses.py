import re

from helpers import docs, store

from tidemark.llm import licenses as L
from tidemark.llm.license_rules import rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = WORD.findall(lower(text))
    found = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    None, "", "   ", "nothing here", "MIT License", "mit license mit licence mit-license", "the GNU General Public License, version 2 or later",
    "gnu general public license gnu general public license", "Licensed under the Apache License, Version 2.0", "cc by cc by-sa 4.0", "CC-BY-NC-ND 3.0 and cc", "x" * 100_000 + " mit license",
    "apachelicense mit licenses", "É mit license É", "SPDX-License-Identifier: GPL-3.0-only", "word " * 30_000 + "cc by", "licence", "GNU GENERAL\nPUBLIC\tLICENSE",
]


def check(rows, texts):
    for i, t in texts.items():
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), (i, t and t[:80])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1


def test_query(spark, tmp_path):
    sf = store(tmp_path, documents=docs(spark, TEXTS))
    rows = {r.doc_id: r for r in L.op2(spark, sf).collect()}
    check(rows, dict(enumerate(TEXTS)))
    assert rows[6].labels == "gpl,gpl-2"
    assert rows[8].labels == "apache,apache-2.0"
    assert rows[14].labels == "gpl-3.0" and rows[14].score == 1.0
    assert rows[10].labels == "cc-by,cc-by-nc-nd-3.0"
    assert L.op2(spark, store(tmp_path / "none", documents=docs(spark, []))).count() == 0


def test_all_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check({r.doc_id: r for r in L.op2(spark, sf_dir).collect()}, texts)


def test_suppression_by_priority(spark):
    """A detection that only overlaps suppressed ones stays; brute force on random intervals."""
    import random

    from pyspark.sql import functions as F

    def best(found):
        kept = []
        for d in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[0], d[3])):
            if all(d[1] <= k[0] or k[1] <= d[0] for k in kept):
                kept.append(d)
        return sorted(kept)

    rnd = random.Random(3)
    cases = [[(0, 5, 1, "a", 1.0), (3, 10, 5, "b", 1.0), (6, 9, 1, "c", 1.0)], [], [(0, 9, 2, "a", 1.0), (1, 3, 1, "b", 1.0), (4, 6, 1, "c", 1.0)]]
    for _ in range(60):
        starts = [(rnd.randrange(60), rnd.randint(1, 9), rnd.randint(1, 4), rnd.choice("abc")) for _ in range(rnd.randint(1, 200))]
        cases.append([(a, a + n, p, x, 1.0) for a, n, p, x in starts])
    cases.append([(i * 3, i * 3 + 2, 1 + i % 3, "x", 1.0) for i in range(20_000)])
    df = spark.createDataFrame([(i, [*c, *c[:3]]) for i, c in enumerate(cases)], f"i int, found array<{L._DETECTION}>")
    rows = {r.i: [tuple(d) for d in r.kept] for r in df.select("i", L.surviving(L.distinct_sorted(F.col("found"))).alias("kept")).collect()}
    for i, c in enumerate(cases):
        assert rows[i] == best(set(c)), i


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = docs(spark, ["MIT License", None]).withColumn("words", F.lit(1)).withColumn("found", F.lit("f")).withColumn("labels", F.lit(0)).withColumn("whole", F.lit(2))
    rows = L.scan(df).collect()
    assert [r.labels for r in rows] == ["mit", ""] and {(r.words, r.found, r.whole) for r in rows} == {(1, "f", 2)}
    assert L.scan(df).columns == ["doc_id", "text", "lang", "source", "n_chars", "words", "found", "whole", *L.RESULTS]


def test_rules():
    listed = rules()
    assert len(listed) >= 300
    for r in listed:
        assert re.compile(r.pattern) and r.gate.isalnum() and 0 < r.confidence <= 1


def alternatives(pattern):
    """All strings that a pattern of words, optional parts and alternatives matches, in part or whole."""
    from itertools import product
    from re import _parser

    def expand(items):
        parts = []
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                parts.append([chr(arg)])
            elif op == "SUBPATTERN":
                parts.append(expand(arg[3]))
            elif op == "BRANCH":
                parts.append([x for b in arg[1] for x in expand(b)])
            elif op == "MAX_REPEAT":
                parts.append([""] * (arg[0] == 0) + expand(arg[2]))
            elif op == "IN":
                parts.append(["0"] if str(arg[0][0]) != "LITERAL" else [chr(c) for _, c in arg])
            else:
                parts.append([""])
        return ["".join(p) for p in product(*parts)]

    return expand(_parser.parse(pattern))


def test_every_alternative_passes_its_own_hint():
    for r in rules():
        assert not [a for a in alternatives(r.pattern) if r.hint not in a], r


def test_every_rule_finds_a_text_of_its_own(spark):
    """For each rule the shortest text of its pattern: its label is found, or one of a better rule that covers it."""
    listed = rules()
    texts = [min((a for a in alternatives(r.pattern)), key=len).replace("@", " ") for r in listed]
    rows = {r.doc_id: r for r in L.scan(docs(spark, texts)).collect()}
    for i, r in enumerate(listed):
        assert rows[i].labels and rows[i].n_detections >= 1, (r, texts[i])
    assert sum(r.label in rows[i].labels.split(",") for i, r in enumerate(listed)) >= 0.9 * len(listed)


def test_expat_and_x11(spark, tmp_path):
    from helpers import store as stored

    texts = ["This is the Expat License", "X11 License", "licensed under the Expat license"]
    rows = L.op2(spark, stored(tmp_path, documents=docs(spark, texts))).collect()
    assert {r.labels for r in rows} == {"mit"}
