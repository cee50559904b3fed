"""Manifests against a trie built in plain Python."""

import hashlib
import zlib

import pytest
from helpers import docs, store
from pyspark.sql import functions as F

from tidemark.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(leaves, n=8):
    """Root, and for each leaf the (left, right) siblings up to it."""
    steps, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for x, i in enumerate(at):
            run = level[i // n * n : i // n * n + n]
            steps[x].append(("".join(run[: i % n]), "".join(run[i % n + 1 :])))
        level, at = [H(*level[i : i + n]) for i in range(0, len(level), n)], [i // n for i in at]
    return level[0], steps


def plain(rows):
    """What op13 returns for rows of (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    tries = {g: climb([leaf(r) for r in sorted(by[g], key=lambda r: ((r[0] is not None, r[0] or 0), leaf(r)))]) for g in langs}
    root, above = climb([tries[g][0] for g in langs])
    out = []
    for g, more in zip(langs, above):
        for r, own in zip(sorted(by[g], key=lambda r: ((r[0] is not None, r[0] or 0), leaf(r))), tries[g][1]):
            steps = own + more
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            acc = leaf((*r[:4], text))
            for a, b in steps:
                acc = H(a, acc, b)
            out.append((r[0], leaf(r), tries[g][0], root, H(*[a + b for a, b in steps]), acc, acc == root))
    return out


def run(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit(1)).withColumn("root", F.lit(2)).repartition(3)
    return [tuple(r) for r in merkle.op13(spark, store(tmp_path, documents=df)).collect()]


def key(r):
    return str(r[0]), r[1], r[4]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_sizes(spark, tmp_path, n):
    rows = [(i * 7 - 300, "s", "en", i, f"Text {i}") for i in range(n)]
    assert sorted(run(spark, tmp_path, rows), key=key) == sorted(plain(rows), key=key)


def test_odd_rows(spark, tmp_path):
    rows = [
        (-(1 << 63), None, None, None, None), ((1 << 63) - 1, "a", None, 3, "É:-"), (None, "a", "en", 1, "X"), (None, "b", "en", 1, "X"), (0, "a", "", 0, ""),
        (5, "a", "de", 1, "A" * 300_000), *[(7, "a", "fr", 1, "same")] * 40, *[(7, f"{i}", "fr", 1, "other") for i in range(30)], *[(i, "é", "zh", None, "Q") for i in range(100)],
        (3, "a", "zzz", 1, "lone"), (4, "a", "éé", 1, "lone too"),
    ]
    got, want = run(spark, tmp_path, rows), plain(rows)
    # Equal rows are interchangeable: their proofs are the same set.
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


@pytest.mark.parametrize("most", [4, 50])
def test_ranks_of_clustered_and_repeated_keys(spark, most):
    ids = [*range(500), *[10**12 + i * 10**6 for i in range(50)], *[77] * 120, *[-(10**15) - i for i in range(30)]]
    rows = spark.createDataFrame([("ab"[i % 2], v, i) for i, v in enumerate(ids)], "g string, id long, n long").checkpoint()
    full = F.concat(merkle.digits(F.col("id"), "bigint"), F.lpad(F.hex("n"), 16, "0"))
    got = {r.n: r["rank"] for r in merkle.radix_ranks(rows, full, most).collect()}
    want = {}
    for g in range(2):
        want |= {n: k for k, (_, n) in enumerate(sorted((v, i) for i, v in enumerate(ids) if i % 2 == g))}
    assert got == want


def test_any_change_breaks_the_root(spark):
    rows = docs(spark, [f"text {i}" for i in range(100)])
    found = merkle.manifest(rows, "doc_id", "lang", merkle.leaf(text=F.col("text"))).withColumn("ok", merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).withColumn("bad", merkle.fold(F.sha2(F.lit("x"), 256), F.col("steps")) == F.col("root"))
    assert {(r.ok, r.bad) for r in found.collect()} == {(True, False)}
