import random

import numpy as np
import pytest
from helpers import docs

from tidemark.llm import jaccard as J
from tidemark.llm import simhash as S


def shingles(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(texts):
    """Smallest ids of the components of similar texts."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(i for i in texts if find(i) == i)


def fresh(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n))


def edited(rnd, text, times):
    words = text.split()
    for i in rnd.sample(range(len(words)), times):
        words[i] = fresh(rnd, 1)
    return " ".join(words)


def kept(df, **blocks):
    return sorted(r.doc_id for r in S.drop_near_duplicates(df, **blocks).collect())


def test_repeated_boilerplate_links_nothing(spark):
    rnd = random.Random(2)
    line = fresh(rnd, 12)
    texts = [fresh(rnd, 300) + (" " + line) * 30 for _ in range(12)]
    assert kept(docs(spark, texts)) == list(range(12)) == brute(dict(enumerate(texts)))


def test_pairs_at_the_threshold(spark):
    """Every pair of similarity 0.80 is found, and none below it."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefghij", k=8))
    texts = []
    for _ in range(60):
        # 400 shingles in common and 50 in each text alone: 400 / 500; with one more alone 400 / 501.
        common = [word() for _ in range(404)]
        for more in (50, 50), (50, 51):
            texts += [" ".join([f"{c}{len(texts)}" for c in common] + [word() for _ in range(m)]) for m in more]
            texts[-1] = " ".join(texts[-2].split()[:404] + texts[-1].split()[404:])
    same = {i: len(shingles(texts[i]) & shingles(texts[i + 1])) for i in range(0, len(texts), 2)}
    assert set(same.values()) == {400}
    assert kept(docs(spark, texts)) == sorted([*range(0, len(texts), 2), *range(3, len(texts), 4)])


def test_blocks_change_nothing(spark):
    """Near copies, chains of them, template texts and short texts, in blocks of any size."""
    rnd = random.Random(9)
    texts = [None, "", " \n", "one", "One", "one two", "one two three four five six"]
    for n in (30, 200):
        base = fresh(rnd, n)
        for _ in range(25):
            base = edited(rnd, base, max(1, n // 60))
            texts.append(base)
        template = fresh(rnd, n)
        texts += [edited(rnd, template, rnd.randint(0, max(1, n // 30))) for _ in range(40)]
    want = brute(dict(enumerate(texts)))
    df = docs(spark, texts)
    assert kept(df) == want and 10 < len(want) < len(texts) - 10
    assert kept(df, block_sets=3) == want
    assert kept(df, block_shingles=500) == want


@pytest.mark.parametrize("n", range(1, 60))
def test_prefix_holds_a_shared_shingle(n):
    least = next(k for k in range(n + 1) if 5 * k >= 4 * n)
    assert J.prefix_length(n) == n - least + 1 == J.prefix_length(np.int64(n))


def test_fingerprints_propose_and_the_rest_is_exact(spark, monkeypatch):
    """Near copies go through the index and are not searched again; pairs that it misses and chance links end as they must."""
    rnd = random.Random(5)
    line = fresh(rnd, 12)
    texts = []
    for _ in range(8):
        base = fresh(rnd, 400)
        texts += [base, edited(rnd, base, 1)]  # a few bits apart
    for _ in range(12):
        base = fresh(rnd, 200)
        texts += [base + " " + fresh(rnd, 24), base + " " + fresh(rnd, 23)]  # similarity 0.81, beyond the radius
    texts += [fresh(rnd, 20) + (" " + line) * 30 for _ in range(6)]
    prints = [S.majority(J.shingle_set(t, 5).view(np.uint64)) for t in texts]
    apart = [(prints[i] ^ prints[i + 1]).bit_count() for i in range(0, 40, 2)]
    shown = [i for i in range(0, 40, 2) if apart[i // 2] <= S.RADIUS]
    assert 0 < len(shown) < 20
    searched, proposed = [], []
    links, candidates = S.links, J.candidates

    def spied_links(found, *args):
        searched.extend(r.id for r in found.collect())
        return links(found, *args)

    def spied_candidates(*args):
        out = candidates(*args)
        proposed.extend(out.collect())
        return out

    monkeypatch.setattr(S, "links", spied_links)
    monkeypatch.setattr(J, "candidates", spied_candidates)
    assert kept(docs(spark, texts)) == brute(dict(enumerate(texts)))
    assert sorted(x % 2**64 for x in searched) == sorted(set(prints))
    assert len(proposed) >= 20 - len(shown)
    ids = dict(docs(spark, texts).selectExpr("doc_id", "xxhash64(text)").collect())
    again = {frozenset(r) for r in proposed}
    assert not any(frozenset((ids[i], ids[i + 1])) in again for i in shown)


def test_classes_are_not_compared_again():
    ids, sets = np.array([5, 3, 9]), [np.arange(10), np.arange(100, 110), np.arange(9)]
    assert J.group_links(ids, ids, sets)[1].tolist() == [9]
    hub, other = J.group_links(ids, np.array([3, 3, 9]), sets)
    assert sorted(zip(hub.tolist(), other.tolist())) == [(3, 5), (3, 9)]


@pytest.mark.parametrize("sizes", [{}, {"packed_rows": 700, "part_rows": 300}])
def test_only_sets_that_others_hold_go_on(spark, sizes):
    """Four fifths of the shingles must be met elsewhere, in one text or in several; texts without words never go on."""
    rnd = random.Random(3)
    texts = ["", fresh(rnd, 1), *(fresh(rnd, 150) for _ in range(20))]
    base, other = fresh(rnd, 200), fresh(rnd, 200)
    words = base.split()
    texts += [base, " ".join(words[:165]) + " " + fresh(rnd, 35)]  # 161 of 196
    texts += [other, " ".join(other.split()[:155]) + " " + fresh(rnd, 45)]  # 151 of 196
    texts += [fresh(rnd, 100) + " " + " ".join(words[:80])]
    sets = [shingles(t) for t in texts]
    want = [i for i, s in enumerate(sets) if s and 5 * sum(any(x in o for o in sets if o is not s) for x in s) >= 4 * len(s)]
    assert want == [22, 23]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    n = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "id long, n long")
    out = J.promising(df, n, 5, **sizes)
    assert out.columns == ["id", "n"] and sorted(r.id for r in out.collect()) == want
    none = J.promising(df.where("id < 0"), n.where("id < 0"), 5, **sizes)
    assert none.count() == 0


def test_sieve_keeps_all(spark):
    """All wanted ids pass, of others few, and rows of none but wanted ids are read when there are no ids."""
    df = spark.range(20000).selectExpr("xxhash64(id) AS id", "id AS n")
    some = df.where("n % 100 = 0").select("id")
    out = {r.n for r in J.sieved(df, some).collect()}
    assert out >= set(range(0, 20000, 100)) and len(out) < 800
    assert J.sieved(df, some, 6).count() == 20000 and J.sieved(df, some.limit(0)).count() == 0


def test_shuffle_of_texts_that_have_no_copy(spark):
    """The whole stage moves less than twice the texts: shingles go packed, and texts once."""
    rnd = random.Random(8)
    texts = [fresh(rnd, 400) for _ in range(1500)]
    df = docs(spark, texts).localCheckpoint()
    before = shuffled(spark)
    assert kept(df) == list(range(1500))
    assert shuffled(spark) - before < 2 * sum(map(len, texts))


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    jvm, context = spark._jvm, spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    quantiles = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, quantiles, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
