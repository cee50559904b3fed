import random
from collections import defaultdict

import numpy as np
from helpers import docs, store
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import simhash as S


def print_of(text, shingle=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\f\r":
            words, now = words + [now] if now else words, ""
        else:
            now += c
    if not words:
        return 0
    k = min(shingle, len(words))
    hashes = [xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(texts):
    prints = {i: print_of(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def near_texts(seed=5):
    rnd = random.Random(seed)
    base = [" ".join(f"w{rnd.randrange(500)}" for _ in range(300)) for _ in range(12)]
    out = [None, "", " \t\n", "one", "One two", "one two three", "É é É", "rep " * 50, "x" * 5000]
    for b in base:
        out += [b, b.upper(), b + " tail", b.replace("w1", "v1", 1)]
    rnd.shuffle(out)
    return out


def test_query(spark, tmp_path):
    texts = near_texts()
    ids = [7 * i + 3 for i in range(len(texts))]
    sf = store(tmp_path, documents=docs(spark, texts, ids=ids))
    want = brute(dict(zip(ids, texts)))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in S.op5(spark, sf).collect()} == want
    # With a small cap, nodes are split level by level and no link is lost.
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in S.op5(spark, sf, node_cap=6).collect()} == want
    assert S.op5(spark, store(tmp_path / "none", documents=docs(spark, []))).count() == 0


def test_links_of_a_chain(spark):
    # Each print is three bits from the next: one component through all of them.
    prints, value = [], 0
    for i in range(20):
        prints.append(value)
        value ^= 7 << (3 * i)
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "id long")
    roots = {r.root for r in S.component_roots(rows).collect()}
    assert len(roots) == 1


def rank(print_):
    """Place in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        print_ ^= print_ >> shift
    return print_


def near_prints(rng, centres, n):
    return {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in rng.choice(centres, n)}


def test_index_connects_what_brute_force_connects():
    """Nodes of 1 to 900 rows in one batch; all links go through the index."""
    rng = np.random.default_rng(3)
    rows = []
    for node, (centres, n) in enumerate([(1, 1), (1, 2), (3, 9), (2, 17), (10, 100), (40, 900), (1, 300), (900, 900)]):
        rows += [(node, p) for p in sorted(near_prints(rng, rng.integers(0, 2**63, centres), n), key=rank)]
    node, prints = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64)
    hub, other = S._hubs(node, prints.view(np.int64), prints, 3)
    for k in range(8):
        mine = prints[node == k].tolist()
        every = [(a, b) for a in range(len(mine)) for b in range(a) if (mine[a] ^ mine[b]).bit_count() <= 3]
        known = set(np.array(mine, np.uint64).view(np.int64).tolist())
        place = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(mine)}
        got = [(place[a], place[b]) for a, b in zip(hub.tolist(), other.tolist()) if a in known and b in known]
        groups = lambda edges: {frozenset(g) for g in _groups(len(mine), edges)}
        assert groups(got) == groups(every)


def test_index_accumulates_differences_and_prunes(monkeypatch):
    """Far apart rows are dropped at upper nodes: few pairs of rows are ever compared."""
    rng = np.random.default_rng(5)
    prints = np.array(sorted(map(int, rng.integers(0, 2**63, 4000, dtype=np.uint64)), key=rank), np.uint64)
    compared = []
    children = S._Index._children

    def counting(self, level, a, b, known, counts):
        if level == 1:
            compared.append(int(counts.sum()))
        i, j, seen = children(self, level, a, b, known, counts)
        if level == 1:
            assert (seen == np.bitwise_count(self.prints[i] ^ self.prints[j])).all()
        return i, j, seen

    monkeypatch.setattr(S._Index, "_children", counting)
    S._Index(np.zeros(len(prints), np.int64), prints, 3).components()
    assert sum(compared) < 0.65 * len(prints) * (len(prints) - 1) / 2


def test_nodes_are_wide_and_the_index_prunes_them(spark):
    """Nodes of every width give the components of brute force; wide ones are pruned above the rows."""
    rng = np.random.default_rng(7)
    prints = sorted(near_prints(rng, rng.integers(0, 2**63, 2600), 3000))
    array = np.array(prints, np.uint64)
    edges = [(i, int(j)) for i in range(len(array)) for j in np.flatnonzero(np.bitwise_count(array[i] ^ array[i + 1 :]) <= 3) + i + 1]
    want = {frozenset(prints[i] for i in g) for g in _groups(len(prints), edges)}
    rows = spark.createDataFrame([(p,) for p in array.view(np.int64).tolist()], "id long").cache()
    for node_rows in (1, 40, 1024, 10**6):
        groups = defaultdict(set)
        for r in S.components(S.links(rows, node_rows=node_rows)).collect():
            groups[r.root].add(r.id % (1 << 64))
        assert {frozenset(g) for g in groups.values()} == {g for g in want if len(g) > 1}
    report = {r.level: (r.met, r.kept) for r in S.pruning(rows).collect()}
    every, levels = report.pop(-1)[0], len(report)
    assert every > 4_000_000 and levels >= 10
    # Few rows are compared, because nodes above them dropped theirs; all levels together meet few pairs too.
    assert report[0][0] < 0.02 * every and sum(met for met, _ in report.values()) < 0.25 * every
    assert all(report[level][1] < report[level][0] for level in range(6))
    assert report[0][1] <= len(edges) * 4
    assert S.name_bits(0) == S.name_bits(1500) == 0 and S.name_bits(9296) == 3


def test_large_group_of_near_copies_above_the_cap(spark):
    """50,000 distinct near copies of one fingerprint are one component, whatever the cap."""
    rng = np.random.default_rng(6)
    centre = int(rng.integers(0, 2**62))
    flips = [(a, b, c) for a in range(64) for b in range(a) for c in range(b)]
    prints = {centre, *(centre ^ 1 << a ^ 1 << b ^ 1 << c for a, b, c in flips[:50_000])}
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "id long")
    assert len({r.root for r in S.component_roots(rows, node_cap=4000).collect()}) == 1


def _groups(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for i in range(n):
        out[find(i)].add(i)
    return out.values()


def test_all_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in S.op5(spark, sf_dir).collect()} == brute(texts)


def test_drops_near_copies_only(spark):
    rnd = random.Random(1)
    fresh = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n))
    originals = [fresh(n) for n in (40, 200, 1000, 200)]
    near = []
    for t in originals[:3]:
        words = t.split()
        words[len(words) // 2] = "changed" if len(words) > 100 else words[len(words) // 2]
        near.append(" ".join(words))
    texts = [None, "", *originals, *near, originals[3], None]
    df = docs(spark, texts).withColumn("root", F.lit(1)).withColumn("row", F.lit("x")).withColumn("prints", F.lit(2))
    kept = S.drop_near_duplicates(df.union(df.where("doc_id = 3")))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 5]
    assert S.drop_near_duplicates(docs(spark, [])).count() == 0
