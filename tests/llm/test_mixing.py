import random
from collections import defaultdict

import pytest
from helpers import docs, store
from pyspark.sql import functions as F

from tidemark.llm import mixing as M
from tidemark.llm.sharding import SHARDS


def level(sizes):
    """Targets by repeated capping: sources in order, weights 1, 2, 3 repeating, at most three times a source."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rate = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * rate >= 3 * sizes[s]]
        if not over:
            return {s: float(capped[s]) if s in capped else weight[s] * rate for s in names}
        capped |= {s: 3 * sizes[s] for s in over}


def check(rows, texts):
    """texts: doc_id to (source, text). Returns rows by source."""
    sizes = defaultdict(int)
    for source, text in texts.values():
        sizes[source] += len([w for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]) if text and "\n" not in text else len((text or "").split())
    want = level(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(rows) == len(texts)
    block = max(1, -(-sum(sizes.values()) // M.BLOCKS))
    won = apportioned(want, sum(sizes.values()), block)
    for s, t in want.items():
        assert taken[s] == min(won[s] * block, 3 * sizes[s])
        assert abs(taken[s] - t) <= 1.5 * block
    return want


def apportioned(goals, words, block):
    """Blocks won by each source, one after the other by the highest quotient."""
    won = dict.fromkeys(goals, 0)
    order = sorted((s for s in goals if s is not None)) + [None] * (None in goals)
    for _ in range((2 * words + block) // (2 * block)):
        best = max((s for s in order if goals[s] > 0), key=lambda s: (goals[s] / (2 * won[s] + 1), -order.index(s)))
        won[best] += 1
    return won


def test_query(spark, tmp_path):
    rnd = random.Random(3)
    names = ["a", "b", "Z", "é", None, "empty", "tiny"]
    many = [0.5, 0.2, 0.1, 0.1, 0.08, 0.0, 0.02]
    sources = rnd.choices(names, many, k=400) + ["empty"] * 3
    texts = [" ".join(["w"] * rnd.choice([0, 1, 5, 50, 2000])) for _ in range(400)] + ["", None, "  "]
    sf = store(tmp_path, documents=docs(spark, texts, sources))
    rows = M.op8(spark, sf).collect()
    want = check(rows, dict(enumerate(zip(sources, texts))))
    assert want["empty"] == 0.0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.op8(spark, sf).collect())) if None not in sources else True
    again = {r.doc_id: r.taken for r in M.op8(spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert M.op8(spark, store(tmp_path / "none", documents=docs(spark, []))).count() == 0


def test_caps_are_reshared(spark, tmp_path):
    texts = {0: ("a", "w " * 1000), 1: ("b", "w " * 10), 2: ("c", "w " * 5), 3: ("d", "w")}
    sf = store(tmp_path, documents=docs(spark, [t for _, t in texts.values()], [s for s, _ in texts.values()]))
    want = check(M.op8(spark, sf).collect(), texts)
    assert want == {"a": 1016.0 - 30 - 15 - 3, "b": 30.0, "c": 15.0, "d": 3.0}


def test_quotas_are_those_of_highest_quotients(spark):
    rnd = random.Random(8)
    sources = rnd.choices("abcd", [5, 3, 1, 1], k=300)
    df = docs(spark, ["w " * rnd.randint(1, 90) for _ in sources], sources)
    targets = M.targets(df.select("source", M.count_words().alias("size")))
    got = {(r["shard"], r["source"]): r["blocks"] for r in M.quotas(targets).collect()}
    goals = {r.source: r for r in targets.collect()}
    one = next(iter(goals.values()))
    seats = (2 * one.all_words + one.block) // (2 * one.block)
    best = sorted(((-g.target / (2 * k + 1), s, k) for s, g in goals.items() for k in range(seats)))[:seats]
    want = defaultdict(int)
    for i, (_, s, _) in enumerate(best):
        want[i * SHARDS // seats, s] += 1
    assert got == dict(want)


def test_many_small_sources_win_nothing_and_a_large_one_all(spark):
    """A source worth 1,000 seats beside 1,000 sources worth 0.49 each: highest quotients give the large one far more than its quota."""
    rows = [("big", 1000.0)] + [(f"s{i:04d}", 0.49) for i in range(1000)]
    goals = spark.createDataFrame(rows, "source string, target double").withColumn("all_words", F.lit(1490).cast("long")).withColumn("block", F.lit(1).cast("long"))
    got = {r["source"]: r["n"] for r in M.seats(goals).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got == {s: n for s, n in apportioned(dict(rows), 1490, 1).items() if n} and got["big"] == 1020 and sum(got.values()) == 1490


def test_shards_take_their_quotas(spark):
    rnd = random.Random(4)
    sources = rnd.choices("abc", [6, 3, 1], k=300)
    df = docs(spark, ["w " * rnd.randint(0, 90) for _ in sources], sources)
    rows = M.durable(df.select("doc_id", "source", M.count_words().alias("size")))
    want, reach, most = {}, defaultdict(int), {r["source"]: 3 * r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    for r in sorted(M.quotas(M.targets(rows.select("source", "size"), blocks=300)).collect()):
        before = min(most[r.source], reach[r.source])
        reach[r.source] += r.words
        want[r.source, r["shard"]] = min(most[r.source], reach[r.source]) - before
    got = defaultdict(int)
    for r in M.mix(rows, blocks=300).collect():
        assert r.taken == sum(r.by_shard) <= 3 * r.size
        for h, n in enumerate(r.by_shard):
            got[r.source, h] += n
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n} and len({h for _, h in want}) == SHARDS


def test_larger_blocks_decide_what_is_taken(spark):
    """With twenty blocks for all words, the words taken are whole blocks and differ from the targets."""
    rnd = random.Random(12)
    sources = rnd.choices("abcde", [9, 4, 3, 2, 2], k=200)
    df = docs(spark, ["w " * rnd.randint(1, 90) for _ in sources], sources)
    rows = M.durable(df.select("doc_id", "source", M.count_words().alias("size")))
    taken, goals, words = defaultdict(int), {}, 0
    for r in M.mix(rows, blocks=20).collect():
        taken[r.source] += r.taken
        goals[r.source] = r.target
        words += r.size
        assert 0 <= r.taken <= 3 * r.size
    block = -(-words // 20)
    assert dict(taken) == {s: n * block for s, n in apportioned(goals, words, block).items()}
    assert any(abs(taken[s] - goals[s]) > 1 for s in goals)


def test_stage_keeps_columns_and_comes_near_the_targets(spark):
    rnd = random.Random(5)
    sources = rnd.choices(["a", "b", None], [6, 3, 1], k=500)
    df = docs(spark, ["w " * rnd.randint(1, 60) for _ in sources] , sources).withColumn("size", F.lit("s")).withColumn("copy", F.lit(1)).withColumn("h", F.lit(2))
    df = df.union(docs(spark, ["", None], ["a", "b"], ids=[900, 901]).withColumn("size", F.lit("s")).withColumn("copy", F.lit(1)).withColumn("h", F.lit(2)))
    mixed = M.mix_documents(df)
    assert mixed.columns == df.columns
    words = lambda d: {r["source"]: r["n"] for r in d.groupBy("source").agg(F.sum(M.count_words()).alias("n")).collect()}
    want = level(words(df))
    for s, n in words(mixed).items():
        assert abs(n - want[s]) <= 0.05 * want[s] + 120
    assert mixed.where("doc_id >= 900").count() == 2
