import random

import numpy as np
import pytest
from helpers import docs, store
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T

BAD = ["blasted", "rotten", "wretched"]


def sample(n=400, seed=2):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choices("aeioulnrst", k=rnd.randint(3, 8))) for _ in range(200)]
    texts, labels = [], []
    for _ in range(n):
        words = rnd.choices(plain, k=rnd.randint(10, 80))
        y = int(rnd.random() < 0.3)
        if y:
            for _ in range(max(2, len(words) // 15)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        texts.append(" ".join(words))
        labels.append(y)
    return plain, texts, labels


def test_bags_share_grams_with_misspellings():
    bags = lambda w: set(T.bags([w])[0].tolist())
    near, far = bags("rotten") & bags("rottenn"), bags("rotten") & bags("blasted")
    assert len(near) > len(bags("rotten")) / 2 and len(far) < 3
    buckets, sizes = T.bags(["rotten", "a", "rotten"])
    assert sizes.sum() == len(buckets) and buckets[: sizes[0]].tolist() == buckets[-sizes[2] :].tolist()
    assert [x.tolist() for x in T.bags([])] == [[], []]


def test_learns_and_carries_over_to_misspellings():
    plain, texts, labels = sample()
    scores, bias = T.fit(texts[:300], labels[:300])
    held = T.score_texts(texts[300:], scores, bias)
    assert np.mean((held >= 0.5) == np.array(labels[300:])) >= 0.95
    clean = " ".join(plain[:30])
    seen, misspelt = T.score_texts([clean, f"{clean} rottenn wretchedd blassted"], scores, bias)
    assert misspelt > seen + 0.3
    empty = T.score_texts([None, "", "..."], scores, bias)
    assert len(set(empty.tolist())) == 1 and 0 < empty[0] < 0.5


def test_without_both_labels_the_score_is_the_share():
    scores, bias = T.fit(["a", "b"], [0, 0])
    assert T.score_texts(["a", None], scores, bias) == pytest.approx([0.25, 0.25])
    scores, bias = T.fit([], [])
    assert T.score_texts(["a"], scores, bias) == pytest.approx([0.5])


def test_query_and_stage(spark, tmp_path):
    _, texts, labels = sample(900)
    texts += [None, "", "word " * 50_000]
    df = docs(spark, texts)
    table = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(9999, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    sf = store(tmp_path, documents=df, labels=table)
    rows = {r.doc_id: r for r in T.op3(spark, sf).collect()}
    import zlib

    assert set(rows) == set(range(len(texts)))
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [i for i in range(len(labels)) if rows[i].held_out]
    assert np.mean([rows[i].predicted == labels[i] for i in held]) >= 0.9
    clash = df.withColumn("toxic", F.lit(1)).withColumn("row", F.lit(0)).withColumn("score", F.lit(0.0))
    kept = T.drop_toxic(clash, T.train(clash, table))
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in rows.items() if r.score < 0.7)
    none = docs(spark, [])
    assert T.drop_toxic(none, T.train(none, table)).count() == 0


def test_held_out_accuracy(spark):
    """On the driver's tables, the model ranks held-out labels well."""
    sf = "/root/testdata/sf0.01"
    scored = T.op3(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "toxic").toPandas()
    ranks = scored["score"].rank()
    n1, n0 = (scored["toxic"] == 1).sum(), (scored["toxic"] == 0).sum()
    assert (ranks[scored["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.7
