import random

import pytest
from helpers import docs, store
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_names():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark_leaks", "mixture", "shards"]


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert out.columns == [*before.columns, "shard", "slot"]
    rows = out.select("doc_id", "text", "shard", "slot").collect()
    known = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    assert rows and all(known[r.doc_id] == r.text for r in rows)
    bench = [" ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [" ".join((r.text or "").lower().split()) for r in rows]
    assert not any(b in t for b in bench if len(b) >= 25 for t in kept)
    sizes = [n for (n,) in out.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("n").collect()]
    assert max(sizes) - min(sizes) <= 1


def test_planted_cases(spark, tmp_path):
    rnd = random.Random(4)
    fresh = lambda n=120: " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n))
    item = fresh(20)
    texts = [fresh() for _ in range(60)]
    twin, near, leak = texts[3], texts[4].replace(texts[4].split()[60], "changed"), fresh(30) + " " + item + " " + fresh(30)
    texts += [twin, near, leak, None, ""]
    df = docs(spark, texts)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sf = store(tmp_path, documents=df, labels=labels, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    now = df.withColumn("shard", F.lit("s")).withColumn("copies", F.lit(2))
    for name, stage in pipeline.STAGES[:3]:
        now = stage(spark, now, sf)
        assert now.columns == [*df.columns, "shard", "copies"], name
    # Null and empty texts are copies of each other, so one of them stays.
    assert sorted(r.doc_id for r in now.collect()) == [*range(60), 63]


def test_empty_table(spark, tmp_path):
    none = docs(spark, [])
    sf = store(tmp_path, documents=none, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert pipeline.run(spark, sf).count() == 0
