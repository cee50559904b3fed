import random
import zlib
from collections import Counter, defaultdict

from helpers import docs, store
from pyspark.sql import functions as F

from tidemark.llm import sharding as S


def check(rows, n):
    assert len(rows) == n
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(S.SHARDS))
    if n >= S.SHARDS:
        assert max(counts.values()) - min(counts[s] for s in range(S.SHARDS)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_query(spark, tmp_path):
    rnd = random.Random(6)
    sources = rnd.choices(["hot", "a", "b", None], [6, 2, 1, 1], k=1003)
    texts = [rnd.choice([None, "", "é", "text " * rnd.randint(1, 50)]) for _ in sources]
    sf = store(tmp_path, documents=docs(spark, texts, sources))
    rows = S.op9(spark, sf).collect()
    check(rows, 1003)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    # Every shard holds the sources in the proportions of the whole table, within a row a source.
    total = Counter(sources)
    per = Counter((r.shard, r.source) for r in rows)
    assert all(abs(per[s, k] - n / S.SHARDS) <= 2 for k, n in total.items() for s in range(S.SHARDS))
    # The order is that of the fractional ranks.
    place = {r.doc_id: (r.shard, r.slot) for r in rows}
    assert place == {r.doc_id: (r.shard, r.slot) for r in S.op9(spark, sf).collect()}
    assert S.op9(spark, store(tmp_path / "none", documents=docs(spark, []))).count() == 0


def test_all_documents(spark, sf_dir):
    check(S.op9(spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/documents.parquet").count())


def test_few_rows_repeated_rows_and_clashing_columns(spark):
    df = docs(spark, ["a", "b", "a"], ["x", None, "x"], ids=[1, 2, 1]).withColumn("h", F.lit(1)).withColumn("pos", F.lit("p")).withColumn("total", F.lit(0)).withColumn("row", F.lit(9))
    out = S.shard_documents(df)
    assert out.columns == [*df.columns, "shard", "slot"]
    check(out.collect(), 3)
    null_ids = S.shard_documents(spark.createDataFrame([(None, "t", "en", "s", 1)] * 30, "doc_id long, text string, lang string, source string, n_chars long"))
    check(null_ids.collect(), 30)
