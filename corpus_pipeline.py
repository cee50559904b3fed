"""Training-data pipeline: toxicity, near-duplicates, benchmark leaks, source mixture, shards.

Every stage takes the documents that its predecessor left and, but for the last, returns
documents in the same columns. In ``run`` each stage's result is written as Parquet to the
folder that ``spark.checkpoint.dir`` names and read again by the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import documents, shared_folder
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.mixing import mix_documents
from tidemark.llm.sharding import shard_documents
from tidemark.llm.simhash import drop_near_duplicates
from tidemark.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the model learns from the labelled ones outside the held-out fold."""
    return drop_toxic(docs, train(docs, documents(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, even with a tenth of it edited."""
    return drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
    ("shards", shards),
]

#: Trained scores and fingerprints are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's file system has it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's stored result goes once the next one is stored; the last is read by the result."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, stored = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if stored:
            removed(spark, stored)
        stored = path
    return STAGES[-1][1](spark, docs, sf_dir)
