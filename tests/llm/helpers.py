"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, texts: list, sources: list | None = None, ids: list | None = None) -> DataFrame:
    rows = [
        ((i if ids is None else ids[i]), t, "en", ("web" if sources is None else sources[i]), None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def store(tmp_path, **tables: DataFrame) -> str:
    """A folder of tables as the queries read it."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
