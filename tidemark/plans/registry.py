"""Names, Spark plans and SQL twins of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, ctes: str = "", sql: str | None = None) -> Callable:
    """Register ``f(tables)``; ``sql`` is its twin over the named CTEs."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(ctes, sql) if ctes else sql
        return f

    return add


def r6(column: str | Column, name: str | None = None) -> Column:
    """Rounded for comparison between engines."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c.cast("double"), 6) + 0.0
    return out.alias(name or column) if name or isinstance(column, str) else out


def all_r6(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c) if t == "double" else F.col(c) for c, t in df.dtypes])
