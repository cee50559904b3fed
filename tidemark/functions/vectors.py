"""Vector expressions over ``ARRAY<DOUBLE>`` columns, and the long form of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def unit_vector(x: Column) -> Column:
    """The vector at length 1; one without length stays as it is."""
    n = norm(x)
    return F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; NaN where either column is constant, null without rows."""
    a, b = (F.when(x.isNotNull() & y.isNotNull(), x.cast("double")) for x, y in ((a, b), (b, a)))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) > 0, F.coalesce(r, F.lit(float("nan"))))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, x))


def long_form(nodes: DataFrame, key: str = "node_id", x: str = "x") -> DataFrame:
    """``(key, dim, val)``, one row per component."""
    return nodes.select(key, F.posexplode(x).alias("dim", "val"))


def wide_form(long: DataFrame, key: str = "node_id", x: str = "x") -> DataFrame:
    """One array per key again, in order of dimension."""
    pairs = F.array_sort(F.collect_list(F.struct("dim", "val")))
    return long.groupBy(key).agg(F.transform(pairs, lambda p: p["val"]).alias(x))


def mean_vector(nodes: DataFrame, x: str = "x") -> DataFrame:
    """One row ``mu``: the mean of all vectors, by partial sums per dimension."""
    means = nodes.select(F.posexplode(x).alias("dim", "val")).groupBy("dim").agg(F.avg("val").alias("val"))
    pairs = F.array_sort(F.collect_list(F.struct("dim", "val")))
    return means.agg(F.transform(pairs, lambda p: p["val"]).alias("mu"))


def hash_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts: the same on every run and engine."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
