"""Node preparation: splits, novelty, standardisation and moment alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_DIGITS = 3  # hexadecimal digits of the hash that deal rows to ranges


def smallest_groups(rows: DataFrame, group: str, m: int) -> DataFrame:
    """The ``m`` groups of fewest rows, by count and then value."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy("n", group).limit(m).select(group)


def hash_rank(rows: DataFrame, key: str, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``rn`` (from 1) in order of the seeded MD5 of ``key``, and the number of rows ``n``.

    The hash's leading digits deal rows to ranges, so no task ranks all of them.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))).withColumn("_r", F.substring("_h", 1, RANGE_DIGITS))
    per_range = hashed.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    offsets = per_range.select(*by, "_r", (F.sum("_c").over(group.orderBy("_r")) - F.col("_c")).alias("_o"), F.sum("_c").over(group).alias("n"))
    within = Window.partitionBy(*by, "_r").orderBy("_h", key)
    return hashed.join(offsets, [*by, "_r"]).withColumn("rn", F.row_number().over(within) + F.col("_o")).drop("_h", "_r", "_o")


def split_nodes(nodes: DataFrame, train: float = 0.4, cal: float = 0.2, n_novel: int = 2, seed: int = 42) -> DataFrame:
    """Add ``is_novel`` and ``split``: the smallest normal clusters are novel and only ever tested."""
    novel = smallest_groups(nodes.where("y = 0"), "cluster", n_novel).withColumn("is_novel", F.lit(True))
    marked = nodes.join(F.broadcast(novel), "cluster", "left").withColumn("is_novel", F.coalesce("is_novel", F.lit(False)))
    ranked = hash_rank(marked.where("NOT is_novel").select("node_id"), "node_id", seed)
    a, b = F.floor(train * F.col("n")), F.floor(cal * F.col("n"))
    placed = ranked.select("node_id", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "cal").otherwise("test").alias("split"))
    return marked.join(placed, "node_id", "left").withColumn("split", F.coalesce("split", F.lit("test")))


def stratified_sample(nodes: DataFrame, size: int, label: str = "y", seed: int = 42) -> DataFrame:
    """A sample of fixed size that keeps the share of label 1, one of them at least."""
    totals = nodes.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    want1 = F.greatest(F.lit(1), F.floor(size * F.col("_p") / F.col("_n")))
    want = F.when(F.col(label) == 1, want1).otherwise(size - want1)
    return hash_rank(nodes, "node_id", seed, (label,)).crossJoin(F.broadcast(totals)).where(F.col("rn") <= want).drop("rn", "n", "_n", "_p")


def moments(long: DataFrame, std: str = "stddev_pop") -> DataFrame:
    return long.groupBy("dim").agg(F.avg("val").alias("mean"), getattr(F, std)("val").alias("std"))


def standardised(long: DataFrame) -> DataFrame:
    """Long-form z-scores per dimension; a constant dimension is divided by 1."""
    m = moments(long)
    return long.join(F.broadcast(m), "dim").select("node_id", "dim", ((F.col("val") - F.col("mean")) / F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))).alias("val"))


def aligned(long: DataFrame, source: DataFrame, target: DataFrame, std: str = "stddev_samp", floor: float = 1e-6) -> DataFrame:
    """``long`` brought from the moments of ``source`` to those of ``target``, per dimension."""
    a, b = moments(source, std), moments(target, std)
    both = a.join(b.withColumnsRenamed({"mean": "t_mean", "std": "t_std"}), "dim")
    low = lambda c: F.greatest(F.col(c), F.lit(floor))
    return long.join(F.broadcast(both), "dim").select("node_id", "dim", ((F.col("val") - F.col("mean")) / low("std") * low("t_std") + F.col("t_mean")).alias("val"))


def min_max(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``value`` scaled to [0, 1]; a constant becomes 0."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return rows.crossJoin(F.broadcast(ends)).withColumn(name, scaled).drop("_lo", "_hi")


def batches(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Add ``batch`` from 1: equal parts in hash order, the first ones a row longer."""
    ranked = hash_rank(rows, key, seed)
    small, extra = F.floor(F.col("n") / n), F.col("n") % n
    cut = extra * (small + 1)
    batch = F.when(F.col("rn") <= cut, F.floor((F.col("rn") - 1) / (small + 1)) + 1).otherwise(extra + F.floor((F.col("rn") - cut - 1) / F.greatest(small, F.lit(1))) + 1)
    return ranked.withColumn("batch", batch.cast("int")).drop("rn", "n")


def case_value(column: str | Column, cases: dict, default=None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(default)
    for k, v in cases.items():
        out = F.when(c == k, v).otherwise(out)
    return out
