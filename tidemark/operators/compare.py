"""Comparing results: seeds, pairs, correlations, shift distances, tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distribution import average_ranks, ecdf_gap, quantiles
from ..functions.lineage import durable
from ..functions.vectors import correlation, hash_uniform
from .blocks import beside, packed, vectors


def over_seeds(results: DataFrame, keys: tuple[str, ...] = ("dataset", "method", "metric")) -> DataFrame:
    v = F.when(~F.isnan("value"), F.col("value"))
    return results.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.stddev_samp(v).alias("std_samp"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, by the finite series in the angle."""

    def series(theta: Column, n: Column) -> Column:
        cos2 = F.pow(F.cos(theta), 2)
        odd = n % 2 == 1
        # Terms 1, 1/2 cos^2, ... for even and 1, 2/3 cos^2, ... for odd degrees of freedom.
        steps = F.when(n >= 2, F.sequence(F.lit(1), F.greatest(F.floor(n / 2).cast("int") - 1, F.lit(1)))).otherwise(F.array(F.lit(1)))
        ratio = lambda k: F.when(odd, 2.0 * k / (2 * k + 1)).otherwise((2.0 * k - 1) / (2 * k))
        terms = F.aggregate(
            F.filter(steps, lambda k: k <= F.floor((n - 2) / 2)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
            lambda a, k: F.struct((a["term"] * ratio(k) * cos2).alias("term"), (a["sum"] + a["term"] * ratio(k) * cos2).alias("sum")), lambda a: a["sum"],
        )
        inside = F.when(n == 1, 2 * theta / math.pi).when(odd, 2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * terms)).otherwise(F.sin(theta) * terms)
        return F.greatest(F.lit(0.0), 1 - inside)

    return F.when(df >= 1, series(F.atan(F.abs(t) / F.sqrt(F.greatest(df, F.lit(1)))), df))


def t_quantile(n: Column, level: float = 0.95) -> Column:
    """The two-sided quantile for ``n - 1`` degrees of freedom, by halving an interval of its arc tangent."""

    def halve(ends: Column, _: Column) -> Column:
        middle = (ends["low"] + ends["high"]) / 2
        above = t_tail(F.tan(middle) * F.sqrt(n - 1), n - 1) > 1 - level
        return F.struct(F.when(above, middle).otherwise(ends["low"]).alias("low"), F.when(above, ends["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi / 2).alias("high"))
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda e: F.tan(e["low"]) * F.sqrt(n - 1)))


def t_interval(summary: DataFrame) -> DataFrame:
    """Add ``half``: half the width of the 95 % t interval; null for one seed."""
    return summary.withColumn("half", t_quantile(F.col("n")) * F.col("std_samp") / F.sqrt("n"))


def upper_tail(z: Column) -> Column:
    """Share of the normal distribution above ``z``, by Simpson's rule over its density up to 10."""
    top, steps = F.least(F.abs(z), F.lit(10.0)), 400
    factor = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda s, i: s + factor(i) * F.exp(-F.pow(top * i / steps, 2) / 2)) * top / (3 * steps * math.sqrt(2 * math.pi))
    return F.when(z < 0, 0.5 + area).otherwise(0.5 - area)


def wilcoxon_p(diffs: DataFrame, keys: tuple[str, ...] = ("dataset", "metric"), most: int = 60) -> DataFrame:
    """``(keys, p_greater)``: one-sided p-value of the signed rank sum, differences of 0 left out.

    Up to ``most`` differences it is exact: the distribution of the sum over all signs, built
    rank by rank on doubled ranks, which are whole also for ties. Beyond, the normal
    distribution with the ties' variance and half a step of continuity.
    """
    group = Window.partitionBy(*keys)
    ranked = diffs.where("diff <> 0").withColumn("rank", F.rank().over(group.orderBy(F.abs("diff"))) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, F.abs("diff"))) - 1) / 2)
    numbered = ranked.withColumn("m", F.count(F.lit(1)).over(group))
    double = (2 * F.col("rank")).cast("int")
    sums = numbered.groupBy(*keys).agg(
        F.max("m").alias("m"), F.collect_list(F.when(F.col("m") <= most, double)).alias("ranks"),
        F.sum(F.when(F.col("diff") > 0, double).otherwise(0)).alias("w"), F.sum(double).alias("all"), F.sum(F.pow("rank", 2)).alias("squares"),
    )
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), F.when(F.col("m") <= most, F.col("all").cast("int")).otherwise(0)))
    chances = F.aggregate("ranks", start, lambda dp, r: F.transform(dp, lambda v, at: (v + F.coalesce(F.get(dp, at - r), F.lit(0.0))) / 2))
    exact = F.aggregate(F.slice(chances, F.col("w").cast("int") + 1, F.size(chances)), F.lit(0.0), lambda t, v: t + v)
    z = (F.col("w") / 2 - F.col("all") / 4 - 0.5) / F.sqrt(F.col("squares") / 4)
    return sums.select(*keys, F.when(F.col("m") <= most, exact).otherwise(upper_tail(z)).alias("p_greater"))


def ks_test(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row ``(ks, p)``: the two-sample statistic and its asymptotic p-value."""
    n, m = a.where(F.col(value).isNotNull()).count(), b.where(F.col(value).isNotNull()).count()
    root = math.sqrt(n * m / (n + m)) if n and m else 0.0
    x = (root + 0.12 + (0.11 / root if root else 0.0)) * F.col("ks")
    tail = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return ks_statistic(a, b, value).select("ks", F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))).alias("p"))


def dominance_monitor(cal: DataFrame, mixed: DataFrame, value: str, threshold: float, share: float) -> DataFrame:
    """Label-free: the excess of calibration over what the mixed rows' distribution would be without a share of anomalies."""
    grid = ecdf_gap(cal, mixed, value)
    clean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("fb") - share) / max(1e-12, 1 - share)))
    return grid.where(F.col("v") >= threshold).agg(F.max(F.col("fa") - clean).alias("excess"))


def paired(results: DataFrame, a: str, b: str) -> DataFrame:
    """``(dataset, seed, metric, diff)`` of two methods."""
    pick = lambda m, name: results.where(F.col("method") == m).select("dataset", "seed", "metric", F.col("value").alias(name))
    return pick(a, "a").join(pick(b, "b"), ["dataset", "seed", "metric"]).select("dataset", "seed", "metric", (F.col("a") - F.col("b")).alias("diff"))


def paired_tests(diffs: DataFrame, keys: tuple[str, ...] = ("dataset", "metric")) -> DataFrame:
    """Paired t statistic, Wilcoxon rank sum of positive differences, and the exact two-sided sign test."""
    ranked = diffs.where("diff <> 0").withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.abs("diff"))) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, F.abs("diff"))) - 1) / 2)
    signs = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("diff") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.count_if(F.col("diff") > 0).alias("plus"), F.count(F.lit(1)).alias("m"))
    k = F.least("plus", F.col("m") - F.col("plus"))
    # Terms of the binomial tail, each from the one before, as logarithms: no limit on the number of pairs.
    begin = F.struct((-F.col("m") * math.log(2)).cast("double").alias("term"), F.exp(-F.col("m") * math.log(2)).alias("sum"))

    def grow(e: Column, i: Column) -> Column:
        term = e["term"] + F.log(F.col("m") - i + 1) - F.log(i)
        return F.struct(term.alias("term"), (e["sum"] + F.exp(term)).alias("sum"))

    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1))), begin, grow, lambda e: e["sum"])).otherwise(F.exp(-F.col("m") * math.log(2)))
    signs = signs.withColumn("sign_p", F.least(F.lit(1.0), 2 * tail))
    t = diffs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"), F.try_divide(F.avg("diff"), F.stddev_samp("diff") / F.sqrt(F.count(F.lit(1)))).alias("t"))
    return t.join(signs.select(*keys, "w_plus", "sign_p"), list(keys), "left")


def bootstrap_interval(values: DataFrame, value: str, key: str, draws: int = 1000, seed: int = 1) -> DataFrame:
    """Percentile interval of the mean over resamples.

    Every draw takes as many rows as there are, by hash-drawn indices. Rows get their index in
    hash-free order of ``key`` by ranges, so none of it is one task's work; rows and picks
    meet in an ordinary join that may be broadcast if it is small.
    """
    from .graph import rank01

    rows = durable(values.select(F.col(value).alias("v"), F.col(key).alias("node_id")).withColumn("one", F.lit(0.0)))
    n = rows.count()
    if not n:
        return values.sparkSession.createDataFrame([(None, None, None)], "low double, high double, mean double")
    numbered = rank01(rows, "one").select("v", (F.round(F.col("r") * n) - 1).cast("long").alias("k"))
    draws_of = values.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    picks = draws_of.withColumn("k", F.floor(hash_uniform("draw", "slot", F.lit(seed)) * n))
    counted = picks.groupBy("draw", "k").agg(F.count(F.lit(1)).alias("times"))
    means = counted.join(numbered, "k").groupBy("draw").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("m"))
    return means.agg(F.percentile("m", [0.025, 0.975]).alias("ends"), F.avg("m").alias("mean")).select(F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"), "mean")


def correlations(rows: DataFrame, a: str, b: str, z: str) -> DataFrame:
    """Pearson, Spearman and partial correlation of ``a`` and ``b``, and partial given ``z`` on ranks."""
    ranked = average_ranks(average_ranks(average_ranks(rows, a, "ra"), b, "rb"), z, "rz")
    c = ranked.agg(*[correlation(F.col(x), F.col(y)).alias(n) for x, y, n in ((a, b, "pearson"), (a, z, "az"), (b, z, "bz"), ("ra", "rb", "spearman"), ("ra", "rz", "raz"), ("rb", "rz", "rbz"))])
    part = lambda ab, az, bz: F.try_divide(F.col(ab) - F.col(az) * F.col(bz), F.sqrt(F.greatest(F.lit(0.0), (1 - F.col(az) * F.col(az)) * (1 - F.col(bz) * F.col(bz)))))
    return c.select("pearson", "spearman", part("pearson", "az", "bz").alias("partial"), part("spearman", "raz", "rbz").alias("rank_partial"))


def quartile_means(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of ``value`` per quartile cell of ``by``; a value at an edge goes up."""
    cuts = quantiles(rows, by, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    cell = sum(((F.col(by) >= F.col(q)).cast("int") for q in ("q1", "q2", "q3")), F.lit(0))
    return rows.crossJoin(F.broadcast(cuts)).groupBy(cell.alias("cell")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def ks_statistic(a: DataFrame, b: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    return ecdf_gap(a, b, value, weight).agg(F.max(F.abs(F.col("fa") - F.col("fb"))).alias("ks"))


def dominance(a: DataFrame, b: DataFrame, value: str, threshold: DataFrame) -> DataFrame:
    """Largest fa - fb at or above the threshold: at most the tolerance if ``b`` stays left of ``a`` in the tail."""
    grid = ecdf_gap(a, b, value).crossJoin(F.broadcast(threshold.select(F.col("threshold"))))
    return grid.where("v >= threshold").agg(F.max(F.col("fa") - F.col("fb")).alias("excess"))


#: Rows of a block of vectors in ``mmd``.
MMD_ROWS = 2048


def mmd(a: DataFrame, b: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Biased squared MMD with an RBF kernel over all pairs of two samples ``(x)``.

    A task sums the kernel over pairs of blocks (``blocks``), each unordered pair once; vectors
    that are null or hold nulls count nowhere, and the result is null if a sample has no others.
    """
    whole = [s.where("x IS NOT NULL AND NOT exists(x, v -> v IS NULL)").select(F.lit(0).alias("node_id"), "x") for s in (a, b)]
    sides = [packed(s, MMD_ROWS, tag=tag) for tag, s in enumerate(whole)]
    blocks = sides[0].unionAll(sides[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for left, right, ids, xs, r_ids, r_xs in zip(*(c.to_pylist() if c.type == pa.int64() else c for c in batch.columns)):
                p, q = vectors(ids.as_buffer(), xs.as_buffer())[1], vectors(r_ids.as_buffer(), r_xs.as_buffer())[1]
                d = p @ q.T
                d *= -2
                d += (p * p).sum(1)[:, None]
                d += (q * q).sum(1)[None]
                np.maximum(d, 0, out=d)
                d *= -gamma
                np.exp(d, out=d)
                between = left >> 60, right >> 60
                rows.append((*between, float(d.sum()) * (2 if between[0] == between[1] and left != right else 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], ["l", "r", "k"])

    pairs = beside(blocks, blocks, each_once=True).select("block", "r_block", "ids", "xs", "r_ids", "r_xs")
    sums = pairs.mapInArrow(run, "l long, r long, k double")
    n = [F.lit(float(r["n"] or 0)) for r in (s.agg((F.sum(F.length("ids")) / 8).alias("n")).first() for s in sides)]
    mean = lambda l, r: F.try_divide(F.sum(F.when((F.col("l") == l) & (F.col("r") == r), F.col("k"))), n[l] * n[r])  # noqa: E731, E741
    return sums.agg((mean(0, 0) - 2 * mean(0, 1) + mean(1, 1)).alias("mmd2"))


def best_methods(summary: DataFrame, lower_is_better: bool = False) -> DataFrame:
    """Add ``is_best`` per dataset and metric."""
    w = Window.partitionBy("dataset", "metric")
    best = F.min("mean").over(w) if lower_is_better else F.max("mean").over(w)
    return summary.withColumn("is_best", F.col("mean") == best)


def comparison_matrix(summary: DataFrame, datasets: list[str]) -> DataFrame:
    return summary.groupBy("method", "metric").pivot("dataset", datasets).agg(F.first("mean"))


def filled(results: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Results with values replaced where a patch exists."""
    return results.join(patches.withColumnRenamed("value", "patch"), keys, "left").withColumn("value", F.coalesce("patch", "value")).drop("patch")


def missing_cells(wanted: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a sweep that are not in the results yet."""
    return wanted.join(results, keys, "left_anti")
