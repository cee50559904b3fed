"""Sweeps as one plan: thresholds and error rates of many cells, keyed by cell.

A cell is a method with its parameters. What cells share is taken once: statistics of the
calibration rows (a quantile for each level that occurs), the ranking of scores. What they
don't share is keyed by cell: rows are joined with the small table of cells, and admission,
caps, weights, weighted quantiles and error rates are groupings by cell. So the number of
Spark jobs doesn't depend on the number of cells, and no cell waits for another.

``by`` names columns that split rows into independent tables (dataset, seed, detector), so
that methods x datasets x seeds is one plan too. ``transfer`` calibrates on one of these
tables and alarms on another, for every pair of them.

Defined cases: a cell without calibration rows has a null threshold and its reason, and
raises no alarm; a cap of 0 admits nothing; rows tied at a cap are taken by id; rows without
score or consistency are not admitted; an empty table has no rows of results.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distribution import lower_quantiles, order_statistic, quantiles, weighted_quantile
from ..functions.lineage import durable
from ..functions.metrics import effective_size, ranking_metrics
from .calibrate import Calibration

METHODS = ("split", "weighted", "adaptive")


def cells_of(spark, cells: dict[str, tuple[str, Calibration]]) -> DataFrame:
    """A row a cell; options that need further columns are refused by name."""
    rows = []
    for name, (method, p) in cells.items():
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, not {method!r}")
        if p.robust or p.clean_pool or p.ppr_quantile is not None:
            raise ValueError(f"cell {name!r}: robust, clean_pool and ppr_quantile are set for one threshold at a time")
        gamma = 1.0 if p.score_quantile is None else 4 * (1 - p.score_quantile)
        low, high = p.clip_range or (0.0, float("inf"))
        rows.append((name, method, p.weight_mode, p.alpha, p.alpha_max, p.tau_quantile, gamma, p.max_pseudo_ratio, p.pseudo_discount, p.clip_ratio, float(low), float(high), p.use_calib_stat))
    return spark.createDataFrame(rows, "cell string, method string, mode string, alpha double, alpha_max double, tau_q double, gamma double, ratio double, discount double, clip_ratio double, clip_low double, clip_high double, calib_stat boolean")


def matched(a: DataFrame, b: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on the columns ``by``; a table of the cells' making, of a row or a few, if there are none."""
    return a.join(b, list(by), how) if by else a.crossJoin(F.broadcast(b))


def limits_by_cell(cal: DataFrame, test: DataFrame, cells: dict[str, tuple[str, Calibration]], by: tuple[str, ...]) -> DataFrame:
    """Per group and cell: its parameters, limits of admission, the pool's cap, and centre and spread of consistency."""
    levels = sorted({p.tau_quantile for _, p in cells.values()})
    names = {f"q{i}": q for i, q in enumerate(levels)}
    of_cal = cal.groupBy(*by).agg(F.max("s").alias("top"), F.stddev_samp("s").alias("sd"), F.count(F.lit(1)).alias("n_cal"), F.stddev_samp("c").alias("cal_spread"))
    of_test = test.groupBy(*by).agg(F.stddev_samp("c").alias("test_spread"))
    stats = matched(of_cal, quantiles(cal, "c", names, by), by, "left")
    stats = matched(stats, lower_quantiles(cal, "c", {"cal_middle": 0.5}, by), by, "left")
    stats = matched(matched(stats, of_test, by, "left"), lower_quantiles(test, "c", {"test_middle": 0.5}, by), by, "left")
    tau = reduce(lambda out, k: F.when(F.col("tau_q") == names[k], F.col(k)).otherwise(out), names, F.lit(None).cast("double"))
    pick = lambda what: F.when(F.col("calib_stat"), F.col(f"cal_{what}")).otherwise(F.col(f"test_{what}"))
    return (
        stats.crossJoin(F.broadcast(cells_of(cal.sparkSession, cells)))
        .withColumn("tau", tau)
        .withColumn("s_upper", F.col("top") + F.col("gamma") * F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(1e-6)))
        .withColumn("cap", F.when(F.col("method") == "split", 0).otherwise(F.floor(F.col("n_cal") * F.col("ratio"))))
        .withColumn("middle", pick("middle"))
        .withColumn("spread", F.coalesce(pick("spread"), F.lit(0.0)))
        .drop(*names, "top", "sd", "gamma", "ratio", "tau_q", "calib_stat", "cal_middle", "cal_spread", "test_middle", "test_spread")
    )


def capped(admitted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Of each group and cell the ``cap`` rows of largest consistency; those tied at the edge by id."""
    keys = [*by, "cell", "cap"]
    edges = order_statistic(admitted, F.negative(F.col("c")), F.least(F.col("n"), F.col("cap")), "edge", tuple(keys)).drop("n")
    marked = durable(admitted.join(edges, keys).withColumn("edge", F.negative(F.col("edge"))).where(F.col("c") >= F.col("edge")))
    above = marked.groupBy(*keys).agg(F.count_if(F.col("c") > F.col("edge")).alias("above"))
    tied = marked.where(F.col("c") == F.col("edge")).join(above, keys).withColumn("open", F.col("cap") - F.col("above"))
    ids = order_statistic(tied, "node_id", F.least(F.col("n"), F.col("open")), "last_id", (*keys, "open")).select(*keys, "last_id")
    return marked.join(ids, keys).where((F.col("c") > F.col("edge")) | (F.col("node_id") <= F.col("last_id"))).drop("edge", "last_id")


def weighted_pools(cal: DataFrame, kept: DataFrame, limits: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Calibration and admitted rows of each group and cell with their weight ``w``."""
    params = ["cell", "method", "mode", "alpha", "alpha_max", "discount", "clip_ratio", "clip_low", "clip_high", "middle", "spread"]
    cols = [*by, "node_id", "s", "c", *params]
    pool = matched(cal, limits, by).select(*cols, F.lit(False).alias("is_pseudo")).unionByName(kept.select(*cols, F.lit(True).alias("is_pseudo")))
    raw = F.when(F.col("mode") == "struct", F.exp((F.col("c") - F.col("middle")) / (F.col("spread") + 1e-8))).when(F.col("mode") == "contrastive", F.col("c") + 1e-8).otherwise(1.0)
    raw = F.when(F.col("method") == "split", F.lit(1.0)).otherwise(raw)
    pool = durable(pool.withColumn("w", raw))
    keys = [*by, "cell"]

    def bounded(x: Column, mean: Column) -> Column:
        by_mean = F.greatest(F.col("clip_ratio") * mean, F.least(x, mean / F.col("clip_ratio")))
        return F.when(F.col("clip_ratio").isNotNull(), by_mean).otherwise(F.greatest("clip_low", F.least(x, F.col("clip_high"))))

    # Bounds may depend on the mean of the raw weights, and the final mean on the bounds.
    means = pool.groupBy(*keys).agg(F.avg("w").alias("raw_mean"))
    pool = pool.join(means, keys).withColumn("w", F.when((F.col("mode") == "struct") & (F.col("method") != "split"), bounded(F.col("w"), F.col("raw_mean"))).otherwise(F.col("w"))).drop("raw_mean")
    finals = pool.groupBy(*keys).agg(F.avg("w").alias("mean"))
    scaled = F.when((F.col("mode") == "struct") & (F.col("method") != "split"), F.col("w") / F.col("mean")).otherwise(F.col("w"))
    return durable(pool.join(finals, keys).withColumn("w", scaled * F.when(F.col("is_pseudo"), F.col("discount")).otherwise(1.0)).select(*by, "cell", "method", "alpha", "alpha_max", "s", "w", "is_pseudo"))


def thresholds(rows: DataFrame, cells: dict[str, tuple[str, Calibration]], by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, cell, threshold, n, n_pseudo, ess, decay, alpha_eff, reason)`` for every group of ``by`` and every cell.

    ``rows`` have node_id, s, c, y, split and the columns ``by``.
    """
    rows = durable(rows.select("node_id", "s", "c", "y", "split", *by))
    cal, test = rows.where("split = 'cal' AND y = 0"), rows.where("split = 'test'")
    limits = durable(limits_by_cell(cal, test, cells, by))
    admitted = matched(test, limits, by).where((F.col("cap") > 0) & (F.col("c") >= F.col("tau")) & (F.col("s") <= F.col("s_upper")))
    pool = weighted_pools(cal, capped(durable(admitted), by), limits, by)
    keys = (*by, "cell")
    found = pool.groupBy(*keys, "method", "alpha", "alpha_max").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_pseudo")).alias("n_pseudo"), effective_size("w").alias("ess"))
    decay = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("ess") / F.greatest("n", F.lit(1))))
    level = F.when(F.col("method") == "adaptive", F.least("alpha_max", F.col("alpha") + (F.col("alpha_max") - F.col("alpha")) * F.col("decay"))).otherwise(F.col("alpha"))
    found = durable(found.withColumn("decay", decay).withColumn("alpha_eff", level).drop("alpha", "alpha_max"))
    aimed = pool.select(*keys, "s", "w").join(found.select(*keys, "method", "alpha_eff"), list(keys))
    # A split threshold is a rank, the others a share of weight; with equal weights a rank is a share as well.
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.round((F.col("n") + 1) * (1 - F.col("alpha_eff")), 6))))
    share = F.least(F.lit(1.0), (1 - F.col("alpha_eff")) * (F.col("n") + 1) / F.col("n"))
    goal = F.when(F.col("method") == "split", (rank - 0.5) / F.col("n")).otherwise(share)
    limit = weighted_quantile(aimed, "s", "w", goal, by=(*keys, "method", "alpha_eff")).select(*keys, "threshold")
    every = rows.select(*by).distinct().crossJoin(F.broadcast(cells_of(rows.sparkSession, cells).select("cell"))) if by else cells_of(rows.sparkSession, cells).select("cell")
    out = every.join(found.drop("method"), list(keys), "left").join(limit, list(keys), "left")
    return out.withColumn("reason", F.when(F.col("threshold").isNull(), F.lit("no calibration rows")))


def rates(rows: DataFrame, limits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Error rates of test rows for every cell, false alarms on novel normals, and AUROC and average precision of their scores."""
    test = durable(rows.where("split = 'test'").select(*by, "s", "y", "is_novel"))
    keys = (*by, "cell")
    # Rows of one score alarm together, so they are counted before they meet the cells.
    counts = test.groupBy(*by, "s").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("is_novel") & (F.col("y") == 0)).alias("novel"))
    met = matched(limits.select(*keys, "threshold"), counts, by) if by else counts.crossJoin(F.broadcast(limits.select("cell", "threshold")))
    alarm = F.col("s") > F.col("threshold")
    total = lambda c, which: F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0))
    quiet = F.coalesce(~alarm, F.lit(True))
    summed = met.groupBy(*keys).agg(
        total("pos", alarm).alias("tp"), total("neg", alarm).alias("fp"), total("pos", quiet).alias("fn"), total("neg", quiet).alias("tn"),
        total("novel", alarm).alias("novel_fp"), F.sum("novel").alias("novel_n"),
    )
    one = lambda c: F.greatest(c, F.lit(1))
    rated = summed.select(
        *keys, "tp", "fp", "fn", "tn",
        (F.col("fp") / one(F.col("fp") + F.col("tn"))).alias("fpr"), (F.col("tp") / one(F.col("tp") + F.col("fn"))).alias("tpr"),
        F.try_divide("novel_fp", "novel_n").alias("novel_fpr"),
    )
    return matched(rated, ranking_metrics(test, by=by), by, "left")


def sweep(rows: DataFrame, cells: dict[str, tuple[str, Calibration]], by: tuple[str, ...] = ()) -> DataFrame:
    """Thresholds, pools and error rates of every group and cell."""
    limits = durable(thresholds(rows, cells, by))
    return limits.join(rates(rows, limits, by), [*by, "cell"], "left")


def transfer(rows: DataFrame, cells: dict[str, tuple[str, Calibration]], domain: str) -> DataFrame:
    """Cross-domain matrix: error rates on each ``domain`` under the thresholds of every other and its own, by ``source``, domain and cell."""
    limits = durable(thresholds(rows, cells, (domain,)))
    domains = rows.select(domain).distinct()
    pairs = limits.select(F.col(domain).alias("source"), "cell", "threshold").crossJoin(domains).withColumn("own", F.col("cell"))
    named = pairs.withColumn("cell", F.to_json(F.struct("source", "own")))
    rated = rates(rows, named.select(domain, "cell", "threshold"), (domain,))
    return named.join(rated, [domain, "cell"]).drop("cell").withColumnRenamed("own", "cell")


def grid_cells(methods: Iterable[str], **values: Iterable) -> dict[str, tuple[str, Calibration]]:
    """Cells of all methods under all combinations of parameter values, named by both."""
    from .harness import grid

    return {",".join([m, *[f"{k}={v}" for k, v in g.items()]]): (m, Calibration(**g)) for m in methods for g in grid(**values)}
