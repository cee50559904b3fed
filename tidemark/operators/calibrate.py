"""Alarm thresholds: split, weighted, adaptive, dual and baseline calibrations.

A threshold is a DataFrame of one row (or one row per group). Rows come with ``s`` (score),
``c`` (consistency), ``y`` and ``split``; calibration rows are those of split ``cal`` and
test rows those of split ``test``. Statistics are numbers on the driver, taken several at a
time, and stand as literals in the plans that follow.

Defined cases: no calibration rows give a null threshold; no admitted test rows leave the
calibration rows alone; ties at the pool's cap are ranked by id; rows whose consistency is
null are not admitted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distribution import at_rank, distribution, interpolated, lower, lower_quantiles, one_row_of, order_statistic, quantiles, running, select, weighted_quantile, weighted_select
from ..functions.lineage import durable
from ..functions.metrics import effective_size

WEIGHT_MODES = ("struct", "contrastive", "uniform")


@dataclass(frozen=True)
class Calibration:
    """Parameters of the weighted threshold; unknown names and modes are refused."""

    alpha: float = 0.05
    tau_quantile: float = 0.5
    score_quantile: float | None = None
    max_pseudo_ratio: float = 1.0
    pseudo_discount: float = 0.5
    soft_discount: float = 0.3
    weight_mode: str = "struct"
    clip_range: tuple[float, float] | None = (0.05, 20.0)
    clip_ratio: float | None = None
    use_calib_stat: bool = False
    robust: bool = False
    clean_pool: bool = False
    ppr_quantile: float | None = None
    alpha_max: float = 0.10

    def __post_init__(self):
        if self.weight_mode not in WEIGHT_MODES:
            raise ValueError(f"weight_mode must be one of {WEIGHT_MODES}, not {self.weight_mode!r}")

    @classmethod
    def of(cls, **values) -> Calibration:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**values)


def one_row(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Join single-row statistics."""
    return rows.crossJoin(F.broadcast(stats))


def cal_rows(rows: DataFrame, robust: bool = False) -> DataFrame:
    """Calibration normals by label; or, if robust, rows not far under the median consistency, labels unseen."""
    cal = rows.where("split = 'cal'")
    if not robust:
        return cal.where("y = 0")
    middle = select(cal, {"med": lower(F.col("c"), 0.5)})["med"]
    spread = select(cal, {"mad": lower(F.abs(F.col("c") - F.lit(middle)), 0.5)})["mad"]
    return cal.where(F.col("c") >= F.lit(middle) - 2 * 1.4826 * F.lit(spread))


def split_threshold(cal: DataFrame, alpha: float | Column = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score, within [1, n]."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.round((F.col("n") + 1) * (1 - a), 6))))
    return order_statistic(cal, "s", rank, "threshold", by)


def largest(rows: DataFrame, value: str, cap: int, key: str = "node_id") -> DataFrame:
    """The ``cap`` rows of largest value; those tied at the edge are taken by id."""
    found = select(rows, {"edge": at_rank(F.negative(F.col(value)), lambda n: max(1, min(n, cap)))})
    if found["n_edge"] <= cap:
        return rows.where(F.col(value).isNotNull())
    if cap < 1:
        return rows.limit(0)
    edge = -found["edge"]
    above = rows.where(F.col(value) > F.lit(edge))
    return above.unionByName(rows.where(F.col(value) == F.lit(edge)).orderBy(key).limit(cap - above.count()))


def limits(cal: DataFrame, p: Calibration) -> dict[str, float]:
    """Of the calibration rows: ``tau``, ``s_upper``, their number and the pool's cap."""
    gamma = 1.0 if p.score_quantile is None else 4 * (1 - p.score_quantile)
    found = select(cal, {"tau": interpolated(F.col("c"), p.tau_quantile)}, top=F.max("s"), sd=F.stddev_samp("s"), n=F.count(F.lit(1)))
    upper = None if found["top"] is None else found["top"] + gamma * max(found["sd"] or 0.0, 1e-6)
    return {"tau": found["tau"], "s_upper": upper, "n": found["n"], "cap": int(found["n"] * p.max_pseudo_ratio)}


def admit(rows: DataFrame, p: Calibration) -> DataFrame:
    """Pool of calibration and pseudo-normal test rows: ``(node_id, s, c, y, is_pseudo)``.

    Admission limits come from calibration rows only. The cap keeps the most consistent
    admitted rows. ``rows`` are read several times and should be stored.
    """
    cal = cal_rows(rows, p.robust)
    at = limits(cal, p)
    pseudo = rows.where("split = 'test'").where((F.col("c") >= F.lit(at["tau"])) & (F.col("s") <= F.lit(at["s_upper"])))
    if p.ppr_quantile is not None:
        pseudo = pseudo.where(F.col("ppr") >= F.lit(select(pseudo, {"q": interpolated(F.col("ppr"), p.ppr_quantile)})["q"]))
    if p.clean_pool:
        pseudo = pseudo.where("y = 0")
    cols = ["node_id", "s", "c", "y"]
    kept = largest(pseudo.select(*cols), "c", at["cap"])
    return cal.select(*cols, F.lit(False).alias("is_pseudo")).unionByName(kept.select(*cols, F.lit(True).alias("is_pseudo")))


def consistency_weights(pool: DataFrame, reference: DataFrame, p: Calibration) -> DataFrame:
    """Add ``w``: exp of the standardised consistency, clipped, over its mean. ``reference`` gives median and deviation."""
    at = select(reference, {"ref": lower(F.col("c"), 0.5)}, sd=F.stddev_samp("c"))
    w = F.exp((F.col("c") - F.lit(at["ref"])) / F.lit((at["sd"] or 0.0) + 1e-8))
    if p.clip_ratio is not None:
        mean = pool.agg(F.avg(w)).first()[0] or 0.0
        w = F.greatest(F.lit(p.clip_ratio * mean), F.least(w, F.lit(mean / p.clip_ratio)))
    elif p.clip_range is not None:
        w = F.greatest(F.lit(float(p.clip_range[0])), F.least(w, F.lit(float(p.clip_range[1]))))
    return pool.withColumn("w", w / F.lit(pool.agg(F.avg(w)).first()[0] or 1.0))


def weigh(pool: DataFrame, rows: DataFrame, p: Calibration) -> DataFrame:
    """Add weights by mode; pseudo-normal rows are discounted after normalisation."""
    if p.weight_mode == "contrastive":
        out = pool.withColumn("w", F.col("c") + 1e-8)
    elif p.weight_mode == "uniform":
        out = pool.withColumn("w", F.lit(1.0))
    else:
        out = consistency_weights(pool, cal_rows(rows, p.robust) if p.use_calib_stat else rows.where("split = 'test'"), p)
    return out.withColumn("w", F.when(F.col("is_pseudo"), F.col("w") * p.pseudo_discount).otherwise(F.col("w")))


#: Columns about a weighted pool: sizes, extremes, effective sizes and the bias bound.
SUMMARY = {
    "n": "long", "n_pseudo": "long", "w_min": "double", "w_max": "double", "ess": "double", "ess_pseudo": "double", "decay": "double", "bias_bound": "double",
}


def pool_threshold(pool: DataFrame, alpha: Callable[[dict], float]) -> dict[str, float]:
    """Threshold and summary of a weighted pool; the level may depend on the summary."""
    pseudo = F.when(F.col("is_pseudo"), F.col("w"))
    sums = dict(
        n_pseudo=F.count_if(F.col("is_pseudo")), w_min=F.min("w"), w_max=F.max("w"), ess=effective_size("w"),
        ess_pseudo=F.coalesce(F.try_divide(F.pow(F.sum(pseudo), 2), F.sum(pseudo * pseudo)), F.lit(0.0)),
    )
    found = pool.agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()]).first().asDict()
    n = found["n"]
    found["decay"] = max(0.0, min(1.0, 1 - (found["ess"] or 0.0) / max(n, 1)))
    found["bias_bound"] = min(1.0, found["decay"] / 2 + 1 / (n + 1))
    found["alpha_eff"] = alpha(found)
    found["threshold"] = weighted_select(pool, F.col("s"), F.col("w"), lambda m: min(1.0, (1 - found["alpha_eff"]) * (m + 1) / m))["threshold"]
    return found


def level(alpha: Column) -> Column:
    return F.least(F.lit(1.0), (1 - alpha) * (F.col("n") + 1) / F.col("n"))


def stored(rows: DataFrame, *more: str) -> DataFrame:
    """The columns that thresholds read, stored once."""
    return durable(rows.select("node_id", "s", "c", "y", "split", *more))


def weighted_pool(rows: DataFrame, p: Calibration) -> DataFrame:
    rows = stored(rows, *(["ppr"] if p.ppr_quantile is not None else []))
    return weigh(admit(rows, p), rows, p)


def weighted_threshold(rows: DataFrame, p: Calibration = Calibration()) -> DataFrame:
    """The weighted quantile of the admitted pool, with the pool's summary."""
    found = pool_threshold(weighted_pool(rows, p), lambda s: p.alpha)
    return one_row_of(rows, {k: found[k] for k in ("threshold", *SUMMARY)}, SUMMARY)


def adaptive_threshold(rows: DataFrame, p: Calibration = Calibration(score_quantile=0.75)) -> DataFrame:
    """The same at a level that grows to ``alpha_max`` as weights concentrate."""
    found = pool_threshold(weighted_pool(rows, p), lambda s: min(p.alpha_max, p.alpha + (p.alpha_max - p.alpha) * s["decay"]))
    return one_row_of(rows, {k: found[k] for k in ("threshold", *SUMMARY, "alpha_eff")}, SUMMARY)


def soft_threshold(rows: DataFrame, p: Calibration = Calibration()) -> DataFrame:
    """All test rows join at a discount; the third of least weight leaves."""
    rows = stored(rows)
    cal, test = cal_rows(rows, p.robust), rows.where("split = 'test'")
    if p.weight_mode == "contrastive":
        weighted = [d.withColumn("w", F.col("c") + 1e-8) for d in (cal, test)]
    else:
        weighted = [consistency_weights(d, test, p) for d in (cal, test)]
    loose = weighted[1].withColumn("w", F.col("w") * p.soft_discount)
    kept = loose.where(F.col("w") >= F.lit(select(loose, {"least": interpolated(F.col("w"), 0.3)})["least"]))
    cols = ["node_id", "s", "w"]
    pool = weighted[0].select(*cols, F.lit(False).alias("is_pseudo")).unionByName(kept.select(*cols, F.lit(True).alias("is_pseudo")))
    found = pool_threshold(pool, lambda s: p.alpha)
    return one_row_of(rows, {k: found[k] for k in ("threshold", *SUMMARY)}, SUMMARY)


def normal_limit(rows: DataFrame, beta: float | Column = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """``lambda_normal``: the ceil(beta (n + 1))-th smallest anomalous calibration score; minus infinity without any."""
    b = beta if isinstance(beta, Column) else F.lit(float(beta))
    rank = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(F.round(b * (F.col("n") + 1), 6))))
    found = order_statistic(rows.where("split = 'cal' AND y = 1"), "s", rank, "lambda_normal", by)
    return found.select(*by, F.coalesce("lambda_normal", F.lit(float("-inf"))).alias("lambda_normal"))


def dual_threshold(rows: DataFrame, p: Calibration = Calibration(), beta: float = 0.05) -> DataFrame:
    """``(lambda_normal, lambda_anomaly)``."""
    return normal_limit(rows, beta).crossJoin(weighted_threshold(rows, p).select(F.col("threshold").alias("lambda_anomaly")))


def density_ratio(at: DataFrame, a: DataFrame, b: DataFrame, value: str, bins: int = 32, bw: float = 0.1) -> DataFrame:
    """Add ``ratio``: histogram density of ``b`` over that of ``a`` at each row of ``at``, clipped to [0.1, 10], over its mean."""
    both = a.select(value).unionAll(b.select(value))
    ends = both.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    cell = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    with_cell = lambda d: one_row(d, ends).withColumn("cell", F.when(F.col("hi") - F.col("lo") < 1e-8, F.lit(0)).otherwise(cell)).drop("lo", "hi")
    hist = lambda d, name: one_row(with_cell(d).groupBy("cell").agg(F.count(F.lit(1)).alias("k")), d.agg(F.count(F.lit(1)).alias("m"))).select("cell", (F.col("k") / F.col("m")).alias(name))
    table = hist(a, "pa").join(hist(b, "pb"), "cell", "full")
    ratio = (F.coalesce("pb", F.lit(0.0)) + bw / bins) / (F.coalesce("pa", F.lit(0.0)) + bw / bins)
    rated = with_cell(at).join(table, "cell", "left").withColumn("ratio", F.greatest(F.lit(0.1), F.least(F.lit(10.0), ratio))).drop("cell", "pa", "pb")
    return one_row(rated, rated.agg(F.avg("ratio").alias("mean_ratio"))).withColumn("ratio", F.col("ratio") / F.col("mean_ratio")).drop("mean_ratio")


def generic_weighted_threshold(rows: DataFrame, p: Calibration = Calibration(), proxy: str = "proxy") -> DataFrame:
    """Covariate-shift weights from a one-dimensional proxy instead of structure."""
    rows = durable(rows.select("node_id", "s", "y", "split", proxy))
    cal, test = cal_rows(rows), rows.where("split = 'test'")
    gamma = 1.0 if p.score_quantile is None else 4 * (1 - p.score_quantile)
    at = select(density_ratio(cal, cal, test, proxy), {"tau": interpolated(F.col("ratio"), p.tau_quantile)}, top=F.max("s"), sd=F.stddev_samp("s"), n=F.count(F.lit(1)))
    upper = F.lit(at["top"]) + gamma * max(at["sd"] or 0.0, 1e-6)
    admitted = durable(density_ratio(test, test, cal, proxy).where((F.col("ratio") >= F.lit(at["tau"])) & (F.col("s") <= upper)))
    pseudo = largest(admitted, "ratio", int(at["n"] * p.max_pseudo_ratio))
    pool = durable(cal.select("node_id", "s", proxy, F.lit(False).alias("is_pseudo")).unionByName(pseudo.select("node_id", "s", proxy, F.lit(True).alias("is_pseudo"))))
    w = F.greatest(F.lit(0.05), F.least(F.lit(20.0), F.col("ratio"))) * F.when(F.col("is_pseudo"), p.pseudo_discount).otherwise(1.0)
    found = pool_threshold(durable(density_ratio(pool, pool, cal, proxy).withColumn("w", w)), lambda s: p.alpha)
    return one_row_of(rows, {k: found[k] for k in ("threshold", *SUMMARY)}, SUMMARY)


def temperature_threshold(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Split threshold of scores over their mean; decisions are those of the plain one."""
    cal = cal_rows(rows)
    t = cal.agg(F.greatest(F.avg("s"), F.lit(1e-4)).alias("temperature"))
    scaled = one_row(cal, t).withColumn("s", F.col("s") / F.col("temperature"))
    return split_threshold(scaled, alpha).select("threshold").crossJoin(t)


def distance_threshold(rows: DataFrame, proxy: str = "proxy", alpha: float = 0.05) -> DataFrame:
    """``(node_id, threshold)``: the interpolated quantile near the normals, a little more beyond their median distance."""
    cal = durable(cal_rows(rows))
    n = cal.agg(F.count(F.lit(1)).alias("n"))
    q = F.least(F.lit(1.0), F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 6)) / F.col("n"))
    seen = one_row(running(distribution(cal, "s"), "v", ["n"]).drop("n"), n)
    place = (F.col("n") - 1) * q
    low, high = F.min(F.when(F.col("cum_n") > F.floor(place), F.col("v"))), F.min(F.when(F.col("cum_n") > F.ceil(place), F.col("v")))
    ends = seen.groupBy("n").agg(low.alias("lo"), high.alias("hi"))
    stats = ends.select((F.col("lo") + (F.col("hi") - F.col("lo")) * (place - F.floor(place))).alias("q_low")).crossJoin(lower_quantiles(cal, proxy, {"near": 0.5}))
    return one_row(rows.where("split = 'test'"), stats).select("node_id", F.when(F.col(proxy) <= F.col("near"), F.col("q_low")).otherwise(F.col("q_low") * (1 + alpha)).alias("threshold"))


def walk_threshold(rows: DataFrame, alpha: float = 0.05, weight: str = "ppr") -> DataFrame:
    """Weighted quantile of all calibration rows with an infinite test atom of weight 1/n; weights sum to 1."""
    cal = rows.where("split = 'cal'")
    total = cal.agg(F.sum(weight).alias("all_w"), F.count(F.lit(1)).alias("m"))
    pool = one_row(cal, total).select("s", (F.col(weight) / F.greatest("all_w", F.lit(1e-12))).alias("w"))
    atom = total.select(F.lit(float("inf")).alias("s"), F.try_divide(F.lit(1.0), F.col("m")).alias("w")).where("m > 0")
    return weighted_quantile(pool.unionAll(atom), "s", "w", F.lit(1 - alpha)).select("threshold")


def rate_bound(weights: DataFrame, true: str, guess: str) -> DataFrame:
    """``min(1, d / 2 + 1 / (n + 1))`` where d is the relative error of the weights, within [0, 1]."""
    d = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.abs(F.col(true) - F.greatest(F.col(guess), F.lit(1e-12)))) / F.greatest(F.sum(true), F.lit(1e-12))))
    s = weights.agg(d.alias("delta"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("bound", F.least(F.lit(1.0), F.col("delta") / 2 + 1 / (F.col("n") + 1)))


def alpha_curve(rows: DataFrame, alphas: list[float]) -> DataFrame:
    """Split thresholds for a grid of levels in one plan: the distribution is taken once, the grid joined by broadcast."""
    seen = running(distribution(cal_rows(rows), "s"), "v", ["n"])
    grid = rows.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double")
    rank = F.greatest(F.lit(1), F.least(F.col("all_n"), F.ceil(F.round((F.col("all_n") + 1) * (1 - F.col("alpha")), 6))))
    return seen.crossJoin(F.broadcast(grid)).groupBy("alpha").agg(F.min(F.when(F.col("cum_n") >= rank, F.col("v"))).alias("threshold"))


def contaminated(rows: DataFrame, share: float, low: bool = True, seed: int = 5) -> DataFrame:
    """Calibration normals of which a hash-chosen share gets scores that do not belong: low quantiles, or a test anomaly's mean."""
    from .split import hash_rank

    cal = cal_rows(rows)
    ranked = hash_rank(cal.select("node_id"), "node_id", seed).where(F.col("rn") <= F.floor(share * F.col("n"))).select("node_id", F.lit(True).alias("hit"))
    if low:
        stats = quantiles(cal, "s", {"other": 0.075})
    else:
        stats = rows.where("split = 'test' AND y = 1").agg(F.avg("s").alias("other"))
    return one_row(cal.join(ranked, "node_id", "left"), stats).select("node_id", F.when(F.col("hit"), F.col("other")).otherwise(F.col("s")).alias("s"), "c", "y", "split", F.coalesce("hit", F.lit(False)).alias("replaced"))


def stress_pool(pool: DataFrame, anomalies: DataFrame, rate: float) -> DataFrame:
    """Pseudo-normal rows rebuilt to a given share of anomalies: all normals and round(r n / (1 - r)) anomalies by id hash."""
    from .split import hash_rank

    normals = pool.where("is_pseudo AND y = 0")
    want = normals.agg(F.round(rate * F.count(F.lit(1)) / (1 - rate)).alias("want"))
    drawn = one_row(hash_rank(anomalies, "node_id", 3), want).where("rn <= want")
    cols = ["node_id", "s", "c", "y"]
    return normals.select(*cols).unionByName(drawn.select(*cols))


def externally_weighted_threshold(rows: DataFrame, external: str, p: Calibration = Calibration()) -> DataFrame:
    """Admission as usual, weights from an external column, each side over its mean."""
    rows = stored(rows, external)
    pool = durable(admit(rows, p).join(rows.select("node_id", F.col(external).alias("w")), "node_id"))
    sides = pool.groupBy("is_pseudo").agg(F.avg("w").alias("mean_w"))
    weighted = pool.join(F.broadcast(sides), "is_pseudo").withColumn("w", F.col("w") / F.greatest("mean_w", F.lit(1e-12)) * F.when(F.col("is_pseudo"), p.pseudo_discount).otherwise(1.0))
    return weighted_quantile(weighted, "s", "w", level(F.lit(p.alpha))).select("threshold")


def binned_quantile_threshold(rows: DataFrame, proxy: str = "proxy", alpha: float = 0.05, bins: int = 4) -> DataFrame:
    """``(node_id, threshold)``: the (1 - alpha) quantile of calibration normals within the same quantile bin of the proxy."""
    cal = cal_rows(rows)
    names = {f"q{i}": i / bins for i in range(1, bins)}
    cuts = quantiles(cal, proxy, names)
    cell = reduce(lambda a, k: a + (F.col(proxy) >= F.col(k)).cast("int"), names, F.lit(0))
    binned = one_row(cal, cuts).withColumn("cell", cell)
    per_cell = quantiles(binned, "s", {"threshold": 1 - alpha}, by=("cell",))
    return one_row(rows.where("split = 'test'"), cuts).withColumn("cell", cell).join(F.broadcast(per_cell), "cell", "left").select("node_id", "cell", "threshold")


def grid_temperature(rows: DataFrame, grid: list[float], target: float = 0.05, cut: float = 0.5) -> DataFrame:
    """One row ``(temperature, fpr)``: the temperature of logits whose false alarms among calibration normals come nearest the target."""
    cal = cal_rows(rows).select(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("s"))).alias("p")).select(F.log(F.col("p") / (1 - F.col("p"))).alias("z"))
    temperatures = F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("temperature")
    rates = cal.select("z", temperatures).groupBy("temperature").agg(F.avg((1 / (1 + F.exp(-F.col("z") / F.col("temperature"))) > cut).cast("double")).alias("fpr"))
    return rates.orderBy(F.abs(F.col("fpr") - target), "temperature").limit(1)


def total_level_threshold(cal: DataFrame, weight: str, alpha: float = 0.05) -> DataFrame:
    """The weighted quantile at the level ceil((n + 1)(1 - alpha)) / n of all weight; the largest score if that is above 1."""
    at = F.least(F.lit(1.0), F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 6)) / F.col("n"))
    return weighted_quantile(cal, "s", weight, at).select("threshold")


def support(normals: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Ids of either side, each once."""
    return normals.select("node_id").union(anomalies.select("node_id")).distinct()
