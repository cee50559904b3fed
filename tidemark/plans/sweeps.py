"""Queries on sweeps of thresholds, and on models fitted over the calibration rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sweeps as W
from ..operators.calibrate import WEIGHT_MODES, Calibration
from .registry import all_r6, query
from .tables import Tables

#: 28 cells: split at four levels, weighted and adaptive under all modes, two cuts of consistency and two of scores.
CELLS = W.grid_cells(["split"], alpha=[0.01, 0.05, 0.1, 0.2]) | W.grid_cells(["weighted", "adaptive"], weight_mode=WEIGHT_MODES, tau_quantile=[0.3, 0.5], score_quantile=[None, 0.75])


def _values(cells: dict[str, tuple[str, Calibration]]) -> str:
    rows = [(n, m, p.weight_mode, p.alpha, p.tau_quantile, 1.0 if p.score_quantile is None else 4 * (1 - p.score_quantile)) for n, (m, p) in cells.items()]
    return "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d!r}::DOUBLE, {e!r}::DOUBLE, {f!r}::DOUBLE)" for a, b, c, d, e, f in rows) + ") AS t(cell, method, mode, alpha, tau_q, gamma)"


_SWEEP = f"""
, cells AS (SELECT * FROM {_values(CELLS)}), k AS (SELECT *, node_id % 3 AS site FROM cal), te AS (SELECT *, node_id % 3 AS site FROM test),
st AS (SELECT site, max(s) AS top, stddev_samp(s) AS sd, count(*) AS n_cal, quantile_cont(c, 0.3) AS q3, quantile_cont(c, 0.5) AS q5 FROM k GROUP BY 1),
tm AS (SELECT site, quantile_disc(c, 0.5) AS ref, stddev_samp(c) AS sdc FROM te GROUP BY 1),
lim AS (SELECT *, CASE WHEN tau_q = 0.3 THEN q3 ELSE q5 END AS tau, top + gamma * greatest(sd, 1e-6) AS su FROM st JOIN tm USING (site), cells),
ps AS (SELECT * FROM (SELECT te.site, cell, method, mode, alpha, ref, sdc, s, c, n_cal, row_number() OVER (PARTITION BY te.site, cell ORDER BY c DESC, node_id) AS rn FROM te JOIN lim USING (site) WHERE method <> 'split' AND c >= tau AND s <= su) WHERE rn <= n_cal),
pl AS (SELECT site, cell, method, mode, alpha, ref, sdc, s, c, false AS is_pseudo FROM k JOIN lim USING (site) UNION ALL SELECT site, cell, method, mode, alpha, ref, sdc, s, c, true FROM ps),
rw AS (SELECT *, CASE WHEN method = 'split' OR mode = 'uniform' THEN 1.0::DOUBLE WHEN mode = 'contrastive' THEN c + 1e-8 ELSE greatest(0.05, least(20.0, exp((c - ref) / (sdc + 1e-8)))) END AS w0 FROM pl),
wt AS (SELECT *, CASE WHEN method <> 'split' AND mode = 'struct' THEN w0 / avg(w0) OVER (PARTITION BY site, cell) ELSE w0 END * CASE WHEN is_pseudo THEN 0.5 ELSE 1 END AS w FROM rw),
sm AS (SELECT *, CASE WHEN method = 'adaptive' THEN least(0.1, alpha + (0.1 - alpha) * decay) ELSE alpha END AS alpha_eff FROM (SELECT site, cell, method, alpha, count(*) AS n, count(*) FILTER (is_pseudo) AS n_pseudo, sum(w) ** 2 / sum(w * w) AS ess, greatest(0, least(1, 1 - sum(w) ** 2 / sum(w * w) / count(*))) AS decay FROM wt GROUP BY 1, 2, 3, 4)),
cm AS (SELECT site, cell, s, sum(w) OVER o / sum(w) OVER (PARTITION BY site, cell) AS f, row_number() OVER (PARTITION BY site, cell ORDER BY s) AS rn FROM wt WINDOW o AS (PARTITION BY site, cell ORDER BY s RANGE UNBOUNDED PRECEDING)),
th AS (SELECT sm.*, t.threshold FROM sm JOIN (SELECT site, cell, CASE WHEN any_value(method) = 'split' THEN min(s) FILTER (rn = greatest(1, least(n, ceil(round((n + 1) * (1 - alpha_eff), 6))))) ELSE coalesce(min(s) FILTER (f >= least(1, (1 - alpha_eff) * (n + 1) / n)), max(s)) END AS threshold FROM cm JOIN sm USING (site, cell) GROUP BY 1, 2) t USING (site, cell))
"""
_RATES = """count(*) FILTER (y = 1 AND s > threshold) AS tp, count(*) FILTER (y = 0 AND s > threshold) AS fp, count(*) FILTER (y = 1 AND NOT s > threshold) AS fn, count(*) FILTER (y = 0 AND NOT s > threshold) AS tn,
round(count(*) FILTER (y = 0 AND s > threshold) / greatest(1, count(*) FILTER (y = 0)), 6) AS fpr, round(count(*) FILTER (y = 1 AND s > threshold) / greatest(1, count(*) FILTER (y = 1)), 6) AS tpr"""


def sited(t: Tables) -> DataFrame:
    """Scored nodes of three sites."""
    return t.rows.withColumn("site", F.col("node_id") % 3)


@query("h1_sweep_methods", "cal test", _SWEEP + f"""
SELECT site, cell, any_value(round(threshold, 6)) AS threshold, any_value(n) AS n, any_value(n_pseudo) AS n_pseudo, any_value(round(ess, 6)) AS ess, any_value(round(alpha_eff, 6)) AS alpha_eff, {_RATES} FROM te JOIN th USING (site) GROUP BY 1, 2""")
def h1_sweep(t: Tables) -> DataFrame:
    """84 cells, methods and parameters by sites, as one plan."""
    found = W.sweep(sited(t), CELLS, ("site",))
    return all_r6(found.select("site", "cell", "threshold", "n", "n_pseudo", "ess", "alpha_eff", "tp", "fp", "fn", "tn", "fpr", "tpr"))


@query("h7_cross_domains", "cal test", _SWEEP + f"""
SELECT th.site AS source, te.site AS site, cell, any_value(round(threshold, 6)) AS threshold, {_RATES} FROM te, th GROUP BY 1, 2, 3""")
def h7(t: Tables) -> DataFrame:
    """Thresholds of every site on every site."""
    found = W.transfer(sited(t), CELLS, "site")
    return all_r6(found.select("source", "site", "cell", "threshold", "tp", "fp", "fn", "tn", "fpr", "tpr"))


@query("t11_boosted_threshold")
def t11(t: Tables) -> DataFrame:
    """Test nodes' own thresholds by boosted quantile regression on their vectors; trees are beyond SQL, tests hold them against plain loops."""
    from ..operators.boosting import boosted_quantile_threshold

    limits = boosted_quantile_threshold(t.nodes, t.scores)
    return all_r6(t.scored.select("node_id", "s").join(limits, "node_id").select("node_id", "threshold", (F.col("s") > F.col("threshold")).alias("alarm")))


@query("a39_covariance", "nodes", """
, l AS (SELECT node_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS d FROM nodes WHERE split = 'train')
SELECT a.d::INT AS a, b.d::INT AS b, round(covar_samp(a.v, b.v), 6) AS cov FROM l a JOIN l b USING (node_id) GROUP BY 1, 2""")
def a39(t: Tables) -> DataFrame:
    """Covariances of the training vectors' dimensions, from partial sums of matrices."""
    from ..operators.spectrum import covariance

    _, cov, _ = covariance(t.nodes.where("split = 'train'"))
    rows = [(a, b, round(float(v), 6) + 0.0) for a, line in enumerate(cov) for b, v in enumerate(line)]
    return t.spark.createDataFrame(rows, "a int, b int, cov double")


@query("m15_shape_alignment")
def m15(t: Tables) -> DataFrame:
    """Test vectors moved to the calibration normals' mean and shape; tests hold the steps against loops over all rows."""
    from ..functions.vectors import norm
    from ..operators.spectrum import shape_aligned

    moved = shape_aligned(t.nodes.where("split = 'test'"), t.nodes.where("split = 'cal' AND y = 0"))
    return moved.select("node_id", F.round(norm(F.col("x")), 6).alias("length"))
