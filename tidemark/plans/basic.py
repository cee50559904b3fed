"""Queries on splits, statistics, metrics and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distribution as D
from ..functions import metrics as M
from ..functions.vectors import long_form
from ..operators import calibrate as C
from ..operators import compare as P
from ..operators import split as S
from ..operators.graph import rank01
from .registry import all_r6, query, r6
from .tables import Tables


@query("flagship_recalibration", "scored", """
SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(precision, 6) AS precision, round(CASE WHEN precision + tpr > 0 THEN 2 * precision * tpr / (precision + tpr) ELSE 0 END, 6) AS f1 FROM (
 SELECT any_value(t) AS threshold, count(*) FILTER (s > t AND y = 1) AS tp, count(*) FILTER (s > t AND y = 0) AS fp, count(*) FILTER (s <= t AND y = 1) AS fn, count(*) FILTER (s <= t AND y = 0) AS tn,
  fp / greatest(fp + tn, 1) AS fpr, tp / greatest(tp + fn, 1) AS tpr, tp / greatest(tp + fp, 1) AS precision
 FROM scored, (SELECT s AS t FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM scored WHERE split = 'cal' AND y = 0) WHERE rn = least(n, greatest(1, ceil(round((n + 1) * 0.95, 6)))))
 WHERE split = 'test')""")
def flagship(t: Tables) -> DataFrame:
    limit = C.split_threshold(C.cal_rows(t.scored)).select("threshold")
    alarms = C.one_row(t.scored.where("split = 'test'"), limit)
    return all_r6(M.confusion(alarms, F.col("s") > F.col("threshold"), by=("threshold",)))


@query("s1_split", "nodes", "SELECT node_id, y, cluster, is_novel, split FROM nodes")
def s1(t: Tables) -> DataFrame:
    return t.nodes.select("node_id", "y", "cluster", "is_novel", "split")


@query("g1_direction_scores", "scores", "SELECT node_id, round(s, 6) AS s FROM scores")
def g1(t: Tables) -> DataFrame:
    return t.scores.select("node_id", r6("s"))


@query("o5_smallest_clusters", "e", "SELECT cluster FROM e WHERE y = 0 GROUP BY 1 ORDER BY count(*), cluster LIMIT 2")
def o5(t: Tables) -> DataFrame:
    return S.smallest_groups(t.nodes.where("y = 0"), "cluster", 2)


@query("o6_stratified_sample", "nodes", """
SELECT node_id, y FROM (SELECT node_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(concat(node_id, ':42')), node_id) AS rn, count(*) OVER () AS n, sum(y) OVER () AS p FROM nodes)
WHERE rn <= CASE WHEN y = 1 THEN greatest(1, floor(100 * p / n)) ELSE 100 - greatest(1, floor(100 * p / n)) END""")
def o6(t: Tables) -> DataFrame:
    return S.stratified_sample(t.nodes.select("node_id", "y"), 100).select("node_id", "y")


@query("a41_split_counts", "nodes", "SELECT split, y, count(*) AS n, count(*) FILTER (is_novel) AS n_novel FROM nodes GROUP BY 1, 2")
def a41(t: Tables) -> DataFrame:
    return t.nodes.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_novel").alias("n_novel"))


@query("p12_zscore", "lng", """
SELECT node_id, dim::INT AS dim, round((val - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS val FROM lng JOIN (SELECT dim, avg(val) AS m, stddev_pop(val) AS sd FROM lng GROUP BY 1) USING (dim)""")
def p12(t: Tables) -> DataFrame:
    return S.standardised(long_form(t.nodes)).select("node_id", "dim", r6("val"))


@query("p13_min_max", "scored", "SELECT node_id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS s01 FROM scored")
def p13(t: Tables) -> DataFrame:
    return S.min_max(t.scored, "s", "s01").select("node_id", r6("s01"))


_ALIGN = """
SELECT node_id, dim::INT AS dim, round((val - a.m) / greatest(a.sd, 1e-6) * greatest(b.sd, 1e-6) + b.m, 6) + 0.0 AS val
FROM (SELECT lng.* FROM lng JOIN nodes USING (node_id) WHERE split = 'test')
JOIN (SELECT dim, avg(val) AS m, {0}(val) AS sd FROM lng JOIN nodes USING (node_id) WHERE split = 'test' GROUP BY 1) a USING (dim)
JOIN (SELECT dim, avg(val) AS m, {0}(val) AS sd FROM lng JOIN nodes USING (node_id) WHERE split = '{1}' GROUP BY 1) b USING (dim)"""


@query("p14_domain_alignment", "lng nodes", _ALIGN.format("stddev_samp", "cal"))
def p14(t: Tables) -> DataFrame:
    test, cal = (long_form(t.nodes.where(F.col("split") == s)) for s in ("test", "cal"))
    return S.aligned(test, test, cal).select("node_id", "dim", r6("val"))


@query("p15_moment_alignment", "lng nodes", _ALIGN.format("stddev_pop", "train"))
def p15(t: Tables) -> DataFrame:
    test, train = (long_form(t.nodes.where(F.col("split") == s)) for s in ("test", "train"))
    return S.aligned(test, test, train, "stddev_pop").select("node_id", "dim", r6("val"))


_AUC = "(sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0)"


@query("p16_score_flip", "scored", f"""
SELECT node_id, round(CASE WHEN auroc < 0.5 THEN 1 - s ELSE s END, 6) AS s FROM scored, (SELECT {_AUC} AS auroc FROM
 (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r, count(*) FILTER (y = 1) OVER () AS n1, count(*) FILTER (y = 0) OVER () AS n0 FROM scored WHERE split = 'test') GROUP BY n1, n0)""")
def p16(t: Tables) -> DataFrame:
    auroc = M.ranking_metrics(t.scored.where("split = 'test'")).select("auroc")
    return C.one_row(t.scored, auroc).select("node_id", r6(F.when(F.col("auroc") < 0.5, 1 - F.col("s")).otherwise(F.col("s")), "s"))


@query("p17_score_fusion", "rows_", "SELECT node_id, round(s + 0.5 * (1 - c), 6) AS fused FROM rows_")
def p17(t: Tables) -> DataFrame:
    return t.rows.select("node_id", r6(F.col("s") + 0.5 * (1 - F.col("c")), "fused"))


@query("w1_rank01", "scored", "SELECT node_id, round(row_number() OVER (ORDER BY s, node_id) / count(*) OVER (), 6) AS r FROM scored")
def w1(t: Tables) -> DataFrame:
    return rank01(t.scored.select("node_id", "s"), "s").select("node_id", r6("r"))


@query("w2_average_rank", "judged", "SELECT doc_id, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM judged")
def w2(t: Tables) -> DataFrame:
    return D.average_ranks(t.judged, "s", "r").select("doc_id", "r")


_WQ = """SELECT coalesce(min(s) FILTER (cw / tw >= lv), max(s)) AS threshold FROM (SELECT s, sum(w) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING) AS cw, sum(w) OVER () AS tw, {lv} AS lv FROM ({pool}))"""


@query("w3_weighted_quantile", "judged", "SELECT lang, coalesce(min(s) FILTER (cw / tw >= 0.9), max(s)) AS threshold FROM (SELECT lang, s, sum(w) OVER (PARTITION BY lang ORDER BY s RANGE UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY lang) AS tw FROM (SELECT lang, s, 1.0 + quality AS w FROM judged)) GROUP BY 1")
def w3(t: Tables) -> DataFrame:
    return D.weighted_quantile(t.judged, "s", 1.0 + F.col("quality"), F.lit(0.9), by=("lang",)).select("lang", "threshold")


@query("w4_order_statistic", "judged", "SELECT lang, s AS threshold FROM (SELECT lang, s, row_number() OVER (PARTITION BY lang ORDER BY s) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM judged WHERE y = 0) WHERE rn = least(n, greatest(1, ceil(round((n + 1) * 0.9, 6))))")
def w4(t: Tables) -> DataFrame:
    return C.split_threshold(t.judged.where("y = 0"), 0.1, ("lang",)).select("lang", "threshold")


@query("w5_lower_order_statistic", "judged", "SELECT s AS lambda_normal FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM judged WHERE y = 1) WHERE rn = least(n, greatest(1, ceil(round(0.05 * (n + 1), 6))))")
def w5(t: Tables) -> DataFrame:
    return C.normal_limit(t.judged.withColumn("split", F.lit("cal")))


@query("w7_ecdf", "judged", "SELECT v, round(fa, 6) AS fa, round(fb, 6) AS fb FROM (SELECT v, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM (SELECT s AS v, sum((y = 0)::INT) AS a, sum((y = 1)::INT) AS b FROM judged GROUP BY 1))")
def w7(t: Tables) -> DataFrame:
    return all_r6(D.ecdf_gap(t.judged.where("y = 0"), t.judged.where("y = 1"), "s"))


@query("w9_batches", "e", "SELECT node_id, ntile(7) OVER (ORDER BY md5(concat(node_id, ':42')), node_id)::INT AS batch FROM e")
def w9(t: Tables) -> DataFrame:
    return S.batches(t.nodes.select("node_id"), "node_id", 7).select("node_id", "batch")


@query("w10_qq_pairs", "scored", """
SELECT rn, a.s AS cal, b.s AS test FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn FROM scored WHERE split = 'cal') a JOIN (SELECT s, row_number() OVER (ORDER BY s) AS rn FROM scored WHERE split = 'test') b USING (rn)""")
def w10(t: Tables) -> DataFrame:
    n = lambda s: rank01(t.scored.where(F.col("split") == s).select("node_id", "s"), "s").crossJoin(F.broadcast(t.scored.where(F.col("split") == s).agg(F.count(F.lit(1)).alias("n")))).select(F.round(F.col("r") * F.col("n")).cast("bigint").alias("rn"), F.col("s").alias(s))
    return n("cal").join(n("test"), "rn")


@query("a6_global_stats", "judged", "SELECT lang, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, min(s) AS lo, max(s) AS hi, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.9), 6) AS q90 FROM judged GROUP BY 1")
def a6(t: Tables) -> DataFrame:
    moments = t.judged.groupBy("lang").agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    return all_r6(moments.join(D.quantiles(t.judged, "s", {"q25": 0.25, "q90": 0.9}, ("lang",)), "lang"))


@query("a7_lower_median", "judged", "SELECT lang, quantile_disc(s, 0.5) AS med FROM judged GROUP BY 1")
def a7(t: Tables) -> DataFrame:
    return D.lower_quantiles(t.judged, "s", {"med": 0.5}, ("lang",))


@query("a8_confusion", "judged", """
SELECT lang, tp, fp, fn, tn, round(fp / greatest(fp + tn, 1), 6) AS fpr, round(tp / greatest(tp + fn, 1), 6) AS tpr, round(tp / greatest(tp + fp, 1), 6) AS precision, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM (
 SELECT lang, count(*) FILTER (s > 2000 AND y = 1) AS tp, count(*) FILTER (s > 2000 AND y = 0) AS fp, count(*) FILTER (s <= 2000 AND y = 1) AS fn, count(*) FILTER (s <= 2000 AND y = 0) AS tn FROM judged GROUP BY 1)""")
def a8(t: Tables) -> DataFrame:
    return all_r6(M.confusion(t.judged, F.col("s") > 2000, by=("lang",)))


@query("a9_prediction_set", "judged", """
SELECT lang, round(count(*) FILTER (y = 0 AND p = 1) / greatest(count(*) FILTER (y = 0), 1), 6) AS fpr, round(count(*) FILTER (y = 1 AND p = 0) / greatest(count(*) FILTER (y = 1), 1), 6) AS fnr,
 round(count(*) FILTER (y = 1 AND p = 1) / greatest(count(*) FILTER (y = 1), 1), 6) AS tpr, round(avg((p = 2)::INT), 6) AS abstain_rate,
 round(count(*) FILTER (y = 0 AND p = 1) / nullif(count(*) FILTER (y = 0 AND p <> 2), 0), 6) AS fpr_decided, round(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (y = 1 AND p <> 2), 0), 6) AS tpr_decided, count(*) AS n
FROM (SELECT lang, y, CASE WHEN s >= 3000 AND s > 500 THEN 1 WHEN s <= 500 AND s < 3000 THEN 0 ELSE 2 END AS p FROM judged) GROUP BY 1""")
def a9(t: Tables) -> DataFrame:
    return all_r6(M.prediction_set_metrics(t.judged.withColumn("pred", M.prediction_set(F.col("s"), F.lit(500.0), F.lit(3000.0))), by=("lang",)))


@query("a10_novel_rate", "scored", "SELECT round(avg((s > q)::INT), 6) AS novel_fpr, count(*) AS n FROM scored, (SELECT quantile_cont(s, 0.95) AS q FROM scored WHERE split = 'cal' AND y = 0) WHERE is_novel AND split = 'test'")
def a10(t: Tables) -> DataFrame:
    q = D.quantiles(C.cal_rows(t.scored), "s", {"q": 0.95})
    novel = C.one_row(t.scored.where("is_novel AND split = 'test'"), q)
    return novel.agg(r6(F.avg((F.col("s") > F.col("q")).cast("double")), "novel_fpr"), F.count(F.lit(1)).alias("n"))


@query("a11_auroc_ap", "judged", f"""
WITH g AS (SELECT lang, s, count(*) AS k, sum(y) AS p FROM judged GROUP BY 1, 2), c AS (SELECT lang, p, sum(p) OVER w / sum(k) OVER w AS pr, sum(p) OVER (PARTITION BY lang) AS ap_n FROM g WINDOW w AS (PARTITION BY lang ORDER BY s DESC)),
r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2 AS r, count(*) FILTER (y = 1) OVER (PARTITION BY lang) AS n1, count(*) FILTER (y = 0) OVER (PARTITION BY lang) AS n0 FROM judged)
SELECT lang, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM (SELECT lang, {_AUC} AS auroc FROM r GROUP BY lang, n1, n0) JOIN (SELECT lang, sum(p / nullif(ap_n, 0) * pr) AS ap FROM c GROUP BY 1) USING (lang)""".replace("WITH g", ", g", 1))
def a11(t: Tables) -> DataFrame:
    return all_r6(M.ranking_metrics(t.judged, by=("lang",)))


@query("a13_effective_size", "judged", "SELECT lang, round(sum(s) * sum(s) / sum(s * s), 6) AS ess FROM judged GROUP BY 1")
def a13(t: Tables) -> DataFrame:
    return t.judged.groupBy("lang").agg(r6(M.effective_size("s"), "ess"))


_HIST = """
, ends AS (SELECT min(s) AS lo, max(s) AS hi FROM scored WHERE split IN ('cal', 'test')), cells AS (SELECT node_id, split, greatest(0, least(31, floor((s - lo) / (hi - lo) * 32))) AS cell FROM scored, ends),
h AS (SELECT cell, count(*) FILTER (split = 'cal') / (SELECT count(*) FROM cells WHERE split = 'cal') AS pa, count(*) FILTER (split = 'test') / (SELECT count(*) FROM cells WHERE split = 'test') AS pb FROM cells GROUP BY 1),
q AS (SELECT node_id, greatest(0.1, least(10.0, (pb + 0.1 / 32) / (pa + 0.1 / 32))) AS ratio FROM cells JOIN h USING (cell) WHERE split = 'cal')
SELECT node_id, round(ratio / avg(ratio) OVER (), 6) AS ratio FROM q"""


@query("a14_density_ratio", "scored", _HIST)
def a14(t: Tables) -> DataFrame:
    cal, test = (t.scored.where(F.col("split") == s) for s in ("cal", "test"))
    return C.density_ratio(cal, cal, test, "s").select("node_id", r6("ratio"))


@query("a15_over_seeds", "results", "SELECT dataset, method, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_samp(value), 6) AS std_samp, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n FROM results GROUP BY 1, 2, 3")
def a15(t: Tables) -> DataFrame:
    return all_r6(P.over_seeds(t.results))


@query("a16_t_interval", "results", "SELECT dataset, method, round(2.4469118511449692 * stddev_samp(value) / sqrt(count(*)), 6) AS half, count(*) AS n FROM results GROUP BY 1, 2 HAVING count(*) = 7")
def a16(t: Tables) -> DataFrame:
    return P.t_interval(P.over_seeds(t.results)).where("n = 7").select("dataset", "method", r6("half"), "n")


@query("a19_correlations", "judged", """
, v AS (SELECT s AS a, y::DOUBLE AS b, quality::DOUBLE AS z FROM judged), k AS (SELECT a, b, z, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2 AS rz FROM v),
c AS (SELECT corr(a, b) AS p, corr(a, z) AS az, corr(b, z) AS bz, corr(ra, rb) AS sp, corr(ra, rz) AS raz, corr(rb, rz) AS rbz FROM k)
SELECT round(p, 6) AS pearson, round(sp, 6) AS spearman, round((p - az * bz) / sqrt((1 - az * az) * (1 - bz * bz)), 6) AS partial, round((sp - raz * rbz) / sqrt((1 - raz * raz) * (1 - rbz * rbz)), 6) AS rank_partial FROM c""")
def a19(t: Tables) -> DataFrame:
    return all_r6(P.correlations(t.judged.select("s", F.col("y").cast("double").alias("b"), F.col("quality").cast("double").alias("z")), "s", "b", "z"))


@query("a20_quartile_means", "judged", """
SELECT (s >= q1)::INT + (s >= q2)::INT + (s >= q3)::INT AS cell, round(avg(y), 6) AS mean, count(*) AS n FROM judged, (SELECT quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS q2, quantile_cont(s, 0.75) AS q3 FROM judged) GROUP BY 1""")
def a20(t: Tables) -> DataFrame:
    return all_r6(P.quartile_means(t.judged, "s", "y"))


_ECDF = "(SELECT v, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb, lead(v) OVER (ORDER BY v) - v AS gap FROM (SELECT s AS v, sum(CASE WHEN {a} THEN {w} ELSE 0 END) AS a, sum(({b})::INT) AS b FROM {t} GROUP BY 1))"


@query("a21_ks", "judged", f"SELECT round(max(abs(fa - fb)), 6) AS ks FROM {_ECDF.format(a='quality = 0', b='quality = 1', w='1', t='judged')}")
def a21(t: Tables) -> DataFrame:
    return all_r6(P.ks_statistic(t.judged.where("quality = 0"), t.judged.where("quality = 1"), "s"))


@query("a21_weighted_ks", "rows_", f"SELECT round(max(abs(fa - fb)), 6) AS ks FROM {_ECDF.format(a='''split = 'cal' ''', b='''split = 'test' ''', w='c', t='''(FROM rows_ WHERE split <> 'train')''')}")
def a21w(t: Tables) -> DataFrame:
    return all_r6(P.ks_statistic(t.rows.where("split = 'cal'"), t.rows.where("split = 'test'"), "s", "c"))


@query("a23_wasserstein", "judged", f"SELECT round(sum(gap * abs(fa - fb)), 6) AS w1 FROM {_ECDF.format(a='quality = 0', b='quality = 1', w='1', t='judged')}")
def a23(t: Tables) -> DataFrame:
    return all_r6(D.wasserstein(t.judged.where("quality = 0"), t.judged.where("quality = 1"), "s"))


@query("a24_mmd", "nodes", """
SELECT round((SELECT avg(exp(-d)) FROM (SELECT list_sum(list_transform(list_zip(a.u, b.u), lambda p: (p[1] - p[2]) ** 2)) AS d FROM nodes a, nodes b WHERE a.split = 'cal' AND b.split = 'cal'))
 - 2 * (SELECT avg(exp(-d)) FROM (SELECT list_sum(list_transform(list_zip(a.u, b.u), lambda p: (p[1] - p[2]) ** 2)) AS d FROM nodes a, nodes b WHERE a.split = 'cal' AND b.split = 'test'))
 + (SELECT avg(exp(-d)) FROM (SELECT list_sum(list_transform(list_zip(a.u, b.u), lambda p: (p[1] - p[2]) ** 2)) AS d FROM nodes a, nodes b WHERE a.split = 'test' AND b.split = 'test')), 6) AS mmd2""")
def a24(t: Tables) -> DataFrame:
    unit = t.nodes.select("split", F.transform("x", lambda v: v / F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, q: s + q * q))).alias("x"))
    return all_r6(P.mmd(*(unit.where(F.col("split") == s).select("x") for s in ("cal", "test"))))


@query("a25_dominance", "scored", f"SELECT round(max(fa - fb), 6) AS excess FROM {_ECDF.format(a='''split = 'cal' AND y = 0''', b='''split = 'test' AND y = 0''', w='1', t='''(FROM scored WHERE split <> 'train' AND y = 0)''')} WHERE v >= (SELECT quantile_cont(s, 0.9) FROM scored WHERE split = 'cal' AND y = 0)")
def a25(t: Tables) -> DataFrame:
    limit = D.quantiles(C.cal_rows(t.scored), "s", {"threshold": 0.9})
    return all_r6(P.dominance(C.cal_rows(t.scored), t.scored.where("split = 'test' AND y = 0"), "s", limit))


@query("a34_paired_tests", "results", """
, d AS (SELECT a.dataset, a.metric, a.value - b.value AS diff FROM results a JOIN results b USING (dataset, seed, metric) WHERE a.method = '1-URGENT' AND b.method = '5-LOW'),
k AS (SELECT dataset, metric, diff, rank() OVER (PARTITION BY dataset, metric ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY dataset, metric, abs(diff)) - 1) / 2 AS r FROM d WHERE diff <> 0),
w AS (SELECT dataset, metric, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w_plus, count(*) FILTER (diff > 0) AS plus, count(*) AS m FROM k GROUP BY 1, 2),
s AS (SELECT dataset, metric, w_plus::DOUBLE AS w_plus, least(1.0, 2 * list_sum(list_transform(range(0, least(plus, m - plus) + 1), lambda i: factorial(m::INT) / factorial(i::INT) / factorial((m - i)::INT))) / 2 ** m) AS sign_p FROM w)
SELECT dataset, metric, n, round(mean_diff, 6) AS mean_diff, round(t, 6) AS t, round(w_plus, 6) AS w_plus, round(sign_p, 6) AS sign_p FROM (SELECT dataset, metric, count(*) AS n, avg(diff) AS mean_diff, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t FROM d GROUP BY 1, 2) LEFT JOIN s USING (dataset, metric)""")
def a34(t: Tables) -> DataFrame:
    return all_r6(P.paired_tests(P.paired(t.results, "1-URGENT", "5-LOW")))


@query("j12_paired_seeds", "results", "SELECT a.dataset, a.seed, a.metric, round(a.value - b.value, 6) AS diff FROM results a JOIN results b USING (dataset, seed, metric) WHERE a.method = '1-URGENT' AND b.method = '2-HIGH'")
def j12(t: Tables) -> DataFrame:
    return all_r6(P.paired(t.results, "1-URGENT", "2-HIGH"))


@query("j14_filled_results", "results", "SELECT dataset, seed, method, metric, round(coalesce(patch, value), 6) AS value FROM results LEFT JOIN (SELECT dataset, seed, method, metric, -1.0 AS patch FROM results WHERE method = '5-LOW' AND seed = 1995) USING (dataset, seed, method, metric)")
def j14(t: Tables) -> DataFrame:
    patch = t.results.where("method = '5-LOW' AND seed = 1995").select("dataset", "seed", "method", "metric", F.lit(-1.0).alias("value"))
    return all_r6(P.filled(t.results, patch, ["dataset", "seed", "method", "metric"]).select("dataset", "seed", "method", "metric", "value"))


@query("k11_missing_cells", "results", "SELECT dataset, seed, method FROM results WHERE seed <> 1996")
def k11(t: Tables) -> DataFrame:
    return P.missing_cells(t.results.select("dataset", "seed", "method"), t.results.where("seed = 1996"), ["dataset", "seed", "method"])


@query("a42_comparison_matrix", "results", """
SELECT method, metric, round(avg(value) FILTER (dataset = 'AUTOMOBILE'), 6) AS AUTOMOBILE, round(avg(value) FILTER (dataset = 'BUILDING'), 6) AS BUILDING, round(avg(value) FILTER (dataset = 'MACHINERY'), 6) AS MACHINERY FROM results GROUP BY 1, 2""")
def a42(t: Tables) -> DataFrame:
    return all_r6(P.comparison_matrix(P.over_seeds(t.results), ["AUTOMOBILE", "BUILDING", "MACHINERY"]))


@query("a43_best_methods", "results", "SELECT dataset, method, metric, round(m, 6) AS mean, m = max(m) OVER (PARTITION BY dataset, metric) AS is_best FROM (SELECT dataset, method, metric, avg(value) AS m FROM results GROUP BY 1, 2, 3)")
def a43(t: Tables) -> DataFrame:
    return P.best_methods(P.over_seeds(t.results)).select("dataset", "method", "metric", r6("mean"), "is_best")


@query("h23_rollup", "results", "SELECT dataset, method, round(avg(value), 6) AS mean, count(*) AS n FROM results GROUP BY ROLLUP (dataset, method)")
def h23(t: Tables) -> DataFrame:
    return t.results.rollup("dataset", "method").agg(r6(F.avg("value"), "mean"), F.count(F.lit(1)).alias("n"))


@query("o1_top_consistent", "rows_", "SELECT node_id, round(c, 6) AS c FROM rows_ WHERE split = 'test' ORDER BY rows_.c DESC, node_id LIMIT 25")
def o1(t: Tables) -> DataFrame:
    return t.rows.where("split = 'test'").orderBy(F.desc("c"), "node_id").limit(25).select("node_id", r6("c"))


@query("o3_smallest_share", "scored", "SELECT node_id FROM (SELECT node_id, row_number() OVER (ORDER BY s, node_id) AS rn, count(*) OVER () AS n FROM scored) WHERE rn <= greatest(1, floor(n * 0.1))")
def o3(t: Tables) -> DataFrame:
    n = t.scored.agg(F.count(F.lit(1)).alias("n"))
    return C.one_row(rank01(t.scored.select("node_id", "s"), "s"), n).where(F.round(F.col("r") * F.col("n")) <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))).select("node_id")


@query("o4_case_report", "scored lng", """
SELECT node_id, round(s, 6) AS s, arg_max(dim, (abs(z), -dim))::INT AS top_dim FROM (SELECT node_id, s, dim, round((val - m) / sd, 9) AS z FROM (FROM scored ORDER BY s DESC, node_id LIMIT 10) JOIN lng USING (node_id) JOIN (SELECT dim, avg(val) AS m, stddev_pop(val) AS sd FROM lng GROUP BY 1) USING (dim)) GROUP BY 1, 2""")
def o4(t: Tables) -> DataFrame:
    top = t.scored.orderBy(F.desc("s"), "node_id").limit(10).select("node_id", "s")
    z = S.standardised(long_form(t.nodes)).join(F.broadcast(top), "node_id")
    return z.groupBy("node_id", r6("s")).agg(F.max_by("dim", F.struct(F.abs(F.round("val", 9)), -F.col("dim"))).alias("top_dim"))


@query("w6_top_orders", "", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INT AS rn FROM orders) WHERE rn <= 3")
def w6(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.table("orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")
