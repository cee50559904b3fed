"""Queries on detectors, density ratios, controls and summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distribution as D
from ..functions.lineage import durable
from ..functions.vectors import correlation, dot, hash_uniform, norm
from ..operators import calibrate as C
from ..operators import compare as P
from ..operators import detectors as M
from ..operators import neighbours as N
from ..operators import split as S
from .graphs import _ADMIT, _SUM
from .registry import all_r6, query, r6
from .tables import Tables


@query("a17_composite_keys", "results", "SELECT dataset, seed, round(avg(value), 6) AS mean, count(*) AS n FROM results GROUP BY 1, 2")
def a17(t: Tables) -> DataFrame:
    """Groups by the parts of a composed key."""
    keyed = t.results.select(F.concat_ws("|", "dataset", "seed", "method").alias("key"), "value").withColumn("part", F.split("key", r"\|"))
    return keyed.groupBy(F.col("part")[0].alias("dataset"), F.col("part")[1].cast("int").alias("seed")).agg(r6(F.avg("value"), "mean"), F.count(F.lit(1)).alias("n"))


@query("a18_pooled_correlation", "judged", "SELECT lang, count(*) AS n, round(corr(s, quality), 6) AS pearson FROM judged GROUP BY 1")
def a18(t: Tables) -> DataFrame:
    return t.judged.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(correlation(F.col("s"), F.col("quality")), "pearson"))


@query("a33_bootstrap_interval", "results", """
, v AS (SELECT value AS v, row_number() OVER (ORDER BY concat(dataset, ':', seed)) - 1 AS k FROM results WHERE method = '1-URGENT'), n AS (SELECT count(*) AS n FROM v),
p AS (SELECT d AS draw, floor(('0x' || substr(md5(concat(d, ':', s, ':1')), 1, 8))::BIGINT / 4294967296.0 * n)::BIGINT AS k FROM (SELECT d, n, unnest(range(1, n + 1)) AS s FROM n, (SELECT unnest(range(0, 200)) AS d))),
m AS (SELECT draw, avg(v) AS m FROM p JOIN v USING (k) GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(m), 6) AS mean FROM m""")
def a33(t: Tables) -> DataFrame:
    values = t.results.where("method = '1-URGENT'").select("value", F.concat_ws(":", "dataset", F.col("seed").cast("string")).alias("key"))
    return all_r6(P.bootstrap_interval(values, "value", "key", 200))


@query("c13_random_weights", "scored", "SELECT node_id, round(('0x' || substr(md5(concat(node_id, ':13')), 1, 8))::BIGINT / 4294967296.0, 6) AS w FROM scored WHERE split = 'cal'")
def c13(t: Tables) -> DataFrame:
    return t.scored.where("split = 'cal'").select("node_id", r6(hash_uniform("node_id", F.lit(13)), "w"))


@query("c15_feature_norm", "nodes", "SELECT node_id, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS w FROM (SELECT node_id, sqrt(list_dot_product(x, x)) AS v FROM nodes)")
def c15(t: Tables) -> DataFrame:
    return S.min_max(t.nodes.select("node_id", norm(F.col("x")).alias("v")), "v", "w").select("node_id", r6("w"))


@query("h25_score_profile", "scored", "SELECT split, y, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round(min(s), 6) AS lo, round(max(s), 6) AS hi FROM scored GROUP BY 1, 2")
def h25(t: Tables) -> DataFrame:
    return all_r6(t.scored.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"), F.min("s").alias("lo"), F.max("s").alias("hi")))


@query("t8_external_weights", "cal test", _ADMIT.format(gamma=1.0) + """
, wp AS (SELECT *, w0 / greatest(avg(w0) OVER (PARTITION BY is_pseudo), 1e-12) * CASE WHEN is_pseudo THEN 0.5 ELSE 1 END AS w FROM (SELECT *, 1 + s AS w0 FROM pool))
""" + _SUM + "SELECT round(coalesce((SELECT min(s) FROM cum WHERE f >= least(1, 0.95 * (s3.n + 1) / s3.n)), (SELECT max(s) FROM cum)), 6) AS threshold FROM s3")
def t8(t: Tables) -> DataFrame:
    return all_r6(C.externally_weighted_threshold(t.rows.withColumn("ext", 1 + F.col("s")), "ext"))


@query("t13_smoothed_alarms", "nodes scored", """
, sm AS (SELECT q AS node_id, round(avg(s), 9) AS z FROM (SELECT a.node_id AS q, b.node_id AS j, row_number() OVER (PARTITION BY a.node_id ORDER BY CASE WHEN a.node_id = b.node_id THEN -1 ELSE round(1 - list_dot_product(a.u, b.u), 9) END, b.node_id) AS rn
 FROM nodes a, nodes b WHERE a.split IN ('cal', 'test') AND b.split IN ('cal', 'test')) JOIN scored ON j = scored.node_id WHERE rn <= 6 GROUP BY 1),
k AS (SELECT quantile_cont(z, 0.95) AS q FROM sm JOIN scored USING (node_id) WHERE split = 'cal' AND y = 0) SELECT node_id, round(z, 6) AS z, z > q AS alarm FROM sm JOIN scored USING (node_id), k WHERE split = 'test'""")
def t13(t: Tables) -> DataFrame:
    """Alarms on scores averaged over neighbours, against a quantile of averaged calibration scores."""
    open_nodes = t.nodes.where("split <> 'train'")
    near = N.nearest(open_nodes, open_nodes, 6).join(t.scored.select(F.col("node_id").alias("j"), "s"), "j")
    smoothed = near.groupBy(F.col("i").alias("node_id")).agg(F.round(F.avg("s"), 9).alias("z")).join(t.scored.drop("s"), "node_id")
    smoothed = durable(smoothed)
    limit = D.quantiles(smoothed.where("split = 'cal' AND y = 0"), "z", {"q": 0.95})
    return C.one_row(smoothed.where("split = 'test'"), limit).select("node_id", r6("z"), (F.col("z") > F.col("q")).alias("alarm"))


@query("c12_logistic_ratio")
def c12(t: Tables) -> DataFrame:
    cal, test = (t.nodes.where(F.col("split") == s) for s in ("cal", "test"))
    return M.logistic_ratio(cal, test, cal)


@query("c11_kernel_ratio")
def c11(t: Tables) -> DataFrame:
    cal, test = (t.nodes.where(F.col("split") == s) for s in ("cal", "test"))
    return M.kernel_ratio(cal, test, cal)


@query("m12_subspace_scores")
def m12(t: Tables) -> DataFrame:
    return M.build("subspace").fit(t.nodes, t.edges).score(t.nodes, t.edges)


@query("m11_boosted_scores")
def m11(t: Tables) -> DataFrame:
    return M.build("boosted", trees=5, depth=3).fit(t.nodes, t.edges).score(t.nodes, t.edges)


@query("m1_wavelet_scores")
def m1(t: Tables) -> DataFrame:
    """Scores of a network trained on the training nodes; learning is beyond SQL, tests hold its gradients against finite differences."""
    from ..operators.training import train

    return train("wavelet", t.nodes, t.edges, hidden=8, epochs=10)[0].score(t.nodes, t.edges)


@query("m3_convolution_scores")
def m3(t: Tables) -> DataFrame:
    from ..operators.training import train

    return train("convolution", t.nodes, t.edges, hidden=8, epochs=10)[0].score(t.nodes, t.edges)


@query("m4_attention_vectors")
def m4(t: Tables) -> DataFrame:
    rng = np.random.default_rng(0)
    return M.attention(t.edges, t.nodes, rng.normal(0, 0.3, (4, 64)), rng.normal(0, 1, 4), rng.normal(0, 1, 4)).select("node_id", r6(dot(F.col("x"), F.col("x")), "square"))


@query("m5_autoencoder_scores")
def m5(t: Tables) -> DataFrame:
    """Scores of the neighbourhood autoencoder; tests hold its losses and gradients against dense loops."""
    from ..operators.autoencoder import Autoencoder

    return Autoencoder(epochs=10).fit(t.nodes, t.edges).score(t.nodes, t.edges)


@query("m5_neighbourhood_loss", "lng knn ways", """
, near AS (SELECT src AS node_id, dim, avg(val) AS m, ln(greatest(avg(val * val) - avg(val) ** 2, 1e-6)) AS lv FROM ways JOIN lng ON dst = lng.node_id GROUP BY 1, 2),
own AS (SELECT i AS node_id, dim, avg(val) AS m, ln(greatest(avg(val * val) - avg(val) ** 2, 1e-6)) AS lv FROM knn JOIN lng ON j = lng.node_id GROUP BY 1, 2),
d AS (SELECT src AS node_id, count(*) AS n FROM ways GROUP BY 1)
SELECT node_id, round(0.8 * avg((own.m - val) ** 2) + 0.5 * (ln(12) - ln(1 + any_value(n))) ** 2 + 0.001 * sum(0.5 * (near.lv - own.lv + (exp(own.lv) + (own.m - near.m) ** 2) / exp(near.lv) - 1)), 6) AS s
FROM lng JOIN own USING (node_id, dim) JOIN near USING (node_id, dim) JOIN d USING (node_id) GROUP BY 1""")
def m5_loss(t: Tables) -> DataFrame:
    """Loss of neighbourhoods that are rebuilt by the moments and the number of the nearest vectors."""
    from ..operators.autoencoder import moments, neighbourhood_loss, neighbourhoods

    width = 64
    own = moments(t.knn.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1 / 11).alias("w")), t.nodes, "x", width)
    goal = t.nodes.select("node_id", "x").join(neighbourhoods(t.nodes, t.edges, "x", width), "node_id").select("node_id", F.struct("x", "d", "mu", "lv").alias("goal"))
    rebuilt = own.select("node_id", F.struct(F.col("mu").alias("x"), F.log1p(F.lit(11)).alias("d"), "mu", "lv").alias("rebuilt"))
    return goal.join(rebuilt, "node_id").select("node_id", r6(neighbourhood_loss("goal", "rebuilt"), "s"))


@query("m6_reconstruction_scores", "nodes cent edges", """
, er AS (SELECT src, dst, 1 - 1 / (1 + exp(-list_dot_product(a.centroid, b.centroid))) AS e FROM edges JOIN cent a ON a.node_id = src JOIN cent b ON b.node_id = dst),
inc AS (SELECT node_id, avg(e) AS e FROM (SELECT unnest([src, dst]) AS node_id, e FROM er) GROUP BY 1)
SELECT node_id, round(0.8 * sqrt(list_sum(list_transform(list_zip(x, centroid), lambda p: (p[1] - p[2]) ** 2))) + 0.2 * coalesce(inc.e, 0), 6) AS s FROM nodes JOIN cent USING (node_id) LEFT JOIN inc USING (node_id)""")
def m6(t: Tables) -> DataFrame:
    """Errors of a reconstruction by neighbours' mean vectors."""
    from ..operators.graph import neighbour_centroids

    rebuilt = neighbour_centroids(t.knn, t.nodes).withColumnRenamed("centroid", "x")
    return all_r6(M.reconstruction_scores(t.nodes, rebuilt, t.edges))


@query("m9_prompt_scores")
def m9(t: Tables) -> DataFrame:
    """Scores of the classifier with trained prompts; tests hold its gradients against dense loops."""
    from ..operators.prompts import Prompts

    return Prompts(hidden=8, size=8, epochs=5, rate=0.01).fit(t.nodes, t.edges).score(t.nodes, t.edges)


@query("m17_pseudo_classes")
def m17(t: Tables) -> DataFrame:
    return M.pseudo_classes(t.nodes)


@query("t10_grid_temperature", "scored", """
, z AS (SELECT ln(p / (1 - p)) AS z FROM (SELECT greatest(1e-6, least(1 - 1e-6, s)) AS p FROM scored WHERE split = 'cal' AND y = 0)), r AS (SELECT t::DOUBLE AS temperature, avg((1 / (1 + exp(-z / t)) > 0.45)::INT) AS fpr FROM z, (SELECT unnest([0.5, 1.0, 2.0, 4.0]) AS t) GROUP BY 1)
SELECT temperature, round(fpr, 6) AS fpr FROM r ORDER BY abs(fpr - 0.05), temperature LIMIT 1""")
def t10(t: Tables) -> DataFrame:
    return all_r6(C.grid_temperature(t.scored, [0.5, 1.0, 2.0, 4.0], cut=0.45))


@query("t18_total_level", "rows_", """
, k AS (SELECT s, c AS w FROM rows_ WHERE split = 'cal' AND y = 0), f AS (SELECT s, sum(w) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING) / sum(w) OVER () AS f, count(*) OVER () AS n FROM k)
SELECT round(coalesce(min(s) FILTER (f >= least(1, ceil(round((n + 1) * 0.95, 6)) / n)), max(s)), 6) AS threshold FROM f""")
def t18(t: Tables) -> DataFrame:
    return all_r6(C.total_level_threshold(C.cal_rows(t.rows), "c"))


@query("u5_support", "nodes", "SELECT node_id FROM nodes WHERE (split = 'train' AND y = 0) OR y = 1")
def u5(t: Tables) -> DataFrame:
    return C.support(t.nodes.where("split = 'train' AND y = 0"), t.nodes.where("y = 1"))


@query("k5_random_masks", "e", """
SELECT node_id, trial::INT AS trial, CASE WHEN rn <= floor(0.4 * n) THEN 'train' ELSE 'test' END AS split FROM (SELECT node_id, trial, row_number() OVER (PARTITION BY trial ORDER BY md5(concat(trial, '/', node_id, ':42')), concat(trial, '/', node_id)) AS rn, count(*) OVER (PARTITION BY trial) AS n
 FROM e, (SELECT unnest(range(0, 5)) AS trial))""")
def k5(t: Tables) -> DataFrame:
    from ..sources.readers import random_masks

    return random_masks(t.nodes, 5)


@query("s9_coordinates", "", "SELECT o_custkey AS node_id, " + ", ".join(f"count(*) FILTER (year(o_orderdate) = {1992 + d})::DOUBLE AS x{d}" for d in range(4)) + " FROM orders GROUP BY 1 HAVING count(*) FILTER (year(o_orderdate) < 1996) > 0")
def s9(t: Tables) -> DataFrame:
    """Orders per customer and year as vectors from coordinates."""
    from ..sources.readers import from_coordinates

    entries = t.table("orders").select("o_custkey", (F.year("o_orderdate") - 1992).alias("year"), F.lit(1.0).alias("one")).where("year < 4")
    return from_coordinates(entries, 4, "o_custkey", "year", "one").select("node_id", *[F.get("x", d).alias(f"x{d}") for d in range(4)])


@query("h20_agreement_by_cut", "judged", "SELECT cut::DOUBLE AS cut, round(avg(((s >= cut)::INT = y)::INT), 6) AS agreement, count(*) AS n FROM judged, (SELECT unnest([500.0, 2000.0, 8000.0]) AS cut) GROUP BY 1")
def h20(t: Tables) -> DataFrame:
    from ..operators.harness import agreement_by_cut

    return all_r6(agreement_by_cut(t.judged, "s", "y", [500.0, 2000.0, 8000.0]))


@query("a25_label_free_monitor", "scored", """
, g AS (SELECT s AS v, sum((split = 'cal')::INT) AS a, sum((split = 'test')::INT) AS b FROM scored WHERE split <> 'train' GROUP BY 1), f AS (SELECT v, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM g)
SELECT round(max(fa - greatest(0, least(1, (fb - 0.05) / 0.95))), 6) AS excess FROM f WHERE v >= 0.3""")
def a25m(t: Tables) -> DataFrame:
    return all_r6(P.dominance_monitor(t.scored.where("split = 'cal'"), t.scored.where("split = 'test'"), "s", 0.3, 0.05))


@query("h1_compare_methods")
def h1(t: Tables) -> DataFrame:
    """Three methods on one detector as a sweep."""
    from ..operators import harness as H

    rows = t.rows
    cells = H.grid(method=["split", "weighted", "adaptive"])
    return H.sweep(cells, lambda method: H.evaluate(rows, method), t.spark)


@query("m8_sampled_walks")
def m8(t: Tables) -> DataFrame:
    from ..operators.walks import sampled_walks

    return sampled_walks(t.edges, t.seeds, 4, 2)


_TOP_EPS = 1e-4
_DIFFUSION = f"""
, d AS (SELECT src AS node_id, count(*)::DOUBLE AS deg FROM ways GROUP BY 1),
w AS (SELECT src, dst, d.deg AS to_deg FROM ways JOIN d ON d.node_id = dst),
state AS (WITH RECURSIVE st AS (
 SELECT node_id AS seed, node_id, coalesce(deg, 0) AS deg, 0.0::DOUBLE AS mass, 1.0::DOUBLE AS rest, 0 AS r FROM nodes LEFT JOIN d USING (node_id) WHERE split = 'cal' AND y = 0
 UNION ALL
 SELECT seed, node_id, max(deg), sum(mass), sum(rest), r + 1 FROM (
  SELECT seed, node_id, deg, mass + CASE WHEN rest > {_TOP_EPS} * deg THEN CASE WHEN deg = 0 THEN rest ELSE 0.15 * rest END ELSE 0 END AS mass, CASE WHEN rest > {_TOP_EPS} * deg THEN 0 ELSE rest END AS rest, r FROM st
  UNION ALL SELECT seed, dst, to_deg, 0, 0.85 * rest / deg, r FROM st JOIN w ON st.node_id = src WHERE rest > {_TOP_EPS} * deg)
 WHERE EXISTS (SELECT 1 FROM st WHERE rest > {_TOP_EPS} * deg) GROUP BY seed, node_id, r)
 SELECT * FROM st WHERE r = (SELECT max(r) FROM st))
SELECT seed, node_id, round(mass, 6) AS mass, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(mass, 9) DESC, node_id) AS rank FROM state WHERE node_id <> seed AND mass > 0) WHERE rank <= 10"""


@query("m8_diffusion_top", "nodes ways", _DIFFUSION)
def m8_top(t: Tables) -> DataFrame:
    """The ten nodes nearest to each calibration normal by diffusion; the twin pushes in the same rounds."""
    from ..operators.diffusion import diffusion_top

    return all_r6(diffusion_top(t.edges, t.seeds, 10, eps=_TOP_EPS).select("seed", "node_id", "mass", "rank"))


@query("m7_contrastive_scores")
def m7(t: Tables) -> DataFrame:
    """Scores of a discriminator trained on walks; learning is beyond SQL, tests hold its gradient against finite differences."""
    from ..operators.contrastive import Contrastive

    return Contrastive(hidden=8, epochs=5, rounds=16, train_rounds=5).fit(t.nodes, t.edges).score(t.nodes, t.edges)
