"""Queries on neighbourhoods, graphs and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distribution as D
from ..functions import metrics as M
from ..functions.lineage import durable
from ..functions.vectors import long_form
from ..operators import calibrate as C
from ..operators import graph as G
from ..operators import neighbours as N
from ..operators.cells import report as cell_report
from ..operators.graph import rank01
from .registry import ORACLES, all_r6, query, r6
from .tables import Tables

DICT = "list_dot_product"


@query("j1_knn", "knn", "SELECT i, j, rank, round(dist, 6) AS dist FROM knn")
def j1(t: Tables) -> DataFrame:
    return t.knn.select("i", "j", "rank", r6("dist"))


@query("j3_knn_edges", "nodes", """
SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst FROM (SELECT a.node_id AS i, b.node_id AS j, row_number() OVER (PARTITION BY a.node_id ORDER BY round(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) ** 2))), 9), b.node_id) AS rn
FROM nodes a, nodes b WHERE a.node_id <> b.node_id) WHERE rn <= 5""")
def j3(t: Tables) -> DataFrame:
    return N.undirected(N.knn_graph(t.nodes, 5, "euclidean"), "i", "j")


@query("j4_gaussian_edges", "knn", "SELECT least(i, j) AS src, greatest(i, j) AS dst, round(max(exp(-dist * dist / 2)), 6) AS sim FROM knn WHERE i <> j GROUP BY 1, 2")
def j4(t: Tables) -> DataFrame:
    return all_r6(N.gaussian_edges(t.knn))


@query("j5_smoothed_scores", "nodes scored", """
SELECT q AS node_id, round(avg(s), 6) AS s FROM (SELECT a.node_id AS q, b.node_id AS j, row_number() OVER (PARTITION BY a.node_id ORDER BY CASE WHEN a.node_id = b.node_id THEN -1 ELSE round(1 - list_dot_product(a.u, b.u), 9) END, b.node_id) AS rn
FROM nodes a, nodes b WHERE a.split = 'test' AND b.split IN ('cal', 'test')) JOIN scored ON j = scored.node_id WHERE rn <= 6 GROUP BY 1""")
def j5(t: Tables) -> DataFrame:
    near = N.nearest(t.nodes.where("split = 'test'"), t.nodes.where("split <> 'train'"), 6)
    return near.join(t.scored.select(F.col("node_id").alias("j"), "s"), "j").groupBy(F.col("i").alias("node_id")).agg(r6(F.avg("s"), "s"))


@query("j2_approximate_recall")
def j2(t: Tables) -> DataFrame:
    """Recall of the inverted cells for the ids that 50 divides, and the share of pairs compared for it."""
    return cell_report(t.nodes.select("node_id", "x"), 10)


@query("j9_induced_subgraph", "edges nodes", "SELECT src, dst FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE split <> 'train') AND dst IN (SELECT node_id FROM nodes WHERE split <> 'train')")
def j9(t: Tables) -> DataFrame:
    return G.induced(t.edges, t.nodes.where("split <> 'train'"))


@query("j10_anti", "trade traders", "SELECT node_id, nation FROM traders WHERE node_id NOT IN (SELECT src FROM trade UNION SELECT dst FROM trade)")
def j10(t: Tables) -> DataFrame:
    touched = t.trade.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return t.traders.select("node_id", "nation").join(touched, "node_id", "left_anti")


@query("j10_outside_pool", "cal test", """, st AS (SELECT quantile_cont(c, 0.5) AS tau, max(s) + greatest(stddev_samp(s), 1e-6) AS s_upper, count(*) AS cap FROM cal),
ps AS (SELECT node_id FROM (SELECT test.node_id, row_number() OVER (ORDER BY test.c DESC, node_id) AS rn, cap FROM test, st WHERE test.c >= tau AND test.s <= s_upper) WHERE rn <= cap)
SELECT node_id, y FROM test WHERE node_id NOT IN (FROM ps)""")
def j10p(t: Tables) -> DataFrame:
    """Test rows that the pool does not hold."""
    pool = C.admit(t.rows, C.Calibration()).where("is_pseudo").select("node_id")
    return t.rows.where("split = 'test'").join(pool, "node_id", "left_anti").select("node_id", "y")


@query("j11_negative_edges", "nodes edges", """
, r AS (SELECT node_id, row_number() OVER (ORDER BY md5(concat(node_id, ':11')), node_id) AS rn, count(*) OVER () AS n FROM nodes),
p AS (SELECT DISTINCT least(a.node_id, b.node_id) AS src, greatest(a.node_id, b.node_id) AS dst FROM (SELECT *, unnest([3, 7, 13, 29]) AS st FROM r) a JOIN r b ON b.rn = (a.rn - 1 + st) % a.n + 1 WHERE a.node_id <> b.node_id)
SELECT src, dst FROM p ANTI JOIN edges USING (src, dst) ORDER BY md5(concat(src, ':', dst)), src, dst LIMIT 200""")
def j11(t: Tables) -> DataFrame:
    return G.negative_edges(t.nodes, t.edges, 200)


@query("j15_random_neighbours", "nodes", """
, r AS (SELECT node_id, row_number() OVER (ORDER BY md5(concat(node_id, ':7')), node_id) AS rn, count(*) OVER () AS n FROM nodes)
SELECT a.node_id AS i, b.node_id AS j, k::INT AS rank FROM (SELECT *, unnest(range(0, 6)) AS k FROM r) a JOIN r b ON b.rn = (a.rn - 1 + k) % a.n + 1""")
def j15(t: Tables) -> DataFrame:
    return N.random_neighbours(t.nodes, 5)


@query("a1_hypergraph_degrees", "deg", "SELECT * FROM deg")
def a1(t: Tables) -> DataFrame:
    return G.hypergraph_degrees(t.knn)


@query("a2_endpoint_degrees", "trade", "SELECT node_id, count(*) AS deg FROM (SELECT src AS node_id FROM trade UNION ALL SELECT dst FROM trade) GROUP BY 1")
def a2(t: Tables) -> DataFrame:
    return G.endpoint_degrees(t.trade)


@query("a2_neighbour_degrees", "ways", "SELECT src AS node_id, count(DISTINCT dst) AS deg FROM ways GROUP BY 1")
def a2n(t: Tables) -> DataFrame:
    return G.neighbour_degrees(t.edges)


@query("p4_without_hubs", "trade traders", """
, d AS (SELECT node_id, coalesce(deg, 0) AS deg FROM traders LEFT JOIN (SELECT node_id, count(*) AS deg FROM (SELECT src AS node_id FROM trade UNION ALL SELECT dst FROM trade) GROUP BY 1) USING (node_id))
SELECT node_id, deg FROM d WHERE deg <= (SELECT greatest(1, floor(quantile_cont(deg, 0.98))) FROM d)""")
def p4(t: Tables) -> DataFrame:
    return G.without_hubs(t.traders, t.trade)


_LOW = """low{n} AS (SELECT j AS node_id, dim, sum(m / sqrt(dv)) AS val FROM (SELECT k.j, dim, m / de AS m, dj.d_v AS dv FROM knn k JOIN (SELECT i, dim, sum(val / sqrt(d_v)) AS m, any_value(de) AS de FROM (SELECT k.i, l.dim, l.val, d.d_v, di.d_e AS de FROM knn k JOIN {src} l ON l.node_id = k.j JOIN deg d ON d.node_id = k.j JOIN deg di ON di.node_id = k.i) GROUP BY 1, 2) e ON e.i = k.i JOIN deg dj ON dj.node_id = k.j) GROUP BY 1, 2)"""


@query("a3_smooth", "knn lng deg", f", {_LOW.format(n=1, src='lng')} SELECT node_id, dim::INT AS dim, round(val, 6) + 0.0 AS val FROM low1")
def a3(t: Tables) -> DataFrame:
    return G.smooth(long_form(t.nodes), t.knn).select("node_id", "dim", r6("val"))


@query("a4_propagate", "knn lng deg", f""", {_LOW.format(n=1, src='lng')}, x1 AS (SELECT node_id, dim, 0.4 * lng.val + 0.5 * l.val + 0.1 * (lng.val - l.val) AS val FROM lng JOIN low1 l USING (node_id, dim)),
{_LOW.format(n=2, src='x1')} SELECT node_id, dim::INT AS dim, round(0.4 * x1.val + 0.5 * l.val + 0.1 * (x1.val - l.val), 6) + 0.0 AS val FROM x1 JOIN low2 l USING (node_id, dim)""")
def a4(t: Tables) -> DataFrame:
    return G.propagate(long_form(t.nodes), t.knn, 2, 0.5, 0.1).select("node_id", "dim", r6("val"))


@query("a5_neighbour_scores", "knn scores", "SELECT i AS node_id, round(quantile_disc(s, 0.5), 6) AS med, round(avg(s), 6) AS mean FROM knn JOIN scores ON j = scores.node_id GROUP BY 1")
def a5(t: Tables) -> DataFrame:
    return all_r6(G.neighbour_scores(t.knn, t.scores))


_COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0})) / sqrt(list_dot_product({1}, {1}))"

_CONS = f"""
, p AS (SELECT node_id, split, abs(s - med) AS dev, 1 - {_COS.format('x', 'centroid')} AS dist FROM nodes JOIN cent USING (node_id) JOIN scores USING (node_id) JOIN (SELECT i AS node_id, quantile_disc(s, 0.5) AS med FROM knn JOIN scores ON j = scores.node_id GROUP BY 1) USING (node_id)),
k AS (SELECT greatest(avg(dev), 1e-8) AS m1, greatest(avg(dist), 1e-8) AS m2 FROM p WHERE split = 'cal'), q AS (SELECT node_id, exp(-dev / m1) AS c_score, exp(-dist / m2) AS c_feat, dev, dist FROM p, k)
"""


@query("c1_consistency", "nodes cent scores knn", _CONS + "SELECT node_id, round(greatest(1e-8, least(1.0, sqrt(c_score * c_feat))), 6) AS c, round(c_score, 6) AS c_score, round(c_feat, 6) AS c_feat, round(dev, 6) AS dev, round(dist, 6) AS dist FROM q")
def c1(t: Tables) -> DataFrame:
    return all_r6(G.consistency(t.nodes, t.knn, t.scores, parts=True))


@query("c2_contrastive_consistency", "cons", "SELECT node_id, round(c, 6) AS c FROM cons")
def c2(t: Tables) -> DataFrame:
    return t.rows.select("node_id", r6("c"))


@query("c4_consistency_weights", "rows_", """
, w AS (SELECT node_id, greatest(0.05, least(20.0, exp((c - ref) / (sd + 1e-8)))) AS w FROM rows_, (SELECT quantile_disc(c, 0.5) AS ref, stddev_samp(c) AS sd FROM rows_ WHERE split = 'test') WHERE split = 'cal')
SELECT node_id, round(w / avg(w) OVER (), 6) AS w FROM w""")
def c4(t: Tables) -> DataFrame:
    return C.consistency_weights(t.rows.where("split = 'cal'"), t.rows.where("split = 'test'"), C.Calibration()).select("node_id", r6("w"))


@query("a26_class_homophily", "knn nodes", """
SELECT y, count(*) AS n, round(avg(((ones > 0.5)::INT = y)::INT), 6) AS agree, round(avg(CASE WHEN y = 1 THEN ones ELSE 1 - ones END), 6) AS like FROM (SELECT a.y, a.node_id, avg(b.y) AS ones FROM knn JOIN nodes a ON i = a.node_id JOIN nodes b ON j = b.node_id WHERE i <> j GROUP BY 1, 2) GROUP BY 1""".replace(" AS like", ' AS "like"'))
def a26(t: Tables) -> DataFrame:
    return all_r6(G.class_homophily(t.knn, t.nodes))


@query("a27_edge_homophily", "trade traders", "SELECT round(avg((a.nation = b.nation)::INT), 6) AS homophily, count(*) AS n_edges FROM trade JOIN traders a ON src = a.node_id JOIN traders b ON dst = b.node_id")
def a27(t: Tables) -> DataFrame:
    return all_r6(G.edge_homophily(t.trade, t.traders.withColumnRenamed("nation", "y")))


_SQ = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) ** 2))"


@query("a28_dirichlet_energy", "knn nodes deg", f"""
, v AS (SELECT node_id, list_transform(x, lambda q: q / sqrt(d_v)) AS z FROM nodes JOIN deg USING (node_id)) SELECT i AS node_id, round(sum({_SQ.format('a.z', 'b.z')}), 6) AS energy FROM knn JOIN v a ON a.node_id = i JOIN v b ON b.node_id = j WHERE i <> j GROUP BY 1""")
def a28(t: Tables) -> DataFrame:
    return all_r6(G.dirichlet_energy(t.knn, t.nodes))


@query("a29_graph_energy", "ways nodes", f"""
, d AS (SELECT src AS node_id, count(*) AS deg FROM ways GROUP BY 1), v AS (SELECT node_id, list_transform(x, lambda q: q / sqrt(deg)) AS z FROM nodes JOIN d USING (node_id))
SELECT node_id, round(coalesce(energy, 0), 6) AS energy FROM nodes LEFT JOIN (SELECT src AS node_id, sum({_SQ.format('a.z', 'b.z')}) AS energy FROM ways JOIN v a ON a.node_id = src JOIN v b ON b.node_id = dst GROUP BY 1) USING (node_id)""")
def a29(t: Tables) -> DataFrame:
    return all_r6(G.graph_energy(t.edges, t.nodes))


@query("a31_dispersion", "nodes cent scores knn", _CONS + "SELECT y, round(avg(dist), 6) AS dispersion FROM q JOIN nodes USING (node_id) GROUP BY 1")
def a31(t: Tables) -> DataFrame:
    return all_r6(G.consistency(t.nodes, t.knn, t.scores, True).join(t.nodes.select("node_id", "y"), "node_id").groupBy("y").agg(F.avg("dist").alias("dispersion")))


@query("a32_separability", "rows_", """
SELECT round((sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auroc FROM (SELECT y, rank() OVER (ORDER BY -c) + (count(*) OVER (PARTITION BY c) - 1) / 2 AS r, count(*) FILTER (y = 1) OVER () AS n1, count(*) FILTER (y = 0) OVER () AS n0 FROM rows_) GROUP BY n1, n0""")
def a32(t: Tables) -> DataFrame:
    return M.ranking_metrics(t.rows.withColumn("s", -F.col("c"))).select(r6("auroc"))


@query("a36_neighbour_moments", "edges lng", """
SELECT dst AS node_id, dim::INT AS dim, round(avg(val), 6) + 0.0 AS mean, round(ln(greatest(avg(val * val) - avg(val) * avg(val), 1e-6)), 6) AS log_var FROM edges JOIN lng ON src = lng.node_id GROUP BY 1, 2""")
def a36(t: Tables) -> DataFrame:
    return all_r6(G.neighbour_moments(t.edges, t.nodes))


@query("a37_neighbour_stack", "ways lng", """
, r1 AS (SELECT l.node_id, l.dim, coalesce(m, 0) AS val FROM lng l LEFT JOIN (SELECT w.src AS node_id, dim, avg(val) AS m FROM ways w JOIN lng ON w.dst = lng.node_id GROUP BY 1, 2) USING (node_id, dim))
SELECT node_id, 0 AS round, dim::INT AS dim, round(val, 6) + 0.0 AS val FROM lng UNION ALL SELECT node_id, 1, dim::INT, round(val, 6) + 0.0 FROM r1""")
def a37(t: Tables) -> DataFrame:
    return G.neighbour_stack(t.edges, t.nodes, 1).select("node_id", "round", "dim", r6("val"))


@query("a38_incident_error", "edges scores", "SELECT node_id, round(avg(e), 6) AS err FROM (SELECT unnest([src, dst]) AS node_id, abs(a.s - b.s) AS e FROM edges JOIN scores a ON a.node_id = src JOIN scores b ON b.node_id = dst) GROUP BY 1")
def a38(t: Tables) -> DataFrame:
    a, b = (t.scores.select(F.col("node_id").alias(k), F.col("s").alias(f"s_{k}")) for k in ("src", "dst"))
    errors = t.edges.join(a, "src").join(b, "dst").select("src", "dst", F.abs(F.col("s_src") - F.col("s_dst")).alias("e"))
    return all_r6(G.incident_error(t.edges, errors))


_TOPO = """
, d AS (SELECT node_id, ln(1 + coalesce(k, 0)) AS ld FROM nodes LEFT JOIN (SELECT src AS node_id, count(*) AS k FROM ways GROUP BY 1) USING (node_id)),
m AS (SELECT src AS node_id, avg(list_dot_product(a.u, b.u)) AS alike FROM ways JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst GROUP BY 1),
n AS (SELECT src AS node_id, avg(ld) AS nd FROM ways JOIN d ON dst = d.node_id GROUP BY 1), k AS (SELECT quantile_cont(ld, 0.5) AS mid, greatest(stddev_pop(ld), 1e-6) AS sd FROM d),
p AS (SELECT node_id, 1 - coalesce(alike, 0) AS a, least(abs(ld - mid) / sd, 5) AS b, least(abs(ld - coalesce(nd, ld)) / sd, 5) AS c FROM nodes JOIN d USING (node_id) LEFT JOIN m USING (node_id) LEFT JOIN n USING (node_id), k)
SELECT node_id, round(((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) + (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ())) / 3, 6) AS topo FROM p"""


@query("a35_topology_score", "ways nodes", _TOPO)
def a35(t: Tables) -> DataFrame:
    return all_r6(G.topology_score(t.edges, t.nodes))


_SEED = "sd AS (SELECT node_id, CASE WHEN split = 'cal' AND y = 0 THEN 1.0 / (SELECT count(*) FROM nodes WHERE split = 'cal' AND y = 0) ELSE 0 END AS v FROM nodes)"
_PUSH = "p{n} AS (SELECT sd.node_id, 0.15 * sd.v + 0.85 * coalesce(m, 0) AS v FROM sd LEFT JOIN (SELECT dst AS node_id, sum(v / k) AS m FROM ways JOIN {src} q ON q.node_id = src JOIN (SELECT src, count(*) AS k FROM ways GROUP BY 1) USING (src) GROUP BY 1) USING (node_id))"
_PULL = "p{n} AS (SELECT sd.node_id, 0.15 * sd.v + 0.85 * coalesce(m, 0) AS v FROM sd LEFT JOIN (SELECT src AS node_id, avg(v) AS m FROM ways JOIN {src} q ON q.node_id = dst GROUP BY 1) USING (node_id))"


@query("c8_pagerank_3", "ways nodes", ", " + ", ".join([_SEED] + [_PUSH.format(n=i, src="sd" if i == 1 else f"p{i - 1}") for i in (1, 2, 3)]) + " SELECT node_id, round(v, 6) AS ppr FROM p3")
def c8(t: Tables) -> DataFrame:
    return all_r6(G.pagerank(t.edges, t.nodes, t.seeds, rounds=3))


@query("c9_structure_score")
def c9(t: Tables) -> DataFrame:
    return all_r6(G.structure_score(t.edges, t.nodes, t.seeds, rounds=30))


@query("c10_pull_kernel", "ways nodes", ", " + ", ".join([_SEED] + [_PULL.format(n=i, src="sd" if i == 1 else f"p{i - 1}") for i in (1, 2, 3)]) + " SELECT node_id, round(v, 6) AS ppr FROM p3")
def c10(t: Tables) -> DataFrame:
    return all_r6(G.pull_kernel(t.edges, t.nodes, t.seeds))


@query("c14_adjacency_consistency", "ways scores", """
, s AS (SELECT stddev_samp(s) AS sd FROM scores) SELECT node_id, round(coalesce(greatest(0, least(1, 1 - abs(m - s) / (2 * sd))), 0), 6) AS c FROM scores LEFT JOIN (SELECT src AS node_id, avg(s) AS m FROM ways JOIN scores ON dst = scores.node_id GROUP BY 1) USING (node_id), s""".replace(", s AS", ", sdv AS").replace(", s\"", "").replace("USING (node_id), s", "USING (node_id), sdv"))
def c14(t: Tables) -> DataFrame:
    means = N.both_ways(t.edges).distinct().join(t.scores.select(F.col("node_id").alias("dst"), "s"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.avg("s").alias("m"))
    sd = t.scores.agg(F.stddev_samp("s").alias("sd"))
    c = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.col("m") - F.col("s")) / (2 * F.col("sd")))), F.lit(0.0))
    return C.one_row(t.scores.join(means, "node_id", "left"), sd).select("node_id", r6(c, "c"))


@query("c16_cosine_deviation", "knn lng nodes", f"SELECT node_id, round(1 - {_COS.format('x', 'm')}, 6) AS dev FROM nodes JOIN (SELECT i AS node_id, list(v ORDER BY dim) AS m FROM (SELECT i, dim, avg(val) AS v FROM knn JOIN lng ON j = lng.node_id WHERE i <> j GROUP BY 1, 2) GROUP BY 1) USING (node_id)")
def c16(t: Tables) -> DataFrame:
    from ..functions.vectors import cosine

    near = t.nodes.join(G.neighbour_centroids(t.knn, t.nodes, include_self=False), "node_id")
    return near.select("node_id", r6(1 - cosine(F.col("x"), F.col("centroid")), "dev"))


@query("u2_densified", "edges trade", "SELECT src, dst FROM edges UNION SELECT src, dst FROM trade")
def u2(t: Tables) -> DataFrame:
    return N.undirected(t.edges.union(t.trade))


@query("u1_union_all", "edges", "SELECT count(*) AS n, count(DISTINCT (src, dst)) AS n_distinct FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges UNION ALL SELECT src, dst FROM edges)")
def u1(t: Tables) -> DataFrame:
    everything = N.both_ways(t.edges).unionAll(t.edges)
    return everything.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src", "dst").alias("n_distinct"))


# Thresholds

_ADMIT = """
, st AS (SELECT quantile_cont(c, 0.5) AS tau, max(s) + {gamma} * greatest(stddev_samp(s), 1e-6) AS s_upper, count(*) AS cap FROM cal),
ps AS (SELECT * FROM (SELECT test.*, row_number() OVER (ORDER BY test.c DESC, node_id) AS rn, cap FROM test, st WHERE test.c >= tau AND test.s <= s_upper) WHERE rn <= cap),
pool AS (SELECT node_id, s, c, y, false AS is_pseudo FROM cal UNION ALL SELECT node_id, s, c, y, true FROM ps)
"""
_WEIGH = {
    "contrastive": ", wp AS (SELECT *, (c + 1e-8) * CASE WHEN is_pseudo THEN 0.5 ELSE 1 END AS w FROM pool)",
    "uniform": ", wp AS (SELECT *, (CASE WHEN is_pseudo THEN 0.5 ELSE 1.0 END)::DOUBLE AS w FROM pool)",
    "struct": """, raw AS (SELECT pool.*, greatest(0.05, least(20.0, exp((c - ref) / (sd + 1e-8)))) AS w0 FROM pool, (SELECT quantile_disc(c, 0.5) AS ref, stddev_samp(c) AS sd FROM test)),
wp AS (SELECT *, w0 / avg(w0) OVER () * CASE WHEN is_pseudo THEN 0.5 ELSE 1 END AS w FROM raw)""",
}
_SUM = """, sm AS (SELECT count(*) AS n, count(*) FILTER (is_pseudo) AS n_pseudo, min(w) AS w_min, max(w) AS w_max, sum(w) ** 2 / sum(w * w) AS ess, coalesce(sum(w) FILTER (is_pseudo) ** 2 / sum(w * w) FILTER (is_pseudo), 0) AS ess_pseudo FROM wp),
s2 AS (SELECT *, greatest(0, least(1, 1 - ess / n)) AS decay FROM sm), s3 AS (SELECT *, least(1, decay / 2 + 1 / (n + 1)) AS bias_bound FROM s2),
cum AS (SELECT s, sum(greatest(w, 1e-12)) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING) / sum(greatest(w, 1e-12)) OVER () AS f FROM wp)
"""
_COLS = "n, n_pseudo, round(w_min, 6) AS w_min, round(w_max, 6) AS w_max, round(ess, 6) AS ess, round(ess_pseudo, 6) AS ess_pseudo, round(decay, 6) AS decay, round(bias_bound, 6) AS bias_bound"


def _threshold_sql(mode: str, gamma: float = 1.0) -> str:
    return _ADMIT.format(gamma=gamma) + _WEIGH[mode] + _SUM + f"SELECT round(coalesce((SELECT min(s) FROM cum WHERE f >= least(1, 0.95 * (s3.n + 1) / s3.n)), (SELECT max(s) FROM cum)), 6) AS threshold, {_COLS} FROM s3"


for _mode in C.WEIGHT_MODES:

    def _t2(t: Tables, mode: str = _mode) -> DataFrame:
        return all_r6(C.weighted_threshold(t.rows, C.Calibration(weight_mode=mode)))

    query(f"t2_threshold_{_mode}", "cal test", _threshold_sql(_mode))(_t2)


@query("t2_pool", "cal test", _ADMIT.format(gamma=1.0) + "SELECT node_id, round(s, 6) AS s, round(c, 6) AS c, y, is_pseudo FROM pool")
def t2_pool(t: Tables) -> DataFrame:
    return all_r6(C.admit(t.rows, C.Calibration()))


@query("t5_adaptive_threshold", "cal test", _ADMIT.format(gamma=1.0) + _WEIGH["struct"] + _SUM + f""", s4 AS (SELECT *, least(0.1, 0.05 + 0.05 * decay) AS alpha_eff FROM s3)
SELECT round(coalesce((SELECT min(s) FROM cum WHERE f >= least(1, (1 - s4.alpha_eff) * (s4.n + 1) / s4.n)), (SELECT max(s) FROM cum)), 6) AS threshold, {_COLS}, round(alpha_eff, 6) AS alpha_eff FROM s4""")
def t5(t: Tables) -> DataFrame:
    return all_r6(C.adaptive_threshold(t.rows))


@query("t3_soft_threshold", "cal test", """
, k AS (SELECT quantile_disc(c, 0.5) AS ref, stddev_samp(c) AS sd FROM test), a AS (SELECT node_id, s, greatest(0.05, least(20.0, exp((c - ref) / (sd + 1e-8)))) AS w0 FROM cal, k), b AS (SELECT node_id, s, greatest(0.05, least(20.0, exp((c - ref) / (sd + 1e-8)))) AS w0 FROM test, k),
b2 AS (SELECT node_id, s, w0 / avg(w0) OVER () * 0.3 AS w FROM b), wp AS (SELECT node_id, s, w0 / avg(w0) OVER () AS w, false AS is_pseudo FROM a UNION ALL SELECT node_id, s, w, true FROM b2 WHERE w >= (SELECT quantile_cont(w, 0.3) FROM b2))
""" + _SUM + f"SELECT round(coalesce((SELECT min(s) FROM cum WHERE f >= least(1, 0.95 * (s3.n + 1) / s3.n)), (SELECT max(s) FROM cum)), 6) AS threshold, {_COLS} FROM s3")
def t3(t: Tables) -> DataFrame:
    return all_r6(C.soft_threshold(t.rows))


@query("t4_robust_calibration", "rows_", """
, c0 AS (SELECT * FROM rows_ WHERE split = 'cal'), m AS (SELECT quantile_disc(c, 0.5) AS med FROM c0), d AS (SELECT quantile_disc(abs(c - med), 0.5) AS mad FROM c0, m) SELECT node_id FROM c0, m, d WHERE c >= med - 2 * 1.4826 * mad""")
def t4(t: Tables) -> DataFrame:
    return C.cal_rows(t.rows, robust=True).select("node_id")


@query("t6_dual_threshold", "cal test rows_", _ADMIT.format(gamma=1.0) + _WEIGH["contrastive"] + _SUM + """SELECT
round((SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS k FROM rows_ WHERE split = 'cal' AND y = 1) WHERE rn = least(k, greatest(1, ceil(round(0.05 * (k + 1), 6))))), 6) AS lambda_normal,
round(coalesce((SELECT min(s) FROM cum WHERE f >= least(1, 0.95 * (s3.n + 1) / s3.n)), (SELECT max(s) FROM cum)), 6) AS lambda_anomaly FROM s3""")
def t6(t: Tables) -> DataFrame:
    return all_r6(C.dual_threshold(t.rows, C.Calibration(weight_mode="contrastive")))


@query("t6_dual_metrics", "cal test rows_", _ADMIT.format(gamma=1.0) + _WEIGH["contrastive"] + _SUM + """, lim AS (SELECT
(SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS k FROM rows_ WHERE split = 'cal' AND y = 1) WHERE rn = least(k, greatest(1, ceil(round(0.05 * (k + 1), 6))))) AS ln,
coalesce((SELECT min(s) FROM cum WHERE f >= least(1, 0.95 * (s3.n + 1) / s3.n)), (SELECT max(s) FROM cum)) AS la FROM s3),
p AS (SELECT y, CASE WHEN s >= la AND s > ln THEN 1 WHEN s <= ln AND s < la THEN 0 ELSE 2 END AS p FROM test, lim)
SELECT round(count(*) FILTER (y = 0 AND p = 1) / greatest(count(*) FILTER (y = 0), 1), 6) AS fpr, round(count(*) FILTER (y = 1 AND p = 0) / greatest(count(*) FILTER (y = 1), 1), 6) AS fnr,
 round(count(*) FILTER (y = 1 AND p = 1) / greatest(count(*) FILTER (y = 1), 1), 6) AS tpr, round(avg((p = 2)::INT), 6) AS abstain_rate,
 round(count(*) FILTER (y = 0 AND p = 1) / nullif(count(*) FILTER (y = 0 AND p <> 2), 0), 6) AS fpr_decided, round(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (y = 1 AND p <> 2), 0), 6) AS tpr_decided, count(*) AS n FROM p""")
def t6m(t: Tables) -> DataFrame:
    both = C.one_row(t.rows.where("split = 'test'"), C.dual_threshold(t.rows, C.Calibration(weight_mode="contrastive")))
    return all_r6(M.prediction_set_metrics(both.withColumn("pred", M.prediction_set(F.col("s"), F.col("lambda_normal"), F.col("lambda_anomaly")))))


def _proxied(t: Tables) -> DataFrame:
    """Rows with their distance to the mean of the calibration normals."""
    from ..functions.vectors import mean_vector, squared_distance

    mu = mean_vector(t.nodes.where("split = 'cal' AND y = 0"))
    proxy = t.nodes.crossJoin(F.broadcast(mu)).select("node_id", F.round(F.sqrt(squared_distance(F.col("x"), F.col("mu"))), 9).alias("proxy"))
    return durable(t.scored.join(proxy, "node_id").withColumn("c", F.lit(1.0)))


_PROXY = """
, mm AS (SELECT list(m ORDER BY d) AS mu FROM (SELECT d, avg(v) AS m FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS d FROM nodes WHERE split = 'cal' AND y = 0) GROUP BY d)),
pr AS (SELECT scored.*, round(sqrt(list_sum(list_transform(list_zip(x, mu), lambda p: (p[1] - p[2]) ** 2))), 9) AS proxy FROM scored JOIN nodes USING (node_id), mm), pc AS (SELECT * FROM pr WHERE split = 'cal' AND y = 0)
"""


@query("t7_generic_threshold")
def t7(t: Tables) -> DataFrame:
    return all_r6(C.generic_weighted_threshold(_proxied(t)))


@query("t9_temperature", "scored", """
, c AS (SELECT s FROM scored WHERE split = 'cal' AND y = 0), k AS (SELECT greatest(avg(s), 1e-4) AS temperature FROM c) SELECT round(s / temperature, 6) AS threshold, round(temperature, 6) AS temperature FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM c), k WHERE rn = least(n, greatest(1, ceil(round((n + 1) * 0.95, 6))))""")
def t9(t: Tables) -> DataFrame:
    return all_r6(C.temperature_threshold(t.scored))


@query("t11_binned_threshold", "scored nodes", _PROXY + """
, k AS (SELECT quantile_cont(proxy, 0.25) AS q1, quantile_cont(proxy, 0.5) AS q2, quantile_cont(proxy, 0.75) AS q3 FROM pc), b AS (SELECT (proxy >= q1)::INT + (proxy >= q2)::INT + (proxy >= q3)::INT AS cell, quantile_cont(s, 0.95) AS threshold FROM pc, k GROUP BY 1)
SELECT node_id, cell, round(threshold, 6) AS threshold FROM (SELECT node_id, (proxy >= q1)::INT + (proxy >= q2)::INT + (proxy >= q3)::INT AS cell FROM pr, k WHERE split = 'test') LEFT JOIN b USING (cell)""")
def t11(t: Tables) -> DataFrame:
    return all_r6(C.binned_quantile_threshold(_proxied(t)))


@query("t12_distance_threshold", "scored nodes", _PROXY + """
, n AS (SELECT count(*) AS n, least(1, ceil(round((count(*) + 1) * 0.95, 6)) / count(*)) AS q FROM pc), o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k FROM pc), p AS (SELECT (n - 1) * q AS place FROM n),
l AS (SELECT (SELECT s FROM o WHERE k = floor(place)) AS a, (SELECT s FROM o WHERE k = ceil(place)) AS b, place FROM p), m AS (SELECT a + (b - a) * (place - floor(place)) AS q_low, (SELECT quantile_disc(proxy, 0.5) FROM pc) AS near FROM l)
SELECT node_id, round(CASE WHEN proxy <= near THEN q_low ELSE q_low * 1.05 END, 6) AS threshold FROM pr, m WHERE split = 'test'""")
def t12(t: Tables) -> DataFrame:
    return all_r6(C.distance_threshold(_proxied(t)))


@query("t14_walk_threshold", "ways nodes scored", ", " + ", ".join([_SEED] + [_PULL.format(n=i, src="sd" if i == 1 else f"p{i - 1}") for i in (1, 2, 3)]) + """
, c AS (SELECT s, round(v, 9) AS w FROM scored JOIN p3 USING (node_id) WHERE split = 'cal'), k AS (SELECT sum(w) AS tw, count(*) AS m FROM c), a AS (SELECT s, w / tw AS w FROM c, k UNION ALL SELECT 'inf'::DOUBLE, 1 / m FROM k),
f AS (SELECT s, sum(greatest(w, 1e-12)) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING) / sum(greatest(w, 1e-12)) OVER () AS f FROM a) SELECT round(min(s), 6) AS threshold FROM f WHERE f >= 0.95""")
def t14(t: Tables) -> DataFrame:
    walk = G.pull_kernel(t.edges, t.nodes, t.seeds).withColumn("ppr", F.round("ppr", 9))
    return all_r6(C.walk_threshold(t.scored.join(walk, "node_id")))


@query("t16_rate_bound", "judged", "SELECT round(delta, 6) AS delta, n, round(least(1, delta / 2 + 1 / (n + 1)), 6) AS bound FROM (SELECT greatest(0, least(1, sum(abs(s - greatest(s * (0.8 + 0.1 * quality), 1e-12))) / greatest(sum(s), 1e-12))) AS delta, count(*) AS n FROM judged)")
def t16(t: Tables) -> DataFrame:
    return all_r6(C.rate_bound(t.judged.withColumn("guess", F.col("s") * (0.8 + 0.1 * F.col("quality"))), "s", "guess"))


@query("t19_oracle_tpr", "scored", "SELECT round(avg((s > q)::INT), 6) AS tpr FROM scored, (SELECT quantile_cont(s, 0.95) AS q FROM scored WHERE split = 'test' AND y = 0) WHERE split = 'test' AND y = 1")
def t19(t: Tables) -> DataFrame:
    q = D.quantiles(t.scored.where("split = 'test' AND y = 0"), "s", {"q": 0.95})
    return C.one_row(t.scored.where("split = 'test' AND y = 1"), q).agg(r6(F.avg((F.col("s") > F.col("q")).cast("double")), "tpr"))


@query("t20_band_enrichment", "judged", "SELECT round(avg(y) FILTER (s > 500 AND s < 3000) / avg(y), 6) AS enrichment FROM judged")
def t20(t: Tables) -> DataFrame:
    band = (F.col("s") > 500) & (F.col("s") < 3000)
    return t.judged.agg(r6(F.avg(F.when(band, F.col("y"))) / F.avg("y"), "enrichment"))


@query("t21_risk_coverage", "judged", """
, b AS (SELECT unnest([0.02, 0.05, 0.1, 0.2]) AS beta), l AS (SELECT beta, s AS low FROM (SELECT beta, s, row_number() OVER (PARTITION BY beta ORDER BY s) AS rn, count(*) OVER (PARTITION BY beta) AS n FROM judged, b WHERE y = 1) WHERE rn = least(n, greatest(1, ceil(round(beta * (n + 1), 6))))),
p AS (SELECT beta, y, CASE WHEN s >= 3000 AND s > low THEN 1 WHEN s <= low AND s < 3000 THEN 0 ELSE 2 END AS p FROM judged, l)
SELECT beta::DOUBLE AS beta, round(1 - avg((p = 2)::INT), 6) AS coverage, round(count(*) FILTER (y = 1 AND p = 0) / greatest(count(*) FILTER (y = 1), 1), 6) AS fnr FROM p GROUP BY 1""")
def t21(t: Tables) -> DataFrame:
    grid = t.spark.createDataFrame([(b,) for b in (0.02, 0.05, 0.1, 0.2)], "beta double")
    rows = t.judged.crossJoin(F.broadcast(grid)).withColumn("split", F.lit("cal"))
    low = C.normal_limit(rows, F.col("beta"), ("beta",))
    rated = rows.join(F.broadcast(low), "beta").withColumn("pred", M.prediction_set(F.col("s"), F.col("lambda_normal"), F.lit(3000.0)))
    return M.prediction_set_metrics(rated, by=("beta",)).select("beta", r6(1 - F.col("abstain_rate"), "coverage"), r6("fnr"))


@query("t22_contaminated", "rows_", """
, c AS (SELECT *, row_number() OVER (ORDER BY md5(concat(node_id, ':5')), node_id) AS rn, count(*) OVER () AS n FROM rows_ WHERE split = 'cal' AND y = 0), q AS (SELECT quantile_cont(s, 0.075) AS o FROM c)
SELECT node_id, round(CASE WHEN rn <= floor(0.1 * n) THEN o ELSE s END, 6) AS s, rn <= floor(0.1 * n) AS replaced FROM c, q""")
def t22(t: Tables) -> DataFrame:
    return C.contaminated(t.rows, 0.1).select("node_id", r6("s"), "replaced")


@query("t23_stressed_pool", "cal test", _ADMIT.format(gamma=1.0) + """
, nrm AS (SELECT node_id, s, c, y FROM pool WHERE is_pseudo AND y = 0), an AS (SELECT node_id, s, c, y, row_number() OVER (ORDER BY md5(concat(node_id, ':3')), node_id) AS rn FROM test WHERE y = 1)
SELECT node_id, round(s, 6) AS s, round(c, 6) AS c, y FROM nrm UNION ALL SELECT node_id, round(s, 6), round(c, 6), y FROM an WHERE rn <= (SELECT round(0.1 * count(*) / 0.9) FROM nrm)""")
def t23(t: Tables) -> DataFrame:
    pool = C.admit(t.rows, C.Calibration())
    return all_r6(C.stress_pool(pool, t.rows.where("split = 'test' AND y = 1"), 0.1))


@query("h3_alpha_curve", "scored", """
, c AS (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM scored WHERE split = 'cal' AND y = 0) SELECT alpha::DOUBLE AS alpha, round(s, 6) AS threshold FROM c, (SELECT unnest([0.01, 0.05, 0.1, 0.2]) AS alpha) WHERE rn = least(n, greatest(1, ceil(round((n + 1) * (1 - alpha), 6))))""")
def h3(t: Tables) -> DataFrame:
    return all_r6(C.alpha_curve(t.scored, [0.01, 0.05, 0.1, 0.2]))


@query("r1_batched_recalibration", "cal test", """
, b AS (SELECT *, ntile(4) OVER (ORDER BY md5(concat(node_id, ':42')), node_id)::INT AS batch FROM test), st AS (SELECT quantile_cont(c, 0.5) AS tau, max(s) + greatest(stddev_samp(s), 1e-6) AS s_upper, count(*) AS cap FROM cal),
ps AS (SELECT * FROM (SELECT b.batch, b.s, b.c, row_number() OVER (PARTITION BY batch ORDER BY b.c DESC, node_id) AS rn, cap FROM b, st WHERE b.c >= tau AND b.s <= s_upper) WHERE rn <= cap),
pl AS (SELECT batch, s, c + 1e-8 AS w FROM cal, (SELECT DISTINCT batch FROM b) UNION ALL SELECT batch, s, (c + 1e-8) * 0.5 FROM ps),
cm AS (SELECT batch, s, sum(w) OVER (PARTITION BY batch ORDER BY s RANGE UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY batch) AS f, count(*) OVER (PARTITION BY batch) AS n FROM pl),
th AS (SELECT batch, coalesce(min(s) FILTER (f >= least(1, 0.95 * (n + 1) / n)), max(s)) AS t FROM cm GROUP BY 1)
SELECT batch, node_id, round(t, 6) AS threshold, s > t AS alarm FROM b JOIN th USING (batch)""")
def r1(t: Tables) -> DataFrame:
    """Alarms of test batches, each calibrated by its own rows only, as one plan."""
    return batch_alarms(t).select("batch", "node_id", r6("threshold"), "alarm")


def batch_alarms(t: Tables) -> DataFrame:
    from ..operators.split import batches
    from ..streaming.stateful import alarms_by_batch

    test = durable(batches(t.rows.where("split = 'test'"), "node_id", 4))
    return alarms_by_batch(t.rows.where("split = 'cal'"), test)


@query("r2_pooled_confusion", "", "WITH r AS (" + ORACLES["r1_batched_recalibration"] + """)
SELECT count(*) FILTER (alarm AND label = 0) AS tp, count(*) FILTER (alarm AND label <> 0) AS fp, count(*) FILTER (NOT alarm AND label = 0) AS fn, count(*) FILTER (NOT alarm AND label <> 0) AS tn FROM r JOIN embeddings ON vec_id = node_id""")
def r2(t: Tables) -> DataFrame:
    """One confusion over all batches."""
    return M.confusion(batch_alarms(t), F.col("alarm")).select("tp", "fp", "fn", "tn")


@query("r3_inductive_batches", "nodes scored", """
, nb AS (SELECT i, j FROM (SELECT a.node_id AS i, b.node_id AS j, row_number() OVER (PARTITION BY a.node_id ORDER BY CASE WHEN a.node_id = b.node_id THEN -1 ELSE round(1 - list_dot_product(a.u, b.u), 9) END, b.node_id) AS rn FROM nodes a, nodes b WHERE a.split IN ('cal', 'test') AND b.split = 'cal') WHERE rn <= 10),
mem AS (SELECT DISTINCT i, j FROM (SELECT i, j FROM nb UNION ALL SELECT node_id, node_id FROM nodes WHERE split IN ('cal', 'test'))),
ct AS (SELECT i AS node_id, list(m ORDER BY d) AS g FROM (SELECT i, d, avg(v) AS m FROM (SELECT i, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM mem JOIN nodes ON j = node_id) GROUP BY 1, 2) GROUP BY 1),
mm AS (SELECT list(m ORDER BY d) AS mu FROM (SELECT d, avg(v) AS m FROM (SELECT unnest(u) AS v, generate_subscripts(u, 1) AS d FROM nodes WHERE split = 'cal' AND y = 0) GROUP BY d))
SELECT node_id, round(1 / (1 + exp(-list_dot_product(u, g) / sqrt(list_dot_product(g, g)))) / (1 + exp(-list_dot_product(u, mu) / sqrt(list_dot_product(mu, mu)))), 6) AS c FROM nodes JOIN ct USING (node_id), mm WHERE split = 'test'""")
def r3(t: Tables) -> DataFrame:
    """Consistency of test rows that sees calibration rows only, as a stream's batches are judged."""
    from ..streaming.stateful import inductive_rows

    found = inductive_rows(t.nodes.where("split = 'cal'"), t.nodes.where("split = 'test'"))
    return found.join(t.nodes.where("split = 'test'").select("node_id"), "node_id").select("node_id", r6("c"))


@query("x_window_drift", "", """
WITH w AS (SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, sum(value) AS total, sum(value * value) AS sq FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, sum(n) OVER o AS bn, sum(total) OVER o AS bt, sum(sq) OVER o AS bs FROM w WINDOW o AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CASE WHEN bn >= 2 THEN (bs - bt * bt / bn) / (bn - 1) END AS spread FROM b)
SELECT user_id, day, n, round(total / n, 6) AS mean, round(CASE WHEN spread > 1e-12 THEN (total / n - bt / bn) / sqrt(spread / n) END, 6) AS deviation FROM v""")
def x_drift(t: Tables) -> DataFrame:
    """Daily means of each user against all days before."""
    from ..streaming.stateful import window_drift_batch

    found = window_drift_batch(t.table("events"))
    return found.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("day"), "n", r6("mean"), F.round("deviation", 6).alias("deviation"))


@query("x_windowed_rates", "", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def x_windows(t: Tables) -> DataFrame:
    from ..streaming.recalibrate import windowed_rates

    return windowed_rates(t.table("events")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "errors", r6("mean_value"))


@query("x_sessions", "", """
, g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, value, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""".replace(", g AS", "WITH g AS", 1))
def x_sessions(t: Tables) -> DataFrame:
    from ..streaming.recalibrate import sessions

    return sessions(t.table("events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def _ranked(t: Tables) -> DataFrame:
    return rank01(t.scored.select("node_id", "s"), "s")
