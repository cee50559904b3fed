"""Golden cases, brute force and edge cases of operators that queries do not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distribution as D
from tidemark.functions import vectors as V
from tidemark.operators import calibrate as C
from tidemark.operators import compare as P
from tidemark.operators import harness as H
from tidemark.operators import spectrum as S
from tidemark.operators import walks as W
from tidemark.operators.detectors import build
from tidemark.operators.graph import rank01, topology_score
from tidemark.operators.neighbours import knn_graph
from tidemark.sources import models, readers


@pytest.fixture(scope="module")
def nodes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(i % 3, 1, 6).tolist(), int(i % 20 == 0), "train" if i < 80 else "cal" if i < 120 else "test", bool(170 <= i < 180)) for i in range(200)]
    df = spark.createDataFrame(rows, "node_id long, x array<double>, y int, split string, is_novel boolean").cache()
    df.count()
    return df


def test_golden_quantiles(spark):
    pool = lambda rows: spark.createDataFrame(rows, "s double, w double")
    assert D.weighted_quantile(pool([(float(v), 1.0) for v in range(1, 6)]), "s", "w", F.lit(0.5)).first()["threshold"] == 3.0
    assert D.weighted_quantile(pool([(1.0, 10.0), (2.0, 1.0), (3.0, 1.0)]), "s", "w", F.lit(0.5)).first()["threshold"] < 3.0
    rng = np.random.default_rng(1)
    scores = rng.normal(size=200)
    got = C.split_threshold(spark.createDataFrame([(float(s),) for s in scores], "s double")).first()["threshold"]
    assert got == sorted(scores)[190]


def test_selected_statistics_match_sorting(spark):
    """Many rows, ties, nulls, infinities and NaN; quantiles of all shares."""
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=30_000), np.repeat(0.25, 5_000), [np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 50, "v double").repartition(8).cache()
    qs = [0.0, 0.001, 0.1, 0.5, 0.6, 0.95, 0.999, 1.0]
    got = D.select(df, {f"q{i}": D.interpolated(F.col("v"), q) for i, q in enumerate(qs)} | {f"l{i}": D.lower(F.col("v"), q) for i, q in enumerate(qs)})
    order = np.sort(values)
    for i, q in enumerate(qs):
        place = (len(order) - 1) * q
        low, high = order[int(np.floor(place))], order[int(np.ceil(place))]
        want = low if low == high else low + (high - low) * (place - np.floor(place))
        assert got[f"q{i}"] == pytest.approx(want), q
        assert got[f"l{i}"] == order[max(1, int(np.ceil(round(len(order) * q, 9)))) - 1], q
    w = rng.gamma(2, 1, len(values))
    pool = spark.createDataFrame([(float(a), float(b)) for a, b in zip(values, w)], "s double, w double")
    for level in (0.0, 0.3, 0.95, 1.0):
        at = np.argsort(values, kind="stable")
        cum = np.cumsum(w[at]) / w.sum()
        hit = np.flatnonzero(cum >= level - 1e-12)
        assert D.weighted_quantile(pool, "s", "w", F.lit(level)).first()["threshold"] == pytest.approx(values[at][hit[0]] if len(hit) else values.max()), level
    assert D.select(df.limit(0), {"q": D.lower(F.col("v"), 0.5)}) == {"n_q": 0, "q": None}


def test_ranks_of_ties_are_cut_by_key(spark, monkeypatch):
    monkeypatch.setattr(D, "RANGE_VALUES", 50)
    rows = [(i, 0.0 if i % 3 else float(i)) for i in range(1000)]
    got = {r.node_id: r.r for r in rank01(spark.createDataFrame(rows, "node_id long, v double"), "v").collect()}
    for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        assert got[i] == pytest.approx(k / 1000)


def test_divisions_are_defined(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], 1.0, 3.0)], "a array<double>, b array<double>, c double, d double")
    assert df.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0 and df.select(V.unit_vector(F.col("a"))).first()[0] == [0.0, 0.0]
    assert np.isnan(df.select(V.correlation(F.col("c"), F.col("d"))).first()[0])
    three = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)], "a double, b double, z double")
    assert P.correlations(three, "a", "b", "z").first()["pearson"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    none = spark.createDataFrame([], "node_id long, s double, ppr double, split string, y int")
    assert C.walk_threshold(none).first()["threshold"] is None
    assert C.split_threshold(none).first()["threshold"] is None


def test_pool_cap_ties_and_empty_pools(spark):
    rows = [(i, 0.1 * (i % 7), 0.5, 0, "cal") for i in range(10)] + [(100 + i, 0.2, 0.5, i % 2, "test") for i in range(30)]
    df = spark.createDataFrame(rows, "node_id long, s double, c double, y int, split string")
    pool = C.admit(df, C.Calibration(max_pseudo_ratio=0.5))
    assert sorted(r.node_id for r in pool.where("is_pseudo").collect()) == [100, 101, 102, 103, 104]
    alone = C.weighted_threshold(df.where("split = 'cal'"), C.Calibration(weight_mode="uniform")).first()
    assert alone.n == 10 and alone.n_pseudo == 0 and alone.threshold == pytest.approx(0.6)
    assert {r.node_id for r in C.support(df.where("y = 1"), df.where("y = 1 OR node_id < 2")).collect()} == {0, 1} | {100 + i for i in range(1, 30, 2)}


def test_bias_bound_holds_in_simulation(spark):
    """Weighted thresholds with wrong weights: the rate of alarms exceeds the level by no more than the bound."""
    rng = np.random.default_rng(4)
    w = rng.gamma(2, 1, 2000)
    s = rng.uniform(size=2000)
    for delta in (0.05, 0.3):
        guess = np.maximum(w * (1 + rng.uniform(-delta, delta, 2000)), 1e-12)
        df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(s, w, guess)], "s double, w double, g double")
        t = D.weighted_quantile(df, "s", "g", F.lit(0.95)).first()["threshold"]
        rate = (w * (s > t)).sum() / w.sum()
        assert rate <= 0.05 + C.rate_bound(df, "w", "g").first()["bound"]


def test_p_values(spark):
    t = spark.createDataFrame([(2.0, 1), (2.0, 2), (2.0, 5), (-2.0, 10), (0.0, 7), (1.5, 30)], "t double, df int")
    got = [r[0] for r in t.select(P.t_tail(F.col("t"), F.col("df"))).collect()]
    assert got == pytest.approx([0.295167, 0.183503, 0.101939, 0.073388, 1.0, 0.144061], abs=1e-5)  # tables of Student's t
    n = spark.createDataFrame([(2,), (3,), (7,), (12,), (31,)], "n int")
    assert [r[0] for r in n.select(P.t_quantile(F.col("n"))).collect()] == pytest.approx([12.706205, 4.302653, 2.446912, 2.200985, 2.042272], abs=1e-4)
    diffs = spark.createDataFrame([("d", "m", x) for x in (1.0, 2.0, 3.0, 4.0, -0.5)], "dataset string, metric string, diff double")
    assert P.wilcoxon_p(diffs).first()["p_greater"] == pytest.approx(2 / 32)
    a, b = (spark.createDataFrame([(float(x),) for x in np.random.default_rng(k).normal(m, 1, 300)], "v double") for k, m in ((1, 0), (2, 1)))
    same, apart = P.ks_test(a, a, "v").first(), P.ks_test(a, b, "v").first()
    assert same.ks == 0 and same.p == 1.0 and apart.p < 1e-6


def test_principal_axes_whitening_and_alignment(spark, nodes):
    x = np.array([r.x for r in nodes.orderBy("node_id").collect()])
    mu, cov, n = S.covariance(nodes)
    assert n == 200 and mu == pytest.approx(x.mean(0)) and cov == pytest.approx(np.cov(x.T))
    white = np.array([r.x for r in S.components(nodes, 6).scores(nodes, whiten=True).orderBy("node_id").collect()])
    assert np.cov(white.T) == pytest.approx(np.eye(6), abs=1e-8)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert S.rank_at(nodes) == int(np.searchsorted(np.cumsum(values) / values.sum(), 0.9) + 1)
    edges = S.whitened_edges(nodes, 3, 4).collect()
    assert edges and all(r.src < r.dst and 0 < r.sim <= 1 for r in edges)
    moved = S.covariance_aligned(nodes, nodes, nodes.withColumn("x", F.transform("x", lambda v: 2 * v + 1)))
    assert np.cov(np.array([r.x for r in moved.collect()]).T) == pytest.approx(4 * np.cov(x.T), rel=1e-5)


def test_spectral_gap(spark, nodes):
    few = nodes.where("node_id < 40")
    knn = knn_graph(few, 5)
    pairs = [(r.i, r.j) for r in knn.collect()]
    h = np.zeros((40, 40))
    for i, j in pairs:
        h[j, i] = 1
    dv, de = np.maximum(h.sum(1), 1), np.maximum(h.sum(0), 1)
    a = h / np.sqrt(dv)[:, None]
    want = np.sort(np.linalg.eigvalsh(np.eye(40) - a @ np.diag(1 / de) @ a.T))[1]
    assert S.spectral_gap(few, knn, 12) == pytest.approx(want, abs=0.05)


def test_walks(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 4)], "src long, dst long")
    nodes = spark.range(6).withColumnRenamed("id", "node_id")
    rows = W.sampled_walks(edges, nodes, 5, 3).collect()
    assert len(rows) == 6 * 3 * 6 and sorted(map(tuple, rows)) == sorted(map(tuple, W.sampled_walks(edges, nodes, 5, 3).collect()))
    near = {0: {1}, 1: {0, 2}, 2: {1, 3}, 3: {2}, 4: set(), 5: set()}
    at = {(r.node_id, r.round, r.step): r.visited for r in rows}
    for (i, k, step), v in at.items():
        assert v == i if step == 0 else v == i or v in near[at[i, k, step - 1]]
    assert [r.node_id for r in W.walk_top(edges, nodes, 0, 2).collect()] == [1, 2]


def test_end_to_end_and_sweeps(spark, nodes):
    for method in H.METHODS:
        row = H.recalibrate(nodes, build("direction"), method, k=5).first()
        assert row is not None and 0 <= row["fpr"] <= 1 and 0 <= row["tpr"] <= 1
    with pytest.raises(ValueError):
        H.evaluate(nodes, "unknown")
    rows = H.prepared(nodes, build("direction"), k=5)
    cells = H.grid(method=["split", "nonsense"])
    out = H.sweep(cells, lambda method: H.evaluate(rows, method), spark).collect()
    assert {r.cell for r in out if r.reason is None} == {"method=split"} and [r.metric for r in out if r.reason] == [None]
    assert {r.reason: r.n for r in H.reason_counts(spark.createDataFrame(out)).collect()} == {"ValueError": 1}


def test_detectors_are_stored_and_loaded(spark, nodes, tmp_path):
    for name in ("direction", "subspace"):
        edges = spark.createDataFrame([(i, (i * 7 + 1) % 200) for i in range(200)], "src long, dst long")
        fitted = build(name).fit(nodes, edges)
        path = models.save(fitted, spark, f"{tmp_path}/{name}")
        again = models.load(spark, f"{tmp_path}/none", path)
        want = {r.node_id: r.s for r in fitted.score(nodes, edges).collect()}
        assert {r.node_id: r.s for r in again.score(nodes, edges).collect()} == pytest.approx(want)
        assert fitted.missing(nodes, fitted.score(nodes, edges)).count() == 0
    with pytest.raises(FileNotFoundError):
        models.load(spark, f"{tmp_path}/nothing")
    with pytest.raises(KeyError):
        build("no such detector")


def test_graph_files_masks_and_manifest(spark, nodes, tmp_path):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (3, 3)], "src long, dst long")
    assert readers.write_graph(nodes, edges, f"{tmp_path}/g") == {"nodes": 200, "edges": 4}
    _, links = readers.read_graph(spark, f"{tmp_path}/g/nodes", f"{tmp_path}/g/edges")
    assert sorted(map(tuple, links.collect())) == [(0, 1), (1, 2)]
    masked = spark.createDataFrame([(0, 0, True, [False]), (1, 1, True, [False]), (2, 0, None, [True, False]), (3, 0, False, None)], "node_id long, y int, tr boolean, te array<boolean>")
    assert [r.split for r in readers.official_split(masked, {"train": "tr", "test": "te"}).orderBy("node_id").collect()] == ["cal", "train", "test", "none"]
    assert {r.split for r in readers.official_split(masked, {"train": "absent"}).collect()} == {"none"}
    masks = nodes.select("node_id", F.col("split").alias("mask"))
    readers.write_mask(masks, f"{tmp_path}/m")
    assert sorted(map(tuple, readers.read_mask_rows(spark, f"{tmp_path}/m").collect())) == sorted(map(tuple, masks.collect()))
    for d in ("a", "b"):
        readers.add_to_manifest(spark, f"{tmp_path}/man", f"out/{d}", "split", d, alpha=0.05)
    assert readers.manifest(spark, f"{tmp_path}/man").count() == 2 and readers.manifest(spark, f"{tmp_path}/man", dataset="b").first()["parameters"] == '{"alpha": 0.05}'
    assert [r.label for r in readers.one_hot_label(spark.createDataFrame([([0.0, 1.0, 0.0],), ([1.0, 1.0],)], "label array<double>")).collect()] == [1, 0]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "c.csv").write_text("txId,class\n1,1\n2,2\n3,unknown\n")
    (tmp_path / "f.csv").write_text("1,0.5,1\n2,0.25,2\n3,0,0\n")
    (tmp_path / "e.csv").write_text("a,b\n1,2\n2,3\n")
    got, links = readers.read_csv_triple(spark, *(f"{tmp_path}/{x}.csv" for x in "cfe"))
    assert sorted((r.node_id, r.x, r.y) for r in got.collect()) == [("1", [0.5, 1.0], 1), ("2", [0.25, 2.0], 0)] and [tuple(r) for r in links.collect()] == [("1", "2")]
    np.savez(tmp_path / "g.npz", feature=np.ones((3, 2), np.float32), label=np.array([0, 1, 0]), edge_index=np.array([[0, 1], [1, 2]]), scores=np.array([0.1, 0.2, 0.3]), y=np.array([0, 1, 0]))
    assert readers.read_npz(spark, f"{tmp_path}/g.npz", "nodes").count() == 3
    assert sorted((r.src, r.dst) for r in readers.read_npz(spark, f"{tmp_path}/g.npz", "edges").collect()) == [(0, 1), (1, 2)]
    assert [round(r.s, 6) for r in readers.read_npz(spark, f"{tmp_path}/g.npz", "scores").orderBy("node_id").collect()] == [0.1, 0.2, 0.3]
    (tmp_path / "mask.json").write_text('{"train": [1, 2], "cal": [3], "note": "x"}')
    assert sorted(map(tuple, readers.read_mask(spark, f"{tmp_path}/mask.json").collect())) == [(1, "train"), (2, "train"), (3, "cal")]
    (tmp_path / "photo_s3_x.json").write_text('{"alpha": 0.05, "method": "m", "metric": "fpr", "value": 0.1}')
    row = readers.read_results(spark, f"{tmp_path}/photo_s*.json").first()
    assert (row.dataset, row.seed, row.value) == ("photo", 3, 0.1)
    keys = ["dataset", "seed", "method"]
    cells = lambda *s: spark.createDataFrame([("d", i, 0.05, "m", "fpr", float(i)) for i in s], readers.RESULT_SCHEMA)
    readers.append_results(cells(1, 2), f"{tmp_path}/res", keys)
    readers.append_results(cells(2, 3), f"{tmp_path}/res", keys)
    assert sorted(r.seed for r in spark.read.parquet(f"{tmp_path}/res").collect()) == [1, 2, 3]
    assert sorted(map(tuple, readers.multi_relation({"a": cells(1).select(F.lit(1).alias("src"), F.lit(2).alias("dst")), "b": cells(1).select(F.lit(1).alias("src"), F.lit(2).alias("dst"))}).collect())) == [(1, 2)]
    assert readers.symmetric(spark.createDataFrame([(1, 2), (2, 2)], "src long, dst long")).count() == 2
    n, e = readers.block_model(spark, (30, 10), 0.3, 0.05)
    assert n.count() == 40 and e.where("src >= dst").count() == 0
    with pytest.raises(ValueError):
        readers.block_model(spark, (readers.MOST_BLOCK_NODES, 1))


def small_graph(spark):
    """Five nodes of a path with one repeated edge; node 3 has no length, node 4 no edge."""
    x = np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 2.0], [0.0, 0.0], [3.0, 1.0]])
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, x array<double>")
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 3)], "src long, dst long")
    return x, nodes, edges


def test_topology_score_against_brute_force(spark):
    x, nodes, edges = small_graph(spark)
    near = {0: [1], 1: [0, 2], 2: [1, 3], 3: [2], 4: []}
    length = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    ld = np.log1p([len(near[i]) for i in range(5)])
    sign = np.array([1 - np.mean([u[i] @ u[j] for j in near[i]]) if near[i] else 1.0 for i in range(5)])
    away = np.minimum(np.abs(ld - np.median(ld)) / ld.std(), 5)
    around = np.minimum([abs(ld[i] - (np.mean(ld[near[i]]) if near[i] else ld[i])) / ld.std() for i in range(5)], 5)
    want = np.mean([(c - c.min()) / (c.max() - c.min()) for c in (sign, away, around)], axis=0)
    got = {r.node_id: r.topo for r in topology_score(edges, nodes).collect()}
    assert np.allclose([got[i] for i in range(5)], want, atol=1e-9)


def test_wavelet_network_against_dense_matrices(spark):
    x, nodes, edges = small_graph(spark)
    rng = np.random.default_rng(1)
    shapes = {"w1": (3, 2), "w2": (3, 3), "f0": (2, 3), "f1": (2, 3), "f2": (2, 3), "w3": (3, 6), "w4": (2, 3)}
    w = {k: rng.normal(size=s) for k, s in shapes.items()}
    w |= {("fb" + k[1:] if k[0] == "f" else "b" + k[1:]): rng.normal(size=s[0]) for k, s in shapes.items()}
    a = np.eye(5)
    for i, j in ((0, 1), (1, 0), (1, 2), (2, 3)):
        a[i, j] += 1
        a[j, i] += 1
    d = a.sum(1)
    lap = np.eye(5) - a / np.sqrt(np.outer(d, d))
    layer = lambda h, k, b: h @ w[k].T + w[b]
    h = np.maximum(layer(np.maximum(layer(x, "w1", "b1"), 0), "w2", "b2"), 0)
    power = np.linalg.matrix_power
    beta = {0: 1 / 3, 1: 1 / 6, 2: 1 / 3}  # B(p + 1, q + 1) of p + q = 2
    bands = [power(lap, p) @ power(2 * np.eye(5) - lap, 2 - p) @ h / (8 * beta[p]) for p in range(3)]
    z = np.hstack([np.maximum(layer(b, f"f{p}", f"fb{p}"), 0) for p, b in enumerate(bands)])
    o = layer(np.maximum(layer(z, "w3", "b3"), 0), "w4", "b4")
    want = 1 / (1 + np.exp(o[:, 0] - o[:, 1]))
    got = {r.node_id: r.s for r in build("wavelet", weights=w).score(nodes, edges).collect()}
    assert np.allclose([got[i] for i in range(5)], want, atol=1e-9)
