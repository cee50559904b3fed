"""The neighbourhood autoencoder: losses and gradients against dense loops, planted anomalies, resuming, defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.metrics import ranking_metrics
from tidemark.operators.autoencoder import Autoencoder, NeighbourhoodNetwork

SHARES = (0.7, 0.4, 0.05)
EDGES = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (1, 4), (6, 2), (2, 1), (3, 3)]


def graph(spark):
    """Nine nodes, one edge in both directions, a self-loop and a node without edges."""
    x = np.random.default_rng(3).normal(0, 1, (9, 4))
    split = ["train"] * 5 + ["test", None, "cal", "train"]
    return x, split, spark.createDataFrame([(i, x[i].tolist(), split[i]) for i in range(9)], "node_id long, x array<double>, split string"), spark.createDataFrame(EDGES, "src long, dst long")


def brute(w, projection, x, matrix):
    """Every node's loss, written out per node."""
    relu = lambda m: np.maximum(m, 0)
    p = x @ projection.T
    code = relu(matrix @ relu(matrix @ p @ w["w1"].T + w["b1"]) @ w["w2"].T + w["b2"])
    out = []
    for i, c in enumerate(code):
        near = sorted({b for a, b in EDGES if a == i and b != i} | {a for a, b in EDGES if b == i and a != i})
        mu = p[near].mean(0) if near else np.zeros(len(c))
        variance = np.maximum(p[near].var(0) if near else 0.0, 1e-6) * np.ones(len(c))
        x_out, m_out, v_out = (relu(c @ w[f"{k}1"].T + w[f"{k}b1"]) @ w[f"{k}2"].T + w[f"{k}b2"] for k in "xmv")
        divergence = 0.0
        for j in range(len(c)):
            divergence += 0.5 * (np.log(variance[j]) - v_out[j] + (np.exp(v_out[j]) + (m_out[j] - mu[j]) ** 2) / variance[j] - 1)
        degree = np.log(1 + max(len(near), 1))
        out.append(SHARES[0] * np.mean((x_out - p[i]) ** 2) + SHARES[1] * (c @ w["d"] + w["db"][0] - degree) ** 2 + SHARES[2] * divergence)
    return np.array(out)


def test_losses_and_gradients_against_dense_loops(spark):
    x, split, nodes, edges = graph(spark)
    rng = np.random.default_rng(5)
    projection = rng.normal(0, 1, (3, 4))
    # A node without neighbours has the least variance, so its slopes are a million times as steep.
    nodes = nodes.withColumn("split", F.when(F.col("node_id") < 7, F.col("split")))
    net = NeighbourhoodNetwork(nodes, edges, projection, SHARES)
    matrix = np.zeros((9, 9))
    for r in net.matrix.collect():
        matrix[r.src, r.dst] = r.w
    w = {k: v + rng.normal(0, 0.4, v.shape) for k, v in net.first(3, 2).items()}
    want = brute(w, projection, x, matrix)
    got = {r.node_id: r.s for r in net.losses(w).collect()}
    assert [got[i] for i in range(9)] == pytest.approx(want, rel=1e-9)
    loss, slope = net.backward(w, net.forward(w))
    of = lambda v: brute(v, projection, x, matrix)[:5].mean()
    assert loss == pytest.approx(of(w), rel=1e-9)
    for k, v in w.items():
        for at in np.ndindex(v.shape):
            ends = []
            for sign in (1, -1):
                moved = {n: m.copy() for n, m in w.items()}
                moved[k][at] += sign * 1e-6
                ends.append(of(moved))
            assert slope[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-5, abs=1e-6), (k, at)


def planted(spark, n=150):
    """Two groups with edges within them; one node in ten has a vector far from both groups and from its neighbours."""
    rng = np.random.default_rng(8)
    y = (np.arange(n) % 10 == 0).astype(int)
    x = rng.normal(0, 0.3, (n, 4)) + np.where(np.arange(n)[:, None] % 2, 1.0, -1.0)
    x[y == 1] += rng.choice([-6, 6], (y.sum(), 4))
    pairs = {(int(min(p)), int(max(p))) for p in rng.integers(0, n, (8 * n, 2)) if p[0] != p[1] and p[0] % 2 == p[1] % 2}
    split = np.where(rng.random(n) < 0.5, "train", "test")
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i]), str(split[i])) for i in range(n)], "node_id long, x array<double>, y int, split string"), spark.createDataFrame(sorted(pairs), "src long, dst long")


def test_planted_anomalies_and_resumed_runs(spark, tmp_path):
    nodes, edges = planted(spark)
    path = str(tmp_path / "state")
    Autoencoder(hidden=4, epochs=3, rate=0.02, path=path).fit(nodes, edges)
    on = Autoencoder(hidden=4, epochs=6, rate=0.02, path=path).fit(nodes, edges)
    whole = Autoencoder(hidden=4, epochs=6, rate=0.02).fit(nodes.drop("y"), edges)
    for k, v in whole.run.weights.items():
        assert np.allclose(on.run.weights[k], v, atol=1e-9), k
    losses = [h[1] for h in whole.run.history]
    assert [h[0] for h in on.run.history] == list(range(1, 7)) and losses[-1] < losses[0]
    scores = whole.score(nodes, edges)
    assert whole.missing(nodes, scores).count() == 0
    # The nodes are planted by their vectors: six epochs are enough for that part alone, not for degrees beside it.
    by_vector = Autoencoder(hidden=4, epochs=6, rate=0.05, shares=(1.0, 0.0, 0.0)).fit(nodes, edges).score(nodes, edges)
    assert ranking_metrics(by_vector.join(nodes.where("split = 'test'").select("node_id", "y"), "node_id")).first()["auroc"] > 0.95


def test_defined_cases(spark):
    _, _, nodes, edges = graph(spark)
    with pytest.raises(ValueError):
        Autoencoder().score(nodes, edges)
    model = Autoencoder(hidden=2, epochs=2).fit(nodes.withColumn("split", F.lit("test")), edges)
    assert model.run.epoch == 0 and model.score(nodes, edges).where("s IS NOT NULL").count() == 9
    # Repeated edges change the convolution's weights, not the targets; no edges leave every node to itself.
    alone = model.score(nodes.drop("split"), edges.limit(0)).collect()
    assert len(alone) == 9 and all(np.isfinite(r.s) for r in alone)
    assert Autoencoder(hidden=2, epochs=2).fit(nodes.limit(0), edges.limit(0)).score(nodes.limit(0), edges.limit(0)).count() == 0
