"""Training of the networks: gradients against finite differences of dense loops, learning, resuming."""

import numpy as np
import pytest

from tidemark.operators.detectors import beta_polynomials
from tidemark.operators.training import ConvolutionNetwork, WaveletNetwork, stored_run, train

EDGES = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (1, 4), (6, 2), (2, 1)]


def graph(spark, width=3):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (8, width))
    y = [0, 1, 0, 0, 1, 0, None, 0]
    split = ["train"] * 5 + ["test", "train", "cal"]
    nodes = spark.createDataFrame([(i, x[i].tolist(), y[i], split[i]) for i in range(8)], "node_id long, x array<double>, y int, split string")
    return x, y, split, nodes, spark.createDataFrame(EDGES, "src long, dst long")


def scaled(spark, nodes, edges):
    """The engine's own adjacency as a matrix; its values are tested with the detectors."""
    from tidemark.operators.detectors import normalised_adjacency

    a = np.zeros((8, 8))
    for r in normalised_adjacency(edges, nodes).collect():
        a[r.src, r.dst] = r.w
    return a


def brute(kind, w, x, a):
    relu = lambda m: np.maximum(m, 0)
    if kind == "convolution":
        o = a @ (relu(a @ (x @ w["w1"].T + w["b1"])) @ w["w2"].T + w["b2"])
    else:
        h = relu(relu(x @ w["w1"].T + w["b1"]) @ w["w2"].T + w["b2"])
        lap, bands = np.eye(len(x)) - a, []
        for p, c in enumerate(beta_polynomials(2)):
            z = sum(v * np.linalg.matrix_power(lap, k) @ h for k, v in enumerate(c))
            bands.append(relu(z @ w[f"f{p}"].T + w[f"fb{p}"]))
        o = relu(np.concatenate(bands, 1) @ w["w3"].T + w["b3"]) @ w["w4"].T + w["b4"]
    return o


def loss_of(kind, w, x, a, rows):
    """Weighted mean cross-entropy of the softmax, row by row."""
    o, top, below = brute(kind, w, x, a), 0.0, 0.0
    n1 = sum(y for _, y in rows)
    for i, y in rows:
        weight = (len(rows) - n1) / max(n1, 1) if y else 1.0
        top += weight * (np.log(np.exp(o[i]).sum()) - o[i][y])
        below += weight
    return top / below


@pytest.mark.parametrize("kind", ["convolution", "wavelet"])
def test_gradient_against_finite_differences(spark, kind):
    x, y, split, nodes, edges = graph(spark)
    net = (ConvolutionNetwork if kind == "convolution" else WaveletNetwork)(nodes, edges, 0.0, 1)
    rng = np.random.default_rng(5)
    w = {k: v + rng.normal(0, 0.3, v.shape) for k, v in net.first(4, 2).items()}
    loss, got = net.backward(w, net.forward(w))
    a, rows = scaled(spark, nodes, edges), [(i, y[i]) for i in range(8) if split[i] == "train" and y[i] is not None]
    assert loss == pytest.approx(loss_of(kind, w, x, a, rows), abs=1e-10)
    for k, v in w.items():
        for at in np.ndindex(v.shape):
            ends = []
            for sign in (1, -1):
                moved = {n: m.copy() for n, m in w.items()}
                moved[k][at] += sign * 1e-6
                ends.append(loss_of(kind, moved, x, a, rows))
            assert got[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6), (k, at)


def planted(spark, n=240):
    """Anomalies sit among normals and differ from their neighbours in one direction."""
    rng = np.random.default_rng(11)
    y = (rng.random(n) < 0.2).astype(int)
    x = rng.normal(0, 1, (n, 4))
    x[:, 0] += 2.5 * y
    split = np.where(rng.random(n) < 0.6, "train", "test")
    nodes = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), str(split[i])) for i in range(n)], "node_id long, x array<double>, y int, split string")
    pairs = {(int(min(p)), int(max(p))) for p in rng.integers(0, n, (2 * n, 2)) if p[0] != p[1]}
    return nodes, spark.createDataFrame(sorted(pairs), "src long, dst long")


def test_trained_detector_finds_held_out_anomalies(spark):
    from tidemark.functions.metrics import ranking_metrics

    nodes, edges = planted(spark)
    model, run = train("wavelet", nodes, edges, hidden=8, epochs=12, rate=0.05, check=6)
    scores = model.score(nodes, edges).join(nodes.where("split = 'test'").select("node_id", "y"), "node_id")
    assert ranking_metrics(scores).first()["auroc"] > 0.8
    losses = [h[1] for h in run.history]
    assert len(losses) == 2 and losses[-1] < losses[0]
    assert run.rating == max(h[2] for h in run.history)


def test_resumed_run_equals_uninterrupted_run(spark, tmp_path):
    nodes, edges = planted(spark, 60)
    path = str(tmp_path / "state")
    train("convolution", nodes, edges, hidden=4, epochs=1, check=1, path=path)
    assert stored_run(spark, path).epoch == 1
    _, on = train("convolution", nodes, edges, hidden=4, epochs=2, check=1, path=path)
    _, whole = train("convolution", nodes, edges, hidden=4, epochs=2, check=1)
    assert on.epoch == 2 and on.rating == pytest.approx(whole.rating)
    for k, v in whole.weights.items():
        assert np.allclose(on.weights[k], v, atol=1e-9), k


def test_defined_cases(spark):
    nodes, edges = planted(spark, 20)
    from pyspark.sql import functions as F

    none = nodes.withColumn("split", F.lit("test"))
    model, run = train("convolution", none, edges, hidden=3, epochs=3)
    assert run.epoch == 0 and model.score(none, edges).count() == 20
    with pytest.raises(KeyError):
        train("other", nodes, edges)
