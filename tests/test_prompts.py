"""Trained prompts: loss and gradients against dense loops, shifted nodes against a plain classifier, defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.metrics import ranking_metrics
from tidemark.operators.prompts import PromptNetwork, Prompts

EDGES = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (1, 4), (6, 2), (2, 1), (3, 3)]
Y = [0, 1, 0, 0, 1, 0, None, 0, 0]
SPLIT = ["train"] * 5 + ["test", "train", "cal", "train"]


def graph(spark):
    x = np.random.default_rng(3).normal(0, 1, (9, 3))
    nodes = spark.createDataFrame([(i, x[i].tolist(), Y[i], SPLIT[i]) for i in range(9)], "node_id long, x array<double>, y int, split string")
    return x, nodes, spark.createDataFrame(EDGES, "src long, dst long")


def brute(w, x, agreement):
    """The loss, node by node."""
    n = len(x)
    near = [sorted({b for a, b in EDGES if a == i and b != i} | {a for a, b in EDGES if b == i and a != i}) for i in range(n)]
    a = np.zeros((n, n))
    for i in range(n):
        for j in near[i]:
            a[i, j] = 1 / np.sqrt(len(near[i]) * len(near[j]))
    shifted = np.array([v + sum(p / (1 + np.exp(-(g @ v + b))) for p, g, b in zip(w["prompts"], w["gate"], w["gate_b"])) for v in x])
    mix = []
    for v in shifted:
        e = np.exp(w["pool"] @ v + w["pool_b"])
        mix.append(e @ w["parts"] / e.sum())
    mix = np.array(mix)
    h = a @ (np.maximum(a @ shifted @ w["w1"].T, 0) @ w["w2"].T)
    side = a @ mix @ w["near"].T
    rows = [i for i in range(n) if SPLIT[i] == "train" and Y[i] is not None]
    normals = [i for i in rows if Y[i] == 0]
    ratio, total = max(1.5, len(normals) / (len(rows) - len(normals))), 0.0
    for i in rows:
        p = 1 / (1 + np.exp(-(mix[i] @ w["side"] + w["side_b"][0])))
        total += -(ratio * np.log(p) if Y[i] else np.log(1 - p)) / len(rows)
    for i in normals:
        z = w["head1"] @ h[i] + w["head_b1"]
        o = w["head2"] @ np.where(z > 0, z, w["bend"][0] * z) + w["head_b2"]
        total -= agreement / len(normals) * (o @ side[i]) / max(np.linalg.norm(o) * np.linalg.norm(side[i]), 1e-8)
    return total


@pytest.mark.parametrize("agreement", [0.7, 0.0])
def test_gradient_against_finite_differences(spark, agreement):
    x, nodes, edges = graph(spark)
    net = PromptNetwork(nodes, edges, prompts=2, size=3, agreement=agreement, least_ratio=1.5)
    rng = np.random.default_rng(5)
    w = {k: v + rng.normal(0, 0.4, v.shape) for k, v in net.first(4, 2).items()}
    loss, slope = net.backward(w, net.forward(w))
    assert loss == pytest.approx(brute(w, x, agreement), abs=1e-9)
    for k, v in w.items():
        for at in np.ndindex(v.shape):
            ends = []
            for sign in (1, -1):
                moved = {n: m.copy() for n, m in w.items()}
                moved[k][at] += sign * 1e-6
                ends.append(brute(moved, x, agreement))
            assert slope[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6), (k, at)


def test_shifted_nodes_against_a_plain_classifier(spark):
    """Anomalies lie on both sides of the normals, and test nodes are shifted along another direction."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(2)
    n = 400
    y, test = (rng.random(n) < 0.3).astype(int), rng.random(n) < 0.4
    x = rng.normal(0, 0.5, (n, 4))
    x[:, 0] += y * rng.choice([-2.5, 2.5], n)
    x[:, 1] += 1.5 * test
    nodes = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), "test" if test[i] else "train") for i in range(n)], "node_id long, x array<double>, y int, split string").cache()
    pairs = {(int(min(p)), int(max(p))) for p in rng.integers(0, n, (3 * n, 2)) if p[0] != p[1]}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long").cache()
    model = Prompts(prompts=6, hidden=4, size=4, epochs=25, rate=0.1, decay=0.0, agreement=0.05).fit(nodes, edges)
    assert model.run.history[-1][1] < model.run.history[0][1]
    held = nodes.where("split = 'test'").select("node_id", "y")
    got = ranking_metrics(model.score(nodes).join(held, "node_id")).first()["auroc"]
    rows = nodes.withColumn("features", array_to_vector("x")).withColumn("label", F.col("y").cast("double"))
    plain = LogisticRegression().fit(rows.where("split = 'train'")).transform(rows.where("split = 'test'")).select("y", vector_to_array("probability")[1].alias("s"))
    assert got > 0.85 and got > ranking_metrics(plain).first()["auroc"] + 0.1


def test_defined_cases(spark, tmp_path):
    _, nodes, edges = graph(spark)
    with pytest.raises(ValueError):
        Prompts().score(nodes)
    model = Prompts(prompts=2, hidden=3, size=3, epochs=2).fit(nodes.withColumn("split", F.lit("test")), edges)
    assert model.run.epoch == 0 and model.missing(nodes, model.score(nodes)).count() == 0
    alone = Prompts(prompts=2, hidden=3, size=3, epochs=1).fit(nodes, edges.limit(0))
    assert all(np.isfinite(v).all() for v in alone.run.weights.values())
    path = str(tmp_path / "state")
    Prompts(prompts=2, hidden=3, size=3, epochs=1, path=path).fit(nodes, edges)
    on, whole = (Prompts(prompts=2, hidden=3, size=3, epochs=2, path=p).fit(nodes, edges) for p in (path, None))
    for k, v in whole.run.weights.items():
        assert np.allclose(on.run.weights[k], v, atol=1e-9), k
    empty = nodes.limit(0)
    assert Prompts(prompts=2, hidden=3, size=3, epochs=2).fit(empty, edges.limit(0)).score(empty).count() == 0
