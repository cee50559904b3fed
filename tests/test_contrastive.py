"""The contrastive detector: gradient against finite differences, planted anomalies, defined cases."""

import numpy as np
import pytest

from tidemark.functions.metrics import ranking_metrics
from tidemark.operators.contrastive import Contrastive, Pairs, others


def two_groups(spark, n=120):
    """Edges within two groups of different vectors; the anomalies carry the other group's."""
    rng = np.random.default_rng(8)
    group, y = np.arange(n) % 2, (np.arange(n) % 12 < 2).astype(int)
    x = rng.normal(0, 0.4, (n, 4))
    x[:, 0] += 2 * (group ^ y)
    x[:, 1] += 2 * (1 - (group ^ y))
    pairs = {(int(min(p)), int(max(p))) for p in rng.integers(0, n, (8 * n, 2)) if p[0] != p[1] and group[p[0]] == group[p[1]]}
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "node_id long, x array<double>, y int"), spark.createDataFrame(sorted(pairs), "src long, dst long")


def test_gradient_against_finite_differences(spark):
    nodes, edges = two_groups(spark, 12)
    pairs = Pairs(nodes, edges, 2, 3, 0.3, 5)
    x = np.array([r.x for r in nodes.orderBy("node_id").collect()])
    p = np.zeros((12, 12))
    for r in pairs.walks.where("round = 1").collect():
        p[r.src, r.dst] = r.w
    assert np.allclose(p.sum(1), 1)
    other = np.zeros(12, int)
    for r in others(pairs.ranked, 12, 1).collect():
        other[r.node_id] = r.other
    assert sorted(other) == list(range(12)) and (other != np.arange(12)).all()

    def loss(w):
        h = np.maximum(x @ w["w"].T + w["b"], 0)
        c, total = p @ h, 0.0
        for i in range(12):
            for v, sign in ((c[i], -1), (c[other[i]], 1)):
                total += np.log1p(np.exp(sign * (h[i] @ w["mix"] @ v + w["shift"][0])))
        return total / 24

    rng = np.random.default_rng(1)
    w = {k: v + rng.normal(0, 0.2, v.shape) for k, v in Contrastive(hidden=3).first(4).items()}
    got, slope = pairs.gradient(w, 1)
    assert got == pytest.approx(loss(w), abs=1e-10)
    for k, v in w.items():
        for at in np.ndindex(v.shape):
            ends = []
            for sign in (1, -1):
                moved = {n: m.copy() for n, m in w.items()}
                moved[k][at] += sign * 1e-6
                ends.append(loss(moved))
            assert slope[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6), (k, at)


def test_planted_anomalies_rank_above_chance(spark):
    nodes, edges = two_groups(spark)
    model = Contrastive(hidden=8, epochs=10, rate=0.1, rounds=8, block=4, train_rounds=2).fit(nodes, edges)
    assert model.losses[-1] < model.losses[0]
    scores = model.score(nodes, edges)
    assert model.missing(nodes, scores).count() == 0
    assert ranking_metrics(scores.join(nodes.select("node_id", "y"), "node_id")).first()["auroc"] > 0.75


def test_defined_cases(spark):
    nodes, edges = two_groups(spark, 12)
    with pytest.raises(ValueError):
        Contrastive().score(nodes, edges)
    one = nodes.where("node_id = 0")
    model = Contrastive(hidden=3, epochs=2, rounds=2).fit(one, edges.limit(0))
    assert [r.s for r in model.score(one, edges.limit(0)).collect()] == [0.0]
