"""Covariances, gaps and alignments against dense linear algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import spectrum as S
from tidemark.operators.neighbours import knn_graph


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, x array<double>").repartition(5).checkpoint()


def test_covariance_of_far_vectors(spark):
    x = np.random.default_rng(0).normal(size=(500, 7)) @ np.random.default_rng(1).normal(size=(7, 7)) + 1e6
    mu, cov, n = S.covariance(frame(spark, x))
    assert n == 500 and mu == pytest.approx(x.mean(0)) and np.abs(cov - np.cov(x, rowvar=False)).max() < 1e-6
    mu, cov, n = S.covariance(frame(spark, x).limit(0))
    assert n == 0 and len(mu) == 0


def dense_gap(n, knn):
    h = np.zeros((n, n))
    for r in knn.collect():
        h[r.j, r.i] = 1
    d_v, d_e = np.maximum(h.sum(1), 1), np.maximum(h.sum(0), 1)
    a = (h / d_e) @ h.T / np.sqrt(np.outer(d_v, d_v))
    return np.sort(np.linalg.eigvalsh(np.eye(n) - a))[1]


@pytest.mark.parametrize("n,k", [(20, 3), (12, 11)])
def test_gap_within_its_bound(spark, n, k):
    nodes = frame(spark, np.random.default_rng(n).normal(size=(n, 5)))
    knn = knn_graph(nodes, k).checkpoint()
    value, bound = S.lanczos_gap(nodes, knn)
    assert bound <= 1e-6 and abs(value - dense_gap(n, knn)) <= 1e-6
    assert S.lanczos_gap(nodes.limit(1), knn) is None


def test_two_parts_have_no_gap(spark):
    x = np.random.default_rng(3).normal(size=(8, 3))
    nodes = frame(spark, np.concatenate([x + [50, 0, 0], x + [0, 50, 0]]))
    assert S.spectral_gap(nodes, knn_graph(nodes, 3).checkpoint()) == pytest.approx(0.0, abs=1e-6)


def test_alignment_equals_steps_over_all_rows(spark):
    rng = np.random.default_rng(4)
    x, t = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)), 2 * rng.normal(size=(200, 4)) + 1
    z = (x - x.mean(0)) / (x.std(0) + 1e-8) * (t.std(0) + 1e-8) + t.mean(0)
    for _ in range(20):
        diff = np.cov(z, rowvar=False) - np.cov(t, rowvar=False)
        z = z - 0.1 * 0.05 * (z - z.mean(0)) @ np.linalg.pinv(diff + 1e-6 * np.eye(4))
    got = np.array([r.x for r in S.shape_aligned(frame(spark, x), frame(spark, t)).orderBy("node_id").collect()])
    assert np.abs(got - z).max() < 1e-6 * max(1, np.abs(z).max())
