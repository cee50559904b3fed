"""Packed blocks of vectors: pairs against dense matrices."""

import numpy as np
import pytest

from tidemark.operators import compare


def frame(spark, x):
    return spark.createDataFrame([(i, None if row is None else [None if v is None else float(v) for v in row]) for i, row in enumerate(x)], "node_id long, x array<double>")


def kernel(a, b):
    return np.exp(-((a[:, None] - b[None]) ** 2).sum(2)).mean()


def test_mmd_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(compare, "MMD_ROWS", 32)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(150, 5)), rng.normal(0.4, 1, size=(230, 5))
    samples = frame(spark, [*a, None, [1.0, None, 0.0, 0.0, 0.0]]), frame(spark, b)
    assert compare.mmd(*samples).first()["mmd2"] == pytest.approx(kernel(a, a) - 2 * kernel(a, b) + kernel(b, b))
    assert compare.mmd(samples[0], samples[1].limit(0)).first()["mmd2"] is None


def test_centroids_are_means_of_components(spark):
    """Null components count nowhere; a member without a vector neither."""
    from tidemark.operators.graph import neighbour_centroids

    nodes = frame(spark, [[1.0, 2.0, 3.0], [3.0, None, 5.0], [5.0, None, 1.0], None])
    knn = spark.createDataFrame([(0, 0), (0, 1), (0, 3), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 3)], "i long, j long")
    got = {r.node_id: r.centroid for r in neighbour_centroids(knn, nodes).collect()}
    assert got == {0: [2.0, 2.0, 4.0], 1: [4.0, None, 3.0], 2: [3.0, 2.0, 3.0]}
    assert {r.node_id: r.centroid for r in neighbour_centroids(knn, nodes, include_self=False).collect()} == {0: [3.0, None, 5.0], 1: [5.0, None, 1.0], 2: [2.0, 2.0, 4.0]}


def shuffled_rows(spark):
    """Rows that all stages of the session wrote for shuffles."""
    from py4j.java_gateway import java_import

    jvm = spark.sparkContext._gateway.jvm
    java_import(jvm, "java.util.*")
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_neighbours_shuffle_no_copies_of_vectors(spark, monkeypatch):
    """Ten blocks: a copy of every vector for every block would be over twenty rows a vector."""
    from tidemark.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    nodes = frame(spark, np.random.default_rng(1).normal(size=(640, 8))).checkpoint()
    before = shuffled_rows(spark)
    assert neighbours.nearest(nodes, nodes, 3).count() == 3 * 640
    assert shuffled_rows(spark) - before < 8 * 640


def test_visits_shuffle_no_copies_of_vectors(spark):
    """Most of twenty cells are visited: a copy a visit would be over ten rows a query."""
    from tidemark.operators import cells

    nodes = frame(spark, np.random.default_rng(2).normal(size=(640, 8))).checkpoint()
    index = cells.build_index(nodes, 3, 1.0, 20)
    assert index.probes >= 10
    before = shuffled_rows(spark)
    assert cells.neighbours(index, nodes, 3).count() == 3 * 640
    assert shuffled_rows(spark) - before < 8 * 640


def test_centroids_shuffle_a_row_a_member(spark):
    from tidemark.operators.graph import neighbour_centroids

    nodes = frame(spark, np.random.default_rng(3).normal(size=(200, 50))).checkpoint()
    knn = spark.createDataFrame([(i, (i + k) % 200) for i in range(200) for k in range(5)], "i long, j long").checkpoint()
    before = shuffled_rows(spark)
    assert neighbour_centroids(knn, nodes).count() == 200
    assert shuffled_rows(spark) - before <= 3 * 5 * 200 + 200


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("case", ["plain", "far", "equal", "few", "nan"])
def test_best_against_brute_force(metric, case):
    from tidemark.operators.neighbours import Best

    rng = np.random.default_rng(4)
    y = rng.normal(size=(200, 5))
    y = {"plain": y, "far": y + 1000, "equal": np.ones((200, 5)), "few": y[:4], "nan": np.where(np.arange(200)[:, None] % 50 == 7, np.nan, y)}[case]
    jds = rng.permutation(1000)[: len(y)]
    ids, x, k = jds[:90], y[:90], 7
    best = Best(ids, x, k, metric)
    for at in range(0, len(y), 40):
        best.meet(jds[at : at + 40], y[at : at + 40])
    if metric == "cosine":
        a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        d = 1 - (a[:, None] * b[None]).sum(2)
    else:
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    d = np.where(ids[:, None] == jds[None], -1.0, np.round(d, 9))
    want = [(int(i), int(jds[c])) for r, i in enumerate(ids) for c in np.lexsort((jds, d[r]))[:k]]
    assert sorted(want) == sorted(zip(best.found().column(0).to_pylist(), best.found().column(1).to_pylist()))
