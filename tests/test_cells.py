"""Neighbours by inverted cells against the exact join."""

import numpy as np
import pytest

from tidemark.operators import cells as C
from tidemark.operators.neighbours import nearest


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "node_id long, x array<double>").repartition(4).checkpoint()


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 24))
    return frame(spark, centres[rng.integers(0, 40, 4000)] + 0.25 * rng.normal(size=(4000, 24)))


def test_clusters_need_a_tenth_of_the_pairs(clustered):
    r = C.report(clustered, 10, 0.97).first()
    assert r.recall >= 0.9 and r.compared <= 0.1 and r.judged_recall >= 0.97 and r.n == 4000 and r.queries == 80


def test_without_structure_the_recall_holds_and_the_report_says_the_cost(spark):
    r = C.report(frame(spark, np.random.default_rng(1).normal(size=(1500, 32))), 10, 0.95, every=10).first()
    assert r.recall >= 0.9 and r.compared > 0.1


def test_all_cells_are_exact(spark, clustered, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 17)  # large cells are dealt to several blocks
    small = frame(spark, np.random.default_rng(2).normal(size=(300, 8)))
    index = C.build_index(small, 5, 1.0, 12)
    index = C.Index(index.filed, index.centres, index.sizes, len(index.centres), 1.0)
    got = {(r.i, r["rank"]): r.j for r in C.neighbours(index, small, 6).collect()}
    want = {(r.i, r["rank"]): r.j for r in nearest(small, small, 6).collect()}
    assert got == want


def test_equal_vectors_few_rows_and_none(spark):
    same = frame(spark, np.ones((200, 4)))
    assert C.recall(C.indexed_neighbours(same, 3), nearest(same, same, 4)) == 1.0
    assert C.indexed_neighbours(frame(spark, np.eye(3)), 5).count() >= 3
    assert C.indexed_neighbours(same.limit(0), 3).count() == 0
