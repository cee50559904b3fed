"""Scores that compare nodes with walks, against loops over the same walks."""

import numpy as np
import pytest

from tidemark.operators.split import hash_rank
from tidemark.operators.walks import contrast_scores, sampled_walks


def test_contrast_scores_against_loops(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (14, 3))
    nodes = spark.createDataFrame([(i, x[i].tolist()) for i in range(14)], "node_id long, x array<double>")
    edges = spark.createDataFrame([(i, (i * 3 + 1) % 13) for i in range(13)], "src long, dst long")
    got = {r.node_id: r.s for r in contrast_scores(edges, nodes, 3, 2, 9).collect()}
    around = {}
    for r in sampled_walks(edges, nodes, 3, 2, seed=9).where("step > 0").collect():
        around.setdefault((r.node_id, r.round), []).append(x[r.visited])
    place = {r.rn: r.node_id for r in hash_rank(nodes.select("node_id"), "node_id", 9).collect()}
    other = {node: place[rn % 14 + 1] for rn, node in place.items()}
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    for i in range(14):
        parts = [cos(x[i], np.mean(around[other[i], r], 0)) - cos(x[i], np.mean(around[i, r], 0)) for r in range(2)]
        assert got[i] == pytest.approx(np.mean(parts), abs=1e-9), i
