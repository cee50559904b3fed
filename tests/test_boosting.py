"""Boosted quantiles against the same algorithm in plain loops, and their coverage."""

import numpy as np
import pytest

from tidemark.operators import boosting as B


def frame(spark, x, s, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, s))], "node_id long, x array<double>, s double").repartition(parts)


def lower(values, q):
    return sorted(values)[max(1, int(np.ceil(round(len(values) * q, 9)))) - 1]


def plain(x, s, q, edges, trees, depth, rate):
    """Predictions for the rows of the fit, tree by tree and row by row."""
    bins = np.array([[sum(v > e for e in edges[i]) for i, v in enumerate(r)] for r in x])
    f = np.full(len(s), lower(s, q))
    for _ in range(trees):
        groups = [np.arange(len(s))]
        for _ in range(depth):
            nxt = []
            for g in groups:
                grad = np.where(s[g] > f[g], q, q - 1)
                best = (0.0, None)
                for feature in range(x.shape[1]):
                    for cut in range(B.BINS - 1):
                        left = bins[g, feature] <= cut
                        if 0 < left.sum() < len(g):
                            gain = round(grad[left].sum() ** 2 / left.sum() + grad[~left].sum() ** 2 / (~left).sum() - grad.sum() ** 2 / len(g), 9)
                            if gain > best[0]:
                                best = (gain, left)
                nxt += [g[best[1]], g[~best[1]]] if best[1] is not None else [g, g[:0]]
            groups = nxt
        step = np.zeros(len(s))
        for g in groups:
            if len(g):
                step[g] = lower(s[g] - f[g], q)
        f = f + rate * step
    return f


def test_equals_plain_loops(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(120, 3)), 1)
    x[:, 2] = 1.0  # never split
    s = np.round(x[:, 0] * rng.normal(size=120), 2)
    df = frame(spark, x, s)
    model = B.fit(df, 0.8, trees=4, depth=2, rate=0.5)
    want = plain(x, s, 0.8, model.edges, 4, 2, 0.5)
    got = {r.node_id: r.threshold for r in B.predict(df, model).collect()}
    assert [got[i] for i in range(120)] == pytest.approx(list(want))


def test_coverage_on_held_out_rows(spark):
    """Noise that grows with a feature: the share below the prediction is near the level everywhere, which one number can't give."""
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(16_000, 3))
    s = rng.normal(size=16_000) * (0.2 + 3 * x[:, 0])
    model = B.fit(frame(spark, x[:8000], s[:8000]), 0.9)
    assert len(model.trees) == 40
    below = s[8000:] <= model.raw(model.binned(x[8000:]))
    assert abs(below.mean() - 0.9) <= 0.02
    for low in (0.0, 0.25, 0.5, 0.75):
        part = (x[8000:, 0] >= low) & (x[8000:, 0] < low + 0.25)
        assert abs(below[part].mean() - 0.9) <= 0.04
    flat = s[8000:] <= B.np.quantile(s[:8000], 0.9)
    assert flat[x[8000:, 0] < 0.25].mean() > 0.99


@pytest.mark.parametrize("cells", [2, 1024])
def test_leaf_quantiles_by_refinement(spark, monkeypatch, cells):
    """Few cells need many refinements; ties and single values end them."""
    monkeypatch.setattr(B, "CELLS", cells)
    rng = np.random.default_rng(2)
    s = np.concatenate([np.round(rng.normal(size=300), 1), [1e6]])
    model = B.fit(frame(spark, np.zeros((301, 1)), s), 0.7, trees=1, depth=1)
    assert model.start == lower(s, 0.7) and model.trees[0].value[0] == pytest.approx(0.0)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, None], 2.0), (2, [float("nan"), 3.0], 1.0), (3, None, 5.0), (4, [2.0, 2.0], None)], "node_id long, x array<double>, s double")
    model = B.fit(df, 0.5, trees=2)
    assert B.predict(df, model).count() == 3
    none = B.fit(df.limit(0), 0.5)
    assert none.start is None and [r.threshold for r in B.predict(df, none).collect()] == [None] * 4
