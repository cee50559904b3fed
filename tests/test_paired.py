"""Paired tests against plain enumeration and sums, for few and for many pairs."""

import math
from itertools import product

import numpy as np
import pytest

from tidemark.operators.compare import paired_tests, wilcoxon_p


def frame(spark, groups):
    return spark.createDataFrame([(k, "auc", i, float(v)) for k, d in groups.items() for i, v in enumerate(d)], "dataset string, metric string, seed int, diff double")


def ranks_of(d):
    a = np.abs(d)
    return np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])


def test_signed_rank_is_exact(spark):
    groups = {"a": [1.0, -2.0, 3.0, 3.0, -0.5], "b": [0.0, 2.0, 2.0, -2.0, 1.0, 4.0, 4.0, -1.0], "c": [-1.0], "d": list(np.round(np.random.default_rng(0).normal(0.3, 1, 16), 1))}
    got = {r.dataset: r.p_greater for r in wilcoxon_p(frame(spark, groups)).collect()}
    for k, d in groups.items():
        d = np.array([v for v in d if v])
        r = ranks_of(d)
        w = r[d > 0].sum()
        signs = np.array(list(product([0, 1], repeat=len(d))))
        assert got[k] == pytest.approx((signs @ r >= w - 1e-9).mean(), abs=1e-12), k


def test_signed_rank_of_many_pairs(spark):
    d = np.random.default_rng(3).normal(0.1, 1, 59)
    df = frame(spark, {"a": d})
    exact, normal = (wilcoxon_p(df, most=m).first().p_greater for m in (60, 10))
    r = ranks_of(d)
    z = (r[d > 0].sum() - r.sum() / 2 - 0.5) / math.sqrt((r**2).sum() / 4)
    assert normal == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=1e-9)
    assert exact == pytest.approx(normal, abs=2e-3)
    assert wilcoxon_p(frame(spark, {"a": np.random.default_rng(3).normal(1, 1, 900)})).first().p_greater < 1e-6


def test_sign_test_beyond_twenty_pairs(spark):
    groups = {"a": [1.0] * 30 + [-1.0] * 12, "b": [1.0] * 25, "c": [-1.0, 1.0], "d": [1.0] * 1300 + [-1.0] * 1200}
    got = {r.dataset: r.sign_p for r in paired_tests(frame(spark, groups)).collect()}
    for k, d in groups.items():
        m, low = len(d), min(sum(v > 0 for v in d), sum(v < 0 for v in d))
        assert got[k] == pytest.approx(min(1.0, 2 * sum(math.comb(m, i) for i in range(low + 1)) / 2**m), rel=1e-8), k
