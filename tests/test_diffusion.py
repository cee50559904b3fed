"""Pushed diffusion against the dense solution: error bound, mass, top k and defined cases."""

import numpy as np
import pytest

from tidemark.operators.diffusion import diffusion, diffusion_top


def graph(spark, n=40):
    rng = np.random.default_rng(4)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (90, 2)) if a != b} | {(0, i) for i in range(1, 20)}
    a = np.zeros((n, n))
    for s, d in pairs:
        a[s, d] = a[d, s] = 1
    edges = sorted(pairs) + [(3, 3)] + sorted(pairs)[:5]  # a loop and repeats
    return a, spark.createDataFrame(edges, "src long, dst long")


def solved(a, seed, restart):
    deg = a.sum(1)
    p = np.divide(a, deg[:, None], out=np.zeros_like(a), where=deg[:, None] > 0)
    return np.linalg.solve(np.eye(len(a)) - (1 - restart) * p.T, restart * np.eye(len(a))[seed])


@pytest.mark.parametrize("eps", [1e-2, 1e-3])
def test_error_stays_within_the_bound(spark, eps):
    a, edges = graph(spark)
    seeds = [0, 7, 21, 21]
    rows = diffusion(edges, spark.createDataFrame([(s,) for s in seeds], "node_id long"), 0.2, eps).collect()
    assert len({(r.seed, r.node_id) for r in rows}) == len(rows)
    deg = a.sum(1)
    for seed in set(seeds):
        exact, mass, rest = solved(a, seed, 0.2), np.zeros(len(a)), np.zeros(len(a))
        for r in rows:
            if r.seed == seed:
                mass[r.node_id], rest[r.node_id] = r.mass, r.rest
                assert r.deg == deg[r.node_id]
        assert mass.sum() + rest.sum() == pytest.approx(1)
        error = exact - mass
        assert (error > -1e-12).all() and (error <= eps * deg + 1e-12).all() and (error <= rest.sum() + 1e-12).all()
        assert (rest <= eps * deg + 1e-15).all()


def test_top_equals_the_dense_solution(spark):
    a, edges = graph(spark)
    got = diffusion_top(edges, spark.createDataFrame([(7,), (21,)], "node_id long"), 5, 0.3, 1e-5).collect()
    for seed in (7, 21):
        exact = solved(a, seed, 0.3)
        exact[seed] = -1
        want = sorted(range(len(a)), key=lambda v: (-round(exact[v], 9), v))[:5]
        mine = sorted((r for r in got if r.seed == seed), key=lambda r: r.rank)
        if mine[0].certain:
            assert {r.node_id for r in mine} == set(want)
        assert np.allclose([r.mass for r in mine], sorted(exact, reverse=True)[:5], atol=1e-3)
    assert any(r.certain for r in got)


def test_defined_cases(spark):
    _, edges = graph(spark)
    alone = diffusion(edges, spark.createDataFrame([(99,)], "node_id long")).collect()
    assert [(r.seed, r.node_id, r.mass, r.rest) for r in alone] == [(99, 99, 1.0, 0.0)]
    none = spark.createDataFrame([], "node_id long")
    assert diffusion(edges, none).count() == 0 and diffusion_top(edges, none, 3).count() == 0
    with pytest.raises(ValueError):
        diffusion(edges, none, eps=0.0)


def test_hub_is_not_pushed(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 60)], "src long, dst long")
    rows = {r.node_id: r for r in diffusion(star, spark.createDataFrame([(5,)], "node_id long"), 0.2, 0.05).collect()}
    assert set(rows) == {5, 0} and rows[0].mass == 0 and rows[0].rest == pytest.approx(0.8)
