"""Vector codes against Lloyd's rounds done point by point, and what the trees prune."""

import hashlib

import numpy as np
import pytest
from helpers import store

from tidemark.llm import codes


def plain(vectors: dict, parts=8, k=16, rounds=6):
    """Codes, errors and codebooks from all distances."""
    ids = sorted(vectors)
    x = np.array([np.floor(4096 * np.asarray(vectors[i], float)) for i in ids]).astype(np.int64).reshape(len(ids), parts, -1)
    books = x[:k].transpose(1, 0, 2).copy()

    def nearest():
        return np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)

    for _ in range(rounds):
        owner = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (owner[:, p] == e).any():
                    books[p, e] = x[owner[:, p] == e, p].sum(0) // (owner[:, p] == e).sum()
    owner = nearest()
    error = sum(((x[:, p] - books[p][owner[:, p]]) ** 2).sum(1) for p in range(parts))
    return {i: ("".join(f"{c:02x}" for c in owner[n]), int(error[n])) for n, i in enumerate(ids)}, books


def run(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, more string").repartition(3)
    return codes.op11(spark, store(tmp_path, embeddings=df)).collect()


@pytest.mark.parametrize("n,dims", [(700, 16), (40, 64), (5, 8), (1, 8)])
def test_equals_all_distances(spark, tmp_path, n, dims):
    rng = np.random.default_rng(n)
    # Few distinct values, so that distances tie.
    x = np.round(rng.normal(size=(n, dims)) * 4) / 4096 if n == 700 else rng.normal(size=(n, dims)).astype(np.float32)
    vectors = {int(i) * 3 - 50: [float(v) for v in x[i]] for i in range(n)}
    bad = [(9001, None, 1, "a"), (9002, [float("nan")] * dims, 1, "a"), (9003, [None] * dims, 1, "a"), (-9004, [float("inf")] * dims, None, "a")]
    rows = [(i, v, None if i % 5 == 0 else i % 3, "x") for i, v in vectors.items()]
    got = run(spark, tmp_path, rows + bad)
    want, books = plain(vectors)
    assert {r.vec_id: (r.code, r.error) for r in got} == want
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()}
    label = {i: lab for i, _, lab, _ in rows}
    sums = {lab: sum(want[i][1] for i in want if label[i] == lab) for lab in set(label.values())}
    assert all(r.label_error == sums[label[r.vec_id]] for r in got)


def test_hot_vector_repeated_ids_and_padding(spark, tmp_path):
    rows = [(1, [0.5] * 10, 0, "x")] * 300 + [(i, [i / 100.0] * (i % 11), 1, "x") for i in range(2, 100)]
    got = run(spark, tmp_path, rows)
    assert len(got) == 398 and len({(r.code, r.error) for r in got if r.vec_id == 1}) == 1
    assert all(len(r.code) == 16 for r in got)


def test_empty_and_huge(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    assert run(spark, tmp_path / "b", [(1, None, 1, "x")]) == []
    (row,) = run(spark, tmp_path / "c", [(None, [3e38] * 8, None, "x")])
    assert (row.code, row.error) == ("00" * 8, 0)


def test_whole_subtrees_are_assigned_at_once():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (16, 8))
    points = (centres[rng.integers(0, 16, 4000)] + rng.integers(-20, 20, (4000, 8))).astype(np.int64)
    order, low, high, sums = codes.build(points)
    owner, counts, totals, whole = codes.filtered(points[order], low, high, sums, centres)
    apart = ((points[order][:, None] - centres[None]) ** 2).sum(2)
    assert (owner == apart.argmin(1)).all() and counts.sum() == 4000 and (totals.sum(0) == points.sum(0)).all()
    assert whole > 3000


def test_nodes_hold_their_points():
    points = np.random.default_rng(2).integers(-9, 9, (777, 3))
    order, low, high, sums = codes.build(points)
    at = points[order]
    for level in range(codes.depth(777) + 1):
        cuts = codes.edges(777, level)
        for i in range(1 << level):
            run, node = at[cuts[i] : cuts[i + 1]], (1 << level) - 1 + i
            assert 0 < len(run) and (run.min(0) == low[node]).all() and (run.max(0) == high[node]).all() and (run.sum(0) == sums[node]).all()


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = [(i, [float((i * j) % 17) / 7 for j in range(16)], 0, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, more string")
    want = sorted(codes.compress(df.coalesce(1))[0].collect())
    monkeypatch.setattr(codes, "CELLS", 16 * 37)
    coded, _, whole = codes.compress(df.repartition(4))
    assert sorted(coded.collect()) == want and len(whole) == codes.ROUNDS
