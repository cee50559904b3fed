"""Principal components, whitened neighbours, covariance alignment and the spectral gap.

Only d x d matrices and their eigenvectors are on the driver, d being the width of the
vectors; everything about nodes stays in tasks. Defined cases: fewer components than asked
give those there are; directions without variance are left out of whitening; a graph of
fewer than two nodes has no gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import durable
from ..functions.vectors import dot, mean_vector
from .graph import hypergraph_degrees, smooth
from .neighbours import gaussian_edges, knn_graph


def _vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def covariance(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (over n - 1) and number of the vectors.

    Every partition sums the products of its centred vectors as one matrix and hands over a
    row for each dimension, so what is shuffled doesn't grow with the vectors.
    """
    found = mean_vector(nodes).first()["mu"]
    mu = np.array(found or [])
    width = len(mu)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width, width)), 0
        for b in batches:
            z = np.array(b.column("x").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width) - mu
            total += z.T @ z
            n += len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(np.full(width, n)), pa.array(list(total), pa.list_(pa.float64()))], ["a", "n", "sums"])

    out, n = np.zeros((width, width)), 0
    if width:
        parts = nodes.where("x IS NOT NULL").select("x").mapInArrow(scatter, "a int, n long, sums array<double>")
        cells = parts.select("a", F.when(F.col("a") == 0, F.col("n")).otherwise(0).alias("n"), F.posexplode("sums").alias("b", "v")).groupBy("a", "b")
        for r in cells.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():
            out[r["a"], r["b"]] = r["v"]
            n = max(n, r["n"])
    return mu, out / max(1, n - 1), n


@dataclass
class Components:
    mean: np.ndarray
    axes: np.ndarray  # one per row
    variances: np.ndarray

    def scores(self, nodes: DataFrame, whiten: bool = False) -> DataFrame:
        """``(node_id, x)``: places along the axes, divided by their deviation if asked."""
        keep = self.variances > 1e-12 if whiten else np.ones(len(self.axes), bool)
        z = F.zip_with("x", _vector(self.mean), lambda a, b: a - b)
        parts = [dot(F.col("z"), _vector(a)) / float(np.sqrt(v) if whiten else 1.0) for a, v in zip(self.axes[keep], self.variances[keep])]
        return nodes.select("node_id", z.alias("z")).select("node_id", F.array(*parts).alias("x"))


def components(nodes: DataFrame, k: int = 16) -> Components:
    """The first ``k`` principal axes with their variances; each points to the side of its largest entry."""
    mu, cov, _ = covariance(nodes)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    axes = vectors[:, order].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return Components(mu, axes, np.maximum(values[order], 0.0))


def rank_at(nodes: DataFrame, share: float = 0.9) -> int:
    """How many axes hold a share of the variance."""
    _, cov, _ = covariance(nodes)
    values = np.sort(np.maximum(np.linalg.eigvalsh(cov), 0))[::-1]
    return int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share) + 1)


def whitened_edges(nodes: DataFrame, k: int = 15, width: int = 16, max_edges: int | None = None) -> DataFrame:
    """``(src, dst, sim)``: neighbours by distance along whitened principal axes, as Gaussian similarities."""
    white = durable(components(nodes, width).scores(nodes, whiten=True))
    return gaussian_edges(knn_graph(white, k, "euclidean"), max_edges)


def covariance_aligned(nodes: DataFrame, source: DataFrame, target: DataFrame, floor: float = 1e-6) -> DataFrame:
    """``(node_id, x)``: vectors brought from mean and covariance of ``source`` to those of ``target``."""
    (mu_s, cov_s, _), (mu_t, cov_t, _) = covariance(source), covariance(target)

    def power(m: np.ndarray, p: float) -> np.ndarray:
        values, vectors = np.linalg.eigh(m)
        return (vectors * np.maximum(values, floor) ** p) @ vectors.T

    move = power(cov_s, -0.5) @ power(cov_t, 0.5)
    z = F.zip_with("x", _vector(mu_s), lambda a, b: a - b)
    return nodes.select("node_id", z.alias("z")).select("node_id", F.array(*[dot(F.col("z"), _vector(move[:, j])) + F.lit(float(mu_t[j])) for j in range(len(mu_t))]).alias("x"))


def shape_aligned(nodes: DataFrame, target: DataFrame, steps: int = 20, rate: float = 0.1, rounds_rate: float = 0.05) -> DataFrame:
    """``(node_id, x)``: vectors scaled to mean and deviations of ``target``, then moved towards its covariance in steps.

    A step takes rate x rounds_rate of the centred vectors times the pseudo-inverse of the
    difference of covariances away. Means stay, so a step is a matrix and the next covariance
    follows from it: all steps are one matrix of d x d, and the rows are read once.
    """
    (mu_s, cov_s, n_s), (mu_t, cov_t, n_t) = covariance(nodes), covariance(target)
    spread = lambda cov, n: np.sqrt(np.diag(cov) * (n - 1) / max(1, n)) + 1e-8
    move = np.diag(spread(cov_t, n_t) / spread(cov_s, n_s))
    tiny = 1e-6 * np.eye(len(mu_s))
    for _ in range(steps):
        now = move.T @ cov_s @ move
        move = move @ (np.eye(len(mu_s)) - rate * rounds_rate * np.linalg.pinv(now - cov_t + tiny))
    z = F.zip_with("x", _vector(mu_s), lambda a, b: a - b)
    return nodes.select("node_id", z.alias("z")).select("node_id", F.array(*[dot(F.col("z"), _vector(move[:, j])) + F.lit(float(mu_t[j])) for j in range(len(mu_t))]).alias("x"))


def lanczos_gap(nodes: DataFrame, knn: DataFrame, rounds: int = 60, tolerance: float = 1e-6) -> tuple[float, float] | None:
    """Second smallest eigenvalue of the hypergraph Laplacian, and a bound of its error.

    The smoothing operator is symmetric with eigenvalue 1 along the square roots of the
    degrees. Lanczos vectors start across that direction and are kept across it and each
    other; a node's entries of all of them are one array, so a round is one smoothing and two
    sums of products. The largest eigenvalue of the small tridiagonal matrix is within the
    last coefficient times the last entry of its eigenvector.
    """
    degrees = durable(hypergraph_degrees(knn))
    first = nodes.select("node_id").join(degrees.select("node_id", F.sqrt("d_v").alias("one")), "node_id").withColumn("val", F.pmod(F.xxhash64("node_id"), F.lit(1000)) / 1000.0 - 0.5)
    sums = first.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("one") * F.col("one")).alias("size")).first()
    if sums["n"] < 2:
        return None
    basis = first.select("node_id", "val", F.array(F.col("one") / F.lit(sums["size"] ** 0.5)).alias("q"))

    def across(rows: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, float]:
        """``val`` less its parts along the ``k`` vectors, these parts, and its length before."""
        found = rows.agg(*[F.sum(F.col("val") * F.get("q", i)).alias(f"c{i}") for i in range(k)], F.sum(F.col("val") * F.col("val")).alias("size")).first()
        parts = np.array([found[f"c{i}"] for i in range(k)])
        return rows.withColumn("val", F.col("val") - dot(F.col("q"), _vector(parts))), parts, found["size"]

    main, side, best = [], [], None
    for j in range(min(rounds, sums["n"] - 1) + 1):
        once, along, whole = across(basis, j + 1)
        again, more, size = across(once, j + 1)
        length = max(0.0, size - float(more @ more)) ** 0.5
        if j:
            main.append(float(along[-1] + more[-1]))
            values, vectors = np.linalg.eigh(np.diag(main) + np.diag(side[1:], 1) + np.diag(side[1:], -1))
            best = (1.0 - float(values[-1]), length * abs(float(vectors[-1, -1])))
            if best[1] <= tolerance:
                break
        if length <= 1e-12 * max(1.0, whole) ** 0.5:
            break
        side.append(length)
        basis = again.select("node_id", F.concat("q", F.array(F.col("val") / F.lit(length))).alias("q"))
        low = smooth(basis.select("node_id", F.lit(0).alias("dim"), F.get("q", j + 1).alias("val")), knn, degrees).select("node_id", "val")
        basis = durable(basis.join(low, "node_id", "left").select("node_id", F.coalesce("val", F.lit(0.0)).alias("val"), "q"))
    return best or (1.0, 0.0)


def spectral_gap(nodes: DataFrame, knn: DataFrame, rounds: int = 60) -> float | None:
    """Second smallest eigenvalue of the hypergraph Laplacian; nothing for fewer than two nodes."""
    found = lanczos_gap(nodes, knn, rounds)
    return None if found is None else found[0]
