"""Boosted quantile regression: histogram trees under the pinball loss.

Features are cut into bins once, at approximate quantiles, and stored as bytes. A boosting
round grows one tree level by level. Every task finds, for its rows, the prediction of all
trees so far, the node in the new tree and whether the score is above the prediction, and
counts rows by node, feature and bin; Spark sums the counts, and the driver picks splits
from a table of nodes x features x bins, whatever the number of rows. Leaf values are exact
quantiles of the residuals, found by histograms that are refined around the wanted rank.
Rows carry no state between rounds: tasks compute it from the trees, which are small, so a
lost executor costs one task and no plan grows.

Defined cases: rows without score, or whose vector is null, are left out of the fit; a null
or NaN component falls into the lowest bin; a feature of one value is never split; no rows
give a model whose predictions are null; equal gains go to the first feature and bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distribution import at_rank, select
from ..functions.lineage import durable

#: Bins of a feature, bins of a residual histogram, and values that are looked at one by one.
BINS, CELLS, FEW = 64, 1024, 10_000
#: Rows of a task.
TASK_ROWS = 100_000


@dataclass
class Tree:
    """Splits of the nodes of each level, breadth first; -1 splits nothing and sends all rows left."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    value: np.ndarray | None = None

    def leaf(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Place of each row among the nodes of a level."""
        at = np.zeros(len(bins), np.int64)
        for level in range(levels):
            node = (1 << level) - 1 + at
            f, c = np.array(self.feature)[node], np.array(self.cut)[node]
            at = 2 * at + ((f >= 0) & (bins[np.arange(len(bins)), np.maximum(f, 0)] > c))
        return at


@dataclass
class QuantileTrees:
    """A fitted model: where bins end, the first guess and the trees."""

    level: float
    edges: list[np.ndarray]
    start: float | None
    rate: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, np.nan_to_num(x[:, i], nan=-np.inf), side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8) if self.edges else np.zeros((len(x), 0), np.uint8)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for t in self.trees:
            out += self.rate * t.value[t.leaf(bins, self.depth)]
        return out

    def reach(self) -> tuple[float, float]:
        """Between which numbers predictions lie."""
        ends = [(self.rate * t.value.min(), self.rate * t.value.max()) for t in self.trees]
        return self.start + sum(a for a, _ in ends), self.start + sum(b for _, b in ends)


def vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.array([np.nan if v is None else v for row in column.to_pylist() for v in row], np.float64).reshape(-1, width)


def bin_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Of each feature the values that end its bins, but the last; at most ``bins`` - 1."""
    shares = [i / bins for i in range(1, bins)]
    cuts = rows.agg(*[F.percentile_approx(F.get("x", i).cast("double"), shares, 10_000).alias(f"f{i}") for i in range(width)], *[F.max(F.get("x", i).cast("double")).alias(f"m{i}") for i in range(width)]).first()
    return [np.array(sorted({v for v in cuts[f"f{i}"] or [] if v < cuts[f"m{i}"]})) for i in range(width)]


def counts_of(stored: DataFrame, model: QuantileTrees, tree: Tree, level: int, bins: int) -> np.ndarray:
    """Rows, and rows above their prediction, by node of the level, feature and bin."""
    width = len(model.edges)
    shape = (1 << level, width, bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, *shape), np.int64)
        for b in batches:
            x, s = rows_of(b, width)
            above = (s > model.raw(x)).astype(np.int64)
            cell = (tree.leaf(x, level)[:, None] * width + np.arange(width)) * bins + x
            out[0] += np.bincount(cell.ravel(), minlength=out[0].size).reshape(shape)
            out[1] += np.bincount(cell.ravel(), weights=np.repeat(above, width), minlength=out[0].size).astype(np.int64).reshape(shape)
        at = np.flatnonzero(out[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[0].ravel()[at]), pa.array(out[1].ravel()[at])], ["cell", "n", "above"])

    found = np.zeros((2, int(np.prod(shape))), np.int64)
    for r in stored.mapInArrow(run, "cell long, n long, above long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("above").alias("above")).collect():
        found[:, r.cell] = r.n, r.above
    return found.reshape(2, *shape)


def rows_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, width)
    return x, batch.column("s").to_numpy(zero_copy_only=False)


def best_splits(counts: np.ndarray, level: float) -> list[tuple[int, int]]:
    """Feature and last bin to the left for each node, by the gain in squared error of the gradients; (-1, 0) if none gains."""
    n, above = counts
    grad = above - (1 - level) * n  # above the prediction it is the level, below it level - 1
    out = []
    for node in range(n.shape[0]):
        n_left, g_left = n[node].cumsum(1)[:, :-1], grad[node].cumsum(1)[:, :-1]
        n_all, g_all = n[node].sum(1, keepdims=True), grad[node].sum(1, keepdims=True)
        n_right = n_all - n_left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g_left**2 / n_left + (g_all - g_left) ** 2 / n_right - g_all**2 / n_all
        gain = np.where((n_left > 0) & (n_right > 0), np.round(gain, 9), -1.0)
        best = int(gain.argmax()) if gain.size else 0
        out.append(divmod(best, gain.shape[1]) if gain.size and gain.flat[best] > 0 else (-1, 0))
    return out


def leaf_quantiles(stored: DataFrame, model: QuantileTrees, tree: Tree, spread: tuple[float, float]) -> np.ndarray:
    """Of each leaf the smallest residual whose rank reaches the level; 0 in empty leaves."""
    width, leaves = len(model.edges), 1 << model.depth
    low_f, high_f = model.reach()
    lows, highs = np.full(leaves, spread[0] - high_f - 1e-9), np.full(leaves, spread[1] - low_f + 1e-9)
    before, rank, out = np.zeros(leaves, np.int64), None, np.zeros(leaves)
    open_ = np.ones(leaves, bool)

    def task(lows: np.ndarray, highs: np.ndarray, open_: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(leaves * CELLS, np.int64)
            least, most = np.full(leaves * CELLS, np.inf), np.full(leaves * CELLS, -np.inf)
            for b in batches:
                x, s = rows_of(b, width)
                at, r = tree.leaf(x, model.depth), s - model.raw(x)
                inside = open_[at] & (r >= lows[at]) & (r <= highs[at])
                at, r = at[inside], r[inside]
                cell = at * CELLS + np.clip(((r - lows[at]) / np.maximum(highs[at] - lows[at], 1e-300) * CELLS).astype(np.int64), 0, CELLS - 1)
                n += np.bincount(cell, minlength=len(n))
                np.minimum.at(least, cell, r)
                np.maximum.at(most, cell, r)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(least[at]), pa.array(most[at])], ["cell", "n", "least", "most"])

        return run

    while open_.any():
        summed = stored.mapInArrow(task(lows, highs, open_), "cell long, n long, least double, most double").groupBy("cell")
        cells = sorted(tuple(r) for r in summed.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect())
        if rank is None:
            total = np.zeros(leaves, np.int64)
            for c, n, _, _ in cells:
                total[c // CELLS] += n
            rank = np.maximum(1, np.ceil(np.round(total * model.level, 9)).astype(np.int64))
            open_ = total > 0
        seen = before.copy()
        settled = np.zeros(leaves, bool)
        for c, n, least, most in cells:
            leaf = c // CELLS
            if not open_[leaf] or settled[leaf]:
                continue
            if seen[leaf] + n >= rank[leaf]:
                settled[leaf] = True
                before[leaf], lows[leaf], highs[leaf] = seen[leaf], least, most
                if least == most or rank[leaf] == seen[leaf] + 1:
                    out[leaf], open_[leaf] = least, False
                elif rank[leaf] == seen[leaf] + n:
                    out[leaf], open_[leaf] = most, False
            seen[leaf] += n
    return out


def fit(rows: DataFrame, level: float = 0.95, trees: int = 40, depth: int = 3, rate: float = 0.1, bins: int = BINS) -> QuantileTrees:
    """Fit the ``level`` quantile of ``s`` given the vector ``x``; rows of one width."""
    rows = rows.where("x IS NOT NULL AND s IS NOT NULL").select(F.col("x"), F.col("s").cast("double").alias("s"))
    stats = select(rows, {"start": at_rank(F.col("s"), lambda n: max(1, int(np.ceil(round(n * level, 9)))))}, n=F.count(F.lit(1)), low=F.min("s"), high=F.max("s"), width=F.max(F.size("x")))
    model = QuantileTrees(level, [], stats["start"], rate, depth)
    if not stats["n"]:
        return model
    width = stats["width"]
    model.edges = bin_edges(rows, width, bins)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.binned(vectors(b.column("x"), width))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column("s")], ["bins", "s"])

    stored = durable(rows.mapInArrow(packed, "bins binary, s double").coalesce(max(1, -(-stats["n"] // TASK_ROWS))))
    for _ in range(trees):
        tree = Tree()
        for at in range(depth):
            for f, c in best_splits(counts_of(stored, model, tree, at, bins), level):
                tree.feature.append(f)
                tree.cut.append(c)
        tree.value = leaf_quantiles(stored, model, tree, (stats["low"], stats["high"]))
        model.trees.append(tree)
    return model


def predict(rows: DataFrame, model: QuantileTrees, name: str = "threshold") -> DataFrame:
    """``(node_id, <name>)`` for rows with node_id and ``x``."""
    width = len(model.edges)
    if model.start is None:
        return rows.select("node_id", F.lit(None).cast("double").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node_id"), pa.array(model.raw(model.binned(vectors(b.column("x"), width))))], ["node_id", name])

    return rows.where("x IS NOT NULL").select("node_id", "x").mapInArrow(run, f"node_id long, {name} double")


def boosted_quantile_threshold(nodes: DataFrame, scores: DataFrame, alpha: float = 0.05, **how) -> DataFrame:
    """``(node_id, threshold)`` of test nodes: the 1 - alpha quantile of scores of calibration normals that look like them."""
    cal = nodes.where("split = 'cal' AND y = 0").select("node_id", "x").join(scores.select("node_id", "s"), "node_id")
    return predict(nodes.where("split = 'test'"), fit(cal, 1 - alpha, **how))
