"""Exact and approximate nearest neighbours.

The exact join compares blocks with blocks (``blocks``): vectors are packed into blocks of
``BLOCK_ROWS``, a task meets one block of queries with a stretch of the pool and keeps each
query's k best, and a window merges the k best of all stretches. One matrix product a pair
of blocks, in short floats and with a bound of its error, says which pairs may be among the
best; their distances are then summed component by component, so a result does not depend
on how the rows were dealt. Memory and disk are bounded by the rows and the results; the
work is that of the definition. Beyond that, ``approximate_neighbours`` joins by
locality-sensitive hashing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import beside, packed, vectors

BLOCK_ROWS = 2048
DIGITS = 9
#: Pairs whose distances are summed at once.
CHUNK = 1 << 20


def _in_order(pairs: Iterator[np.ndarray]) -> np.ndarray:
    """The sum of arrays, added one after another."""
    total = 0.0
    for p in pairs:
        total = total + p
    return total


class Best:
    """The ``k`` nearest of all vectors met so far for a block of queries; equal distances go by id, an own id comes first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str):
        self.k, self.metric, self.ids = k, metric, ids
        self.x = self.scaled(x)
        self.norms = np.sqrt((self.x * self.x).sum(1))
        self.short, self.columns = self.x.astype(np.float32), np.ascontiguousarray(self.x.T)
        self.by_id = np.argsort(ids, kind="stable")
        # Kept pairs: place of the query, id, distance; and the distance that a better one must not exceed.
        self.row, self.j, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(len(ids), np.inf)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return x
        return x / np.maximum(np.sqrt(_in_order(c * c for c in x.T)), 1e-300)[:, None]

    def same(self, jds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of equal ids among the queries and ``jds``."""
        own = self.ids[self.by_id]
        low, high = np.searchsorted(own, jds), np.searchsorted(own, jds, "right")
        at = np.flatnonzero(high > low)
        rows = [self.by_id[low[c] : high[c]] for c in at]
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(at, [len(r) for r in rows])

    def candidates(self, short: bool, places: np.ndarray, y: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Which pairs may be among the best, by scores that order a query's distances."""
        kind = np.float32 if short else np.float64
        a = (self.short if short else self.x)[places]
        product = a @ y.astype(kind).T
        mine, longest = self.norms[places], norms.max()
        unit = (y.shape[1] + 8) * np.finfo(kind).eps / 2
        if self.metric == "cosine":
            score = np.negative(product, out=product)
            error, near, known = unit * mine * longest, 2 * 10.0**-DIGITS, self.worst[places] - 1
        else:
            product *= -2
            score = np.add(product, (norms * norms).astype(kind)[None], out=product)
            reach = mine + longest
            error, near, known = unit * reach * reach, 4 * 10.0**-DIGITS * (reach + 1), self.worst[places] ** 2 - mine * mine
        if not (np.isfinite(longest) and np.isfinite(mine).all()):
            score[np.isnan(score)] = np.inf
        limit = known + error + near
        if np.isinf(self.worst[places]).any() and score.shape[1] > self.k:
            limit = np.minimum(np.where(np.isnan(limit), np.inf, limit), np.partition(score, self.k - 1, axis=1)[:, self.k - 1] + 2 * error + near)
        limit[np.isnan(limit)] = np.inf
        # Rounded up, as the comparison is in the scores' precision.
        return score <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None]

    def meet(self, jds: np.ndarray, y: np.ndarray, places: np.ndarray | None = None) -> None:
        """Compare the queries at ``places`` (all of them) with a block of the pool."""
        places = np.arange(len(self.ids)) if places is None else places
        if not len(places) or not len(jds):
            return
        y = self.scaled(y)
        norms = np.sqrt((y * y).sum(1))
        short = bool(norms.max() < 1e15 and self.norms.max() < 1e15)
        maybe = self.candidates(short, places, y, norms)
        if short and np.count_nonzero(maybe) > 16 * self.k * len(places):
            maybe = self.candidates(False, places, y, norms)
        back = np.full(len(self.ids), -1)
        back[places] = np.arange(len(places))
        rows, cols = self.same(jds)
        mine = back[rows] >= 0
        maybe[back[rows[mine]], cols[mine]] = True
        columns = np.ascontiguousarray(y.T)
        found = np.flatnonzero(maybe)
        for at in range(0, len(found), CHUNK):
            r, c = np.divmod(found[at : at + CHUNK], len(jds))
            self.keep(places[r], jds[c], self.distances(places[r], columns, c))

    def distances(self, r: np.ndarray, columns: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return 1 - _in_order(a[r] * b[c] for a, b in zip(self.columns, columns))
        return np.sqrt(_in_order((a[r] - b[c]) ** 2 for a, b in zip(self.columns, columns)))

    def keep(self, row: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        d = np.where(self.ids[row] == j, -1.0, np.round(d, DIGITS))  # a vector is its own first neighbour
        row, j, d = (np.concatenate(p) for p in ((self.row, row), (self.j, j), (self.d, d)))
        order = np.lexsort((j, d, row))
        row = row[order]
        first = np.searchsorted(row, np.arange(len(self.ids)))
        kept = np.arange(len(row)) - first[row] < self.k
        self.row, self.j, self.d = row[kept], j[order][kept], d[order][kept]
        end = np.searchsorted(self.row, np.arange(len(self.ids)), "right") - 1
        full = np.bincount(self.row, minlength=len(self.ids)) >= self.k
        self.worst[full] = self.d[end[full]]

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.j), pa.array(self.d)], ["i", "j", "dist"])


def best_of(pairs: DataFrame, k: int, metric: str, cells: int = 0) -> DataFrame:
    """``(i, j, rank, dist)`` of pairs of blocks; with ``cells`` a query meets only blocks of the cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, visits = None, None, None
        for b in batches:
            for block, cell, ids, xs, visited, r_ids, r_xs in zip(*(c.to_pylist() if c.type in (pa.int64(), pa.int32()) else c for c in b.columns)):
                if block != now:
                    if best is not None:
                        yield best.found()
                    now, best = block, Best(*vectors(ids.as_buffer(), xs.as_buffer()), k, metric)
                    if cells:
                        chosen = np.frombuffer(visited.as_buffer(), np.int32).reshape(len(best.ids), -1)
                        visits = np.zeros((len(best.ids), cells), bool)
                        visits[np.arange(len(best.ids))[:, None], chosen] = True
                best.meet(*vectors(r_ids.as_buffer(), r_xs.as_buffer()), np.flatnonzero(visits[:, cell]) if cells else None)
        if best is not None:
            yield best.found()

    found = pairs.select("block", "r_cell", "ids", "xs", "cells", "r_ids", "r_xs").mapInArrow(run, "i long, j long, dist double")
    order = Window.partitionBy("i").orderBy("dist", "j")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("i", "j", "rank", F.greatest("dist", F.lit(0.0)).alias("dist"))


def nearest(queries: DataFrame, pool: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """``(i, j, rank, dist)``: the ``k`` nearest of ``pool(node_id, x)`` to each of ``queries``; self comes at rank 0."""
    right = packed(pool, BLOCK_ROWS)
    left = right if queries is pool else packed(queries, BLOCK_ROWS)
    return best_of(beside(left, right), k, metric)


def knn_graph(nodes: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Neighbourhoods of self and the ``k`` nearest others."""
    return nearest(nodes, nodes, k + 1, metric)


def undirected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Each pair once, smaller id first, without self-loops."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def gaussian_edges(knn: DataFrame, max_edges: int | None = None) -> DataFrame:
    """``(src, dst, sim)`` with sim = exp(-d^2 / 2), the largest per pair; optionally the top edges only."""
    sims = knn.where("i <> j").groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.max(F.exp(-F.col("dist") * F.col("dist") / 2)).alias("sim"))
    return sims.orderBy(F.desc("sim"), "src", "dst").limit(max_edges) if max_edges else sims


def approximate_neighbours(nodes: DataFrame, k: int, bucket: float = 0.5, tables: int = 8, radius: float = 1.2, seed: int = 42) -> DataFrame:
    """Nearest neighbours by cosine through random projections of unit vectors; some may be missed."""
    unit = nodes.select(F.col("node_id").alias("id"), array_to_vector(F.transform("x", lambda v: v / F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, q: s + q * q)))).alias("u"))
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit)
    pairs = model.approxSimilarityJoin(unit, unit, radius, "d").select(F.col("datasetA.id").alias("i"), F.col("datasetB.id").alias("j"), F.round(F.col("d") * F.col("d") / 2, DIGITS).alias("dist"))
    order = Window.partitionBy("i").orderBy(F.when(F.col("i") == F.col("j"), -1.0).otherwise(F.col("dist")), "j")
    return pairs.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") <= k)


def random_neighbours(nodes: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """Control: ``k`` others per node, drawn by hash from consecutive hash ranks, and self."""
    from .split import hash_rank

    ranked = hash_rank(nodes.select("node_id"), "node_id", seed)
    drawn = ranked.select(F.col("node_id").alias("i"), "rn", "n", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("rank"))
    place = F.pmod(F.col("rn") - 1 + F.col("rank"), F.col("n")) + 1
    targets = ranked.select(F.col("node_id").alias("j"), F.col("rn").alias("place"))
    return drawn.withColumn("place", place).join(targets, "place").select("i", "j", "rank").dropDuplicates(["i", "j"])

