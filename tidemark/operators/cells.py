"""Nearest neighbours by inverted cells, with as many probes as a wanted recall needs.

Centres of cells are fitted on a bounded sample; every vector is filed under its nearest
centre, and every query visits the cells whose centres are nearest to it. Rows are packed
into blocks of one cell and queries into blocks that carry the cells they visit, so no
vector is copied for a visit; distances are exact, and a window merges what the tasks found.
A cell that holds far more rows than others is dealt to more tasks and blocks.

How many cells are visited is measured, not guessed: for a bounded sample of queries the
exact neighbours among all rows are found (work linear in the rows), and the number of
probes is the least that reaches the wanted share of them. On vectors in clusters a few
cells suffice; on vectors without structure most cells are needed, and the report says so.

Defined cases: fewer rows than cells give a cell a row; equal vectors share a cell; a vector
is its own first neighbour; an empty table gives no neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import durable
from .blocks import beside, packed, packed_by_cell
from .neighbours import BLOCK_ROWS, best_of, nearest

#: Rows on which centres are fitted, queries by which probes are chosen, and cells, at most.
FIT_ROWS, JUDGED_QUERIES, MOST_CELLS = 20_000, 256, 4096
ROUNDS = 12


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit vectors by Lloyd's rounds over cosines; the first are drawn far from each other."""
    x = unit(sample)
    centres = [x[0]]
    near = x @ x[0]
    while len(centres) < min(cells, len(x)):
        centres.append(x[near.argmin()])
        near = np.maximum(near, x @ centres[-1])
    out = np.array(centres)
    for _ in range(rounds):
        owner = (x @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, owner, x)
        filled = np.linalg.norm(sums, axis=1) > 0
        out[filled] = unit(sums[filled])
    return out


def by_hash(nodes: DataFrame, most: int, seed: int) -> DataFrame:
    """The ``most`` rows of least hash."""
    return nodes.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").limit(most)


@dataclass(frozen=True)
class Index:
    """Filed rows ``(node_id, x, cell)`` with their centres, the rows of each cell, and the number of probes."""

    filed: DataFrame
    centres: np.ndarray
    sizes: dict[int, int]
    probes: int
    #: Share of exact neighbours that so many probes found for the judged queries.
    judged_recall: float


def nearest_cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``(node_id, x, cells)``: the cells nearest to each row, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(np.stack(b.column("x").to_numpy(zero_copy_only=False)).astype(np.float64))
                near = np.argsort(-np.round(x @ centres.T, 12), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("node_id"), b.column("x"), pa.array(list(near), pa.list_(pa.int32()))], ["node_id", "x", "cells"])

    return rows.select("node_id", "x").mapInArrow(run, "node_id long, x array<double>, cells array<int>")


def build_index(nodes: DataFrame, k: int, target: float = 0.95, cells: int | None = None, seed: int = 42) -> Index:
    """File ``nodes(node_id, x)`` and choose the number of probes."""
    if cells is None:
        cells = max(1, min(MOST_CELLS, round(math.sqrt(nodes.count()))))
    sample = [r.x for r in by_hash(nodes, FIT_ROWS, seed).select("x").collect()]
    if not sample:
        return Index(nodes.select("node_id", "x", F.lit(0).alias("cell")), np.zeros((1, 1)), {}, 1, 1.0)
    centres = fit_centres(np.array(sample, np.float64), cells)
    filed = durable(nearest_cells(nodes, centres, 1).select("node_id", "x", F.get("cells", 0).alias("cell")))
    sizes = {r.cell: r["count"] for r in filed.groupBy("cell").count().collect()}
    # Exact neighbours of the judged queries, and how near their cells are to each query.
    judged = durable(by_hash(nodes, JUDGED_QUERIES, seed + 1))
    found = nearest(judged, filed.select("node_id", "x"), k + 1).where("rank > 0")
    cell_of = filed.select(F.col("node_id").alias("j"), "cell")
    order = nearest_cells(judged, centres, len(centres)).select(F.col("node_id").alias("i"), "cells")
    places = found.join(cell_of, "j").join(F.broadcast(order), "i").select(F.array_position("cells", F.col("cell")).alias("place"))
    counts = {r.place: r["count"] for r in places.groupBy("place").count().collect()}
    total, seen, probes = sum(counts.values()), 0, 0
    while probes < len(centres) and (not total or seen < target * total) or probes == 0:
        probes += 1
        seen += counts.get(probes, 0)
    return Index(filed, centres, sizes, probes, seen / total if total else 1.0)


def neighbours(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``(i, j, rank, dist)``: the ``k`` nearest rows in the visited cells by cosine; a row that is filed comes first for itself."""
    # A row a cell, so at most MOST_CELLS.
    blocks = F.broadcast(queries.sparkSession.createDataFrame([(int(c), math.ceil(n / BLOCK_ROWS)) for c, n in index.sizes.items()], "cell int, n int"))
    filed = index.filed.join(blocks, "cell").withColumn("part", F.pmod(F.xxhash64("node_id"), F.col("n")).cast("int"))
    visiting = packed(nearest_cells(queries, index.centres, index.probes), BLOCK_ROWS)
    return best_of(beside(visiting, packed_by_cell(filed, BLOCK_ROWS)), k, "cosine", cells=len(index.centres))


def pairs_compared(index: Index, queries: DataFrame) -> int:
    """Distances that ``neighbours`` takes for these queries, those to centres left out."""
    visits = nearest_cells(queries, index.centres, index.probes).select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()
    return sum(r["count"] * index.sizes.get(r.cell, 0) for r in visits)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours, self left out, that were found."""
    pairs = exact.where("i <> j").select("i", "j")
    both = pairs.join(found.where("i <> j").select("i", "j", F.lit(1).alias("hit")), ["i", "j"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0


def indexed_neighbours(nodes: DataFrame, k: int = 10, target: float = 0.95, cells: int | None = None, seed: int = 42) -> DataFrame:
    """Neighbourhoods of self and about the ``k`` nearest others, for tables beyond the exact join."""
    return neighbours(build_index(nodes, k, target, cells, seed), nodes, k + 1)


def report(nodes: DataFrame, k: int = 10, target: float = 0.95, every: int = 50, cells: int | None = None) -> DataFrame:
    """One row: cells, probes, and for the ids that ``every`` divides their recall against brute force and the share of all pairs that was compared."""
    index = build_index(nodes, k, target, cells)
    queries = durable(nodes.where(F.col("node_id") % every == 0).select("node_id", "x"))
    n, m = sum(index.sizes.values()), queries.count()
    hit = recall(neighbours(index, queries, k + 1), nearest(queries, nodes, k + 1))
    share = pairs_compared(index, queries) / max(1, n * m)
    row = (n, m, len(index.centres), index.probes, float(hit), float(share), float(index.judged_recall))
    return nodes.sparkSession.createDataFrame([row], "n long, queries long, cells int, probes int, recall double, compared double, judged_recall double")
