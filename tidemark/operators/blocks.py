"""Every block of vectors beside every other, without a copy of a vector a pair.

Vectors are packed once into blocks, a row each, and stored. Pairs of blocks are Spark's
cartesian product of the stored rows: a task reads one block of the left and a stretch of
the right straight from the store, so nothing but what a task found is ever shuffled, and
disk grows with the rows instead of with their square. Memory is bounded by a block and a
stretch; the work is that of the definition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import durable

#: Bytes of a block's vectors at most, and of a stretch of blocks that a task holds, about.
BLOCK_BYTES, STRETCH_BYTES = 1 << 22, 1 << 25

NAMES = ["block", "cell", "ids", "xs", "cells"]
SCHEMA = "block long, cell int, ids binary, xs binary, cells binary"


def matrix(lists: pa.Array, dtype) -> np.ndarray:
    """Rows of equal lengths as a matrix; a null component is NaN."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    width = len(values) // max(1, len(lists))
    if len(values) != width * len(lists) or lists.null_count or set(lists.value_lengths().unique().to_pylist()) - {width}:
        raise ValueError("vectors must have one length and not be null")
    return values.reshape(len(lists), width)


def _pack(per: int, tag: int):
    """Rows ``(id, v, cell, cells)``, those of a cell in a row, as blocks of up to ``per``; ``tag`` leads their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (tag << 60) | TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            parts = [np.concatenate([h[i] for h in held]).tobytes() for i in (1, 2, 3)]
            number, cell = number + 1, held[0][0]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([cell], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]], NAMES)

        for b in batches:
            if not b.num_rows:
                continue
            ids, x, cell, cells = b.column(0).to_numpy(), matrix(b.column(1), np.float64), b.column(2).to_numpy(), matrix(b.column(3), np.int32)
            most = max(1, min(per, BLOCK_BYTES // max(1, 8 * x.shape[1])))
            at = 0
            while at < len(ids):
                if held and held[0][0] != cell[at]:
                    yield block()
                same = np.flatnonzero(cell[at:] != cell[at])
                end = min(at + (int(same[0]) if len(same) else len(ids) - at), at + most - sum(len(h[1]) for h in held))
                held.append((int(cell[at]), ids[at:end], x[at:end], cells[at:end]))
                at = end
                if sum(len(h[1]) for h in held) >= most:
                    yield block()
        if held:
            yield block()

    return run


def packed(rows: DataFrame, per: int, x: Column | str = "x", tag: int = 0) -> DataFrame:
    """Stored blocks of ``rows(node_id, x)``, about ``per`` rows and a partition each; visited ``cells`` go along if given."""
    cells = F.col("cells") if "cells" in rows.columns else F.array().cast("array<int>")
    flat = rows.select(F.col("node_id").cast("long").alias("id"), (F.col(x) if isinstance(x, str) else x).alias("v"), F.lit(0).alias("cell"), cells.alias("cells"))
    return durable(flat.repartition(max(1, math.ceil(rows.count() / per))).mapInArrow(_pack(per, tag), SCHEMA))


def packed_by_cell(filed: DataFrame, per: int) -> DataFrame:
    """The same for ``filed(node_id, x, cell, part)``; a block holds rows of one cell, and a cell is dealt by its parts."""
    flat = filed.repartition("cell", "part").sortWithinPartitions("cell").select(F.col("node_id").cast("long").alias("id"), F.col("x").alias("v"), F.col("cell").cast("int").alias("cell"), F.array().cast("array<int>").alias("cells"))
    return durable(flat.mapInArrow(_pack(per, 0), SCHEMA))


def beside(left: DataFrame, right: DataFrame, each_once: bool = False) -> DataFrame:
    """Every block of ``left`` beside every block of ``right``, or beside those numbered from its own on; a left block's pairs come in a row."""
    size = right.agg(F.sum(F.length("xs"))).first()[0] or 0
    stretches = right.coalesce(max(1, math.ceil(size / STRETCH_BYTES))).select("block", "cell", "ids", "xs").toDF("r_block", "r_cell", "r_ids", "r_xs")
    on = F.col("block") <= F.col("r_block") if each_once else F.lit(True)
    return left.join(stretches.hint("shuffle_replicate_nl"), on)


def vectors(ids: bytes, xs: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(xs, np.float64).reshape(len(own), -1)
