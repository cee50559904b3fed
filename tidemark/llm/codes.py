"""Product codes of vectors, learnt by Lloyd's rounds over filtered kd-trees.

A vector becomes fixed-point integers and is cut into ``PARTS`` consecutive parts. Every
partition packs its vectors into blocks and builds, once, a kd-tree over the parts of each
position in a block; a node holds the bounding box, the count and the sum of its points.
The trees are stored in the shared folder and serve all rounds. A round sends the codebooks
(``PARTS`` x ``ENTRIES`` entries, whatever the table's size) to every block and goes down
the trees level by level: of the entries that are still possible for a box, the one nearest
to its middle removes each entry that is farther at the box's corner most in that entry's
favour. Where one entry is left, the whole subtree is assigned by its cached sum and count;
points are compared one by one only in leaves where several are left. All numbers are
integers, so the result depends neither on the blocks nor on the order of rows.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are
dropped; shorter vectors count as filled up with zeros, as do lengths that ``PARTS`` doesn't
divide; components beyond the range in which squared distances fit 64 bits (about 32,000 at
64 dimensions) are set to its ends; ties go to the lower entry; a null id comes last in the
choice of the first entries, and rows of one id are ordered by their vectors; with fewer
vectors than entries there are as many entries as vectors; repeated rows count as often as
they stand there; an empty table gives an empty result. Vectors longer than a block's
``CELLS`` share no block. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, durable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Most points of a leaf, and numbers of a block.
LEAF, CELLS = 16, 1 << 18


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def largest(width: int) -> int:
    """Power of two to which components are held, so that sums of squared distances over all parts fit 64 bits."""
    return 1 << (58 - width.bit_length()) // 2


def fixed_point(vector: Column, dims: int, limit: int, scale: int = SCALE) -> Column:
    """The components as ``floor(scale * x)`` within ``limit``, filled up with zeros to ``dims``."""
    held = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(limit))), F.lit(-float(limit)))).cast("int"))
    return F.concat(held, F.array_repeat(F.lit(0), dims - F.size(vector)))


# Trees: the nodes of a level cut the points into equal runs


def edges(n: int, level: int) -> np.ndarray:
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def depth(n: int, leaf: int = LEAF) -> int:
    return max(0, (-(-n // leaf) - 1).bit_length())


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points in the tree; lows, highs and sums of its nodes, level after level.

    A node is cut at the median of its widest dimension. Node i of a level has the nodes 2i
    and 2i + 1 below it.
    """
    n = len(points)
    order, low, high, sums = np.arange(n), [], [], []
    for level in range(depth(n, leaf) + 1):
        cuts, at = edges(n, level), points[order]
        low.append(np.minimum.reduceat(at, cuts[:-1]))
        high.append(np.maximum.reduceat(at, cuts[:-1]))
        sums.append(np.add.reduceat(at, cuts[:-1]))
        if level < depth(n, leaf):
            node = np.repeat(np.arange(1 << level), np.diff(cuts))
            order = order[np.lexsort((at[np.arange(n), (high[-1] - low[-1]).argmax(1)[node]], node))]
    return order, np.concatenate(low), np.concatenate(high), np.concatenate(sums)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


def still_possible(low: np.ndarray, high: np.ndarray, alive: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per box, the entry nearest to its middle and which entries may be nearest to a point in it.

    For an entry z and the nearest one z*, the difference of their distances to a point is
    linear in the point and least at the corner in the direction from z* to z. Where even
    that is above zero, or zero with z behind z* in order, no point of the box goes to z.
    """
    far = np.iinfo(np.int64).max
    best = np.where(alive, squared(2 * entries[None], (low + high)[:, None]), far).argmin(1)
    star = entries[best][:, None]
    corner = np.where(entries[None] > star, high[:, None], low[:, None])
    gap = squared(entries[None], corner) - squared(star, corner)
    out = (gap > 0) | ((gap == 0) & (best[:, None] < np.arange(len(entries))))
    return best, alive & ~out


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the runs, one after another."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def filtered(points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, entries: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entry of each point (in the tree's order), counts and sums by entry, and how many points went there with their subtree."""
    n, k = len(points), len(entries)
    owner = np.empty(n, np.int64)
    counts, totals = np.zeros(k, np.int64), np.zeros(entries.shape, np.int64)
    nodes, alive, whole = np.zeros(1, np.int64), np.ones((1, k), bool), 0
    for level in range(depth(n, leaf) + 1):
        cuts, at = edges(n, level), nodes + (1 << level) - 1
        best, alive = still_possible(low[at], high[at], alive, entries)
        one = alive.sum(1) == 1
        starts, sizes = cuts[nodes], cuts[nodes + 1] - cuts[nodes]
        np.add.at(counts, best[one], sizes[one])
        np.add.at(totals, best[one], sums[at[one]])
        owner[spans(starts[one], sizes[one])] = np.repeat(best[one], sizes[one])
        whole += int(sizes[one].sum())
        nodes, alive, starts, sizes = nodes[~one], alive[~one], starts[~one], sizes[~one]
        if level == depth(n, leaf) and len(nodes):
            rest = spans(starts, sizes)
            apart = squared(points[rest][:, None], entries[None])
            owner[rest] = np.where(np.repeat(alive, sizes, axis=0), apart, np.iinfo(np.int64).max).argmin(1)
            np.add.at(counts, owner[rest], 1)
            np.add.at(totals, owner[rest], points[rest])
        nodes, alive = (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(alive, 2, axis=0)
    return owner, counts, totals, whole


# Blocks of trees as rows

_NUMBERS = {"places": np.int32, "points": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}


def pack_blocks(dims: int, parts: int, leaf: int, schema: T.StructType):
    """A task that turns rows of named columns and ``ints`` into rows of blocks with their trees."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out, most = to_arrow_schema(schema), max(1, CELLS // dims)

    def block(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        ints = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["ints"].chunks]).reshape(n, parts, dims // parts).astype(np.int64)
        trees = [build(ints[:, p], leaf) for p in range(parts)]
        cells = {
            "places": [t[0] for t in trees],
            "points": [ints[t[0], p] for p, t in enumerate(trees)],
            "low": [t[1] for t in trees],
            "high": [t[2] for t in trees],
            "sums": [t[3] for t in trees],
        }
        named = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table[c].combine_chunks()) for c in table.column_names if c != "ints"]
        binary = [pa.array([np.stack(cells[c]).astype(kind).tobytes()], pa.binary()) for c, kind in _NUMBERS.items()]
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[a.cast(f.type) for a, f in zip(named, list(out)[1:])], *binary], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, most - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == most:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def trees_of(row: dict, dims: int, parts: int) -> list[tuple[np.ndarray, ...]]:
    """Places, points, lows, highs and sums of each part's tree in a block."""
    width = dims // parts
    arrays = {c: np.frombuffer(row[c], kind).reshape(parts, -1) for c, kind in _NUMBERS.items()}
    return [(arrays["places"][p], *[arrays[c][p].reshape(-1, width).astype(np.int64) for c in ("points", "low", "high", "sums")]) for p in range(parts)]


def rounds_task(books: np.ndarray, dims: int, leaf: int):
    """A task that sums a partition's points by part and entry; ``whole`` are those assigned with a subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = books.shape
        counts, totals, whole = np.zeros((parts, k), np.int64), np.zeros(books.shape, np.int64), np.zeros(parts, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for p, (_, points, low, high, sums) in enumerate(trees_of(row, dims, parts)):
                    _, n, total, at_once = filtered(points, low, high, sums, books[p], leaf)
                    counts[p] += n
                    totals[p] += total
                    whole[p] += at_once
        part, entry = np.divmod(np.arange(parts * k), k)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": counts.ravel(),
            "whole": np.where(entry == 0, whole[part], 0), "sums": pa.array(list(totals.reshape(-1, width)), pa.list_(pa.int64())),
        })

    return run


def coding_task(books: np.ndarray, dims: int, leaf: int, schema: T.StructType):
    """A task that returns every row of a block with its code and error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(books)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                numbers = {c: row.column(c)[0].as_py() for c in _NUMBERS}
                n = row.column("n")[0].as_py()
                codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, (places, points, low, high, sums) in enumerate(trees_of(numbers, dims, parts)):
                    owner = filtered(points, low, high, sums, books[p], leaf)[0]
                    codes[places, p] = owner
                    error[places] += squared(points, books[p][owner])
                text = codes.tobytes().hex()
                code = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
                named = [row.column(f.name).flatten().cast(f.type) for f in list(out)[:-2]]
                yield pa.RecordBatch.from_arrays([*named, code, pa.array(error)], schema=out)

    return run


def first_entries(kept: DataFrame, vec_id: str, parts: int, entries: int) -> np.ndarray:
    """Codebooks (part, entry, component) from the vectors of the smallest ids."""
    rows = kept.orderBy(F.col(vec_id).asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    return np.array([r.ints for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def next_books(books: np.ndarray, stored: DataFrame, dims: int, leaf: int) -> tuple[np.ndarray, int]:
    """The codebooks after one round, and how many parts were assigned with their subtree."""
    sums = stored.select("n", *_NUMBERS).mapInArrow(rounds_task(books, dims, leaf), "part int, entry int, n long, whole long, sums array<long>")
    cells = sums.select("part", "entry", "n", "whole", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at")
    moved, whole = books.copy(), 0
    # As many rows as the codebooks have numbers.
    for r in cells.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("whole").alias("whole")).collect():
        if r.n:
            moved[r.part, r.entry, r["at"]] = r.v // r.n
        whole += r.whole if r["at"] == 0 else 0
    return moved, whole


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, leaf: int = LEAF) -> tuple[DataFrame, np.ndarray | None, list[int]]:
    """Rows ``(vec_id, *carry, code, error)``, the codebooks (part, entry, component), and per round the parts assigned with a subtree.

    ``entries`` may be up to 256; a code has two hexadecimal digits for each part.
    """
    named = df.select(vec_id, *carry).schema
    coded = T.StructType([*named.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    rows = df.select(vec_id, *carry, F.col(vector).alias("v")).where(finite(F.col("v")))
    size = rows.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return df.sparkSession.createDataFrame([], coded), None, []
    dims = parts * max(1, -(-size // parts))
    kept = rows.select(vec_id, *carry, fixed_point(F.col("v"), dims, largest(dims // parts)).alias("ints"))
    books = first_entries(kept, vec_id, parts, entries)
    blocks = T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in named], *[T.StructField(c, T.BinaryType()) for c in _NUMBERS]])
    stored = durable(kept.mapInArrow(pack_blocks(dims, parts, leaf, blocks), blocks))
    whole = []
    for _ in range(rounds):
        books, at_once = next_books(books, stored, dims, leaf)
        whole.append(at_once)
    return stored.mapInArrow(coding_task(books, dims, leaf, coded), coded), books, whole


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors, with the error summed over each label."""
    coded, books, _ = compress(documents(spark, sf_dir, "embeddings"), carry=("label",))
    coded = durable(coded)
    totals = coded.groupBy(F.col("label").alias("t_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, F.expr("label <=> t_label"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same in DuckDB: every part against every entry, round after round."""

    def assigned(r: int) -> str:
        apart = "list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i])))::BIGINT"
        return f"a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(p) AS p, min({{'d': d, 'entry': entry}}) AS m FROM (SELECT vec_id, part, p, entry, {apart} AS d FROM parts JOIN c{r} USING (part)) GROUP BY 1, 2)"

    def moved(r: int) -> str:
        mean = f"""SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (SELECT part, m.entry AS entry, i, sum(p[i]) AS s, count(*) AS n
            FROM (SELECT part, m, p, unnest(range(1, len(p) + 1)) AS i FROM a{r - 1}) GROUP BY 1, 2, 3) GROUP BY 1, 2"""
        return f"c{r} AS MATERIALIZED (SELECT old.part, old.entry, coalesce(new.c, old.c) AS c FROM c{r - 1} old LEFT JOIN ({mean}) new ON old.part = new.part AND old.entry = new.entry)"

    steps = [s for r in range(ROUNDS + 1) for s in ([moved(r)] if r else []) + [assigned(r)]]
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
parts AS (SELECT vec_id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS p FROM (SELECT *, unnest(range(0, {PARTS})) AS part FROM k)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {ENTRIES}),
c0 AS (SELECT part, entry, p AS c FROM parts JOIN first USING (vec_id)),
{", ".join(steps)},
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
done AS (SELECT vec_id, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM done JOIN k USING (vec_id), book
"""
