"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints. A text's shingles are hashed with XXH64; a fingerprint bit is 1 if it is
set in over half of the hashes.

Distribution. Two fingerprints within r bits agree on at least one of r + 1 pieces, so each
fingerprint goes to r + 1 nodes, one a piece. A node is named by the low bits of its piece,
no more of them than leave it about ``NODE_ROWS`` fingerprints: who agree on a piece agree on
its low bits, so nothing is lost, and nodes are wide enough for the index to do the pruning.
A node above ``NODE_CAP`` fingerprints is not searched in one task; its members go one level
down, where the rest of the fingerprint is cut into r + 1 pieces again, taken whole.
Fingerprints are distinct, and levels follow until no more than 14 bits are free, so every
node ends at or below the cap and no link is lost.

Index. Within a node the fingerprints stand in Gray order. Runs of ``FAN_OUT`` neighbours,
and runs of runs, have an index node each, up to one root: it holds the bits that all below
it share, as mask and pattern. A search goes down from the root paired with itself. A pair
of index nodes carries the differences that its shared bits show; a pair of children adds
those of the bits that are shared by them and were not by their parents. A pair above r is
dropped with all that is below it, and so is a pair that lies in one component already.
Rows that are next to each other in Gray order are linked first, which makes components
early. A node gives one link from each member of a component to the smallest id in it, so a
group of near copies costs a row per member and not one per pair, and nodes that hold the
same group give the same links.

Defined cases: a null text is empty; fewer words than a shingle make one shingle of them
all; no words give the fingerprint zero, linked like any other; a null doc_id is ignored
as a component's smallest id unless there is no other; repeated rows stay repeated in
``op5`` and are copies in ``drop_near_duplicates``; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, documents, durable, packed, stored, whole_text

SHINGLE = 3
RADIUS = 3
HASH_SEED = 42
NODE_CAP = 16_384
NODE_ROWS = 1_024
#: Two, as a run of two shares most bits: of 16,000 random fingerprints 5 % of all pairs are met, of runs of 16 a third.
FAN_OUT = 2
#: Rows to each side that are compared before the search, and pairs that a search expands at once.
GAPS = 4
PAIRS = 1 << 19
#: Near-duplicate stage: sets of five words; fingerprints propose, exact comparison decides (jaccard.py).
STAGE_SHINGLE = 5

_SPACE = SPACE_CHARS.encode()
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SPACE, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_SPACE))
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle as unsigned 64-bit numbers, in the order of the text."""
    from xxhash import xxh64_intdigest

    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_PLAIN), np.uint8)
    ink = raw != 32
    joined = raw[ink | np.append(False, ink[:-1])].tobytes().rstrip(b" ")
    if not joined:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(joined))
    width = min(shingle, len(ends))
    starts, ends = starts[: len(ends) - width + 1], ends[width - 1 :]
    out = np.empty(len(starts), np.uint64)
    # Numbers of Python's own take more memory than a long text; so few at a time.
    for at in range(0, len(out), _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        part = out[at : at + _CHUNK]
        part[:] = np.fromiter((xxh64_intdigest(joined[x:y], HASH_SEED) for x, y in spans), np.uint64, len(part))
    return out


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned 64-bit number."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of unsigned 64-bit numbers."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return prints(text)


def gray_rank(word: Column) -> Column:
    """Place of a 64-bit word in Gray order, as a signed long in that order."""
    for shift in (1, 2, 4, 8, 16, 32):
        word = word.bitwiseXOR(F.shiftrightunsigned(word, shift))
    return word.bitwiseXOR(F.lit(-(1 << 63)))


def _pigeonholes(node: Column, rest: Column, bits: int, pieces: int, most: int = 64) -> tuple[Column, int]:
    """Child nodes of ``rest``, whose low ``bits`` are free, with what stays free below each.

    A child is named by the low ``most`` bits of its piece, or by all if there are fewer;
    where no bits name it, one child holds all.
    """
    width = -(-bits // pieces)
    children, free = [], 0
    for j in range(pieces if most else 1):
        low, own = j * width, min(width, bits - j * width, most)
        if bits - j * width <= 0:
            continue
        free = max(free, bits - own)
        piece = F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << own) - 1)) if own < 64 else rest
        kept_low = rest.bitwiseAND(F.lit((1 << low) - 1))
        kept_high = F.shiftleft(F.shiftrightunsigned(rest, low + own), low) if low + own < 64 else F.lit(0).cast("long")
        children.append(F.struct(F.xxhash64(node, F.lit(j), piece).alias("node"), kept_low.bitwiseOR(kept_high).alias("rest")))
    return F.array(*children), free


class _Index:
    """Index nodes over rows that are sorted by node and Gray rank, level by level; links by a search from the roots."""

    def __init__(self, node: np.ndarray, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.parent = prints, radius, np.arange(len(prints))
        #: Of each level the pairs that the search met there, and those that it kept.
        self.met: dict[int, list[int]] = {}
        #: Of each level: pattern, bits that are not of one mind below, first child, owner.
        self.levels = [(prints, np.zeros_like(prints), np.arange(len(prints) + 1), node)]
        while (owner := self.levels[-1][3]).size and (owner[1:] == owner[:-1]).any():
            self.levels.append(self._above(*self.levels[-1]))
        for gap in range(1, GAPS + 1):
            x = np.flatnonzero((node[:-gap] == node[gap:]) & (np.bitwise_count(prints[:-gap] ^ prints[gap:]) <= radius))
            self._join(x, x + gap)

    @staticmethod
    def _above(pattern: np.ndarray, loose: np.ndarray, _: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        begin = np.append(True, owner[1:] != owner[:-1])
        place = np.arange(len(owner)) - np.maximum.accumulate(np.where(begin, np.arange(len(owner)), 0))
        first = np.flatnonzero(place % FAN_OUT == 0)
        own = np.repeat(pattern[first], np.diff(np.append(first, len(pattern))))
        return pattern[first], np.bitwise_or.reduceat(loose | (pattern ^ own), first), np.append(first, len(pattern)), owner[first]

    def roots(self) -> np.ndarray:
        """Each row's component, after shortening the ways there."""
        while (self.parent != (up := self.parent[self.parent])).any():
            self.parent = up
        return self.parent

    def _join(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            root = self.roots()
            a, b = root[x], root[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def _labels(self) -> list[np.ndarray]:
        """Of each index node the component that all rows below it are in, or -1."""
        labels = [self.roots()]
        for _, _, first, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(labels[-1], first[:-1]), np.maximum.reduceat(labels[-1], first[:-1])
            labels.append(np.where(low == high, low, -1))
        return labels

    def components(self) -> np.ndarray:
        """Each row's component once all pairs within the radius are linked."""
        if len(self.levels) == 1:
            return self.roots()
        top = np.arange(len(self.levels[-1][0]))
        todo = [(len(self.levels) - 1, top, top, np.zeros(len(top), np.int64))]
        labels = self._labels()
        while todo:
            level, a, b, known = todo.pop()
            one = (labels[level][a] == labels[level][b]) & (labels[level][a] >= 0)
            a, b, known = a[~one], b[~one], known[~one]
            if not len(a):
                continue
            first = self.levels[level][2]
            counts = (first[a + 1] - first[a]) * (first[b + 1] - first[b])
            fits = max(1, int(np.searchsorted(np.cumsum(counts), PAIRS)))
            if fits < len(a):
                todo.append((level, a[fits:], b[fits:], known[fits:]))
                a, b, known, counts = a[:fits], b[:fits], known[:fits], counts[:fits]
            i, j, seen = self._children(level, a, b, known, counts)
            if level == 1:
                self._join(i, j)
                if len(i):
                    labels = self._labels()
            else:
                todo.append((level - 1, i, j, seen))
        return self.roots()

    def _children(self, level: int, a: np.ndarray, b: np.ndarray, known: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of children within the radius, with the differences accumulated so far."""
        pattern, loose, first, _ = self.levels[level]
        below, below_loose = self.levels[level - 1][:2]
        of = np.repeat(np.arange(len(a)), counts)
        at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        width = (first[b + 1] - first[b])[of]
        i, j = first[a][of] + at // width, first[b][of] + at % width
        ordered = i < j if level == 1 else i <= j  # a node paired with itself gives each pair of children once
        i, j, of = i[ordered], j[ordered], of[ordered]
        fresh = ~(below_loose[i] | below_loose[j]) & (loose[a] | loose[b])[of]
        seen = known[of] + np.bitwise_count((below[i] ^ below[j]) & fresh)
        near = seen <= self.radius
        met = self.met.setdefault(level - 1, [0, 0])
        met[0], met[1] = met[0] + len(near), met[1] + int(near.sum())
        return i[near], j[near], seen[near]


def _pruned(node: np.ndarray, ids: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """Levels of the index with the pairs met and kept there; all pairs of a node's rows as level -1."""
    index = _Index(node, prints, radius)
    index.components()
    sizes = np.unique(node, return_counts=True)[1]
    rows = [(-1, int((sizes * (sizes - 1) // 2).sum()), 0), *((level, *met) for level, met in index.met.items())]
    return tuple(np.array(rows, np.int64).T)


def _hubs(node: np.ndarray, ids: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member of a node's component with the component's smallest id."""
    component = _Index(node, prints, radius).components()
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, component, ids)
    hub = smallest[component]
    return hub[hub != ids], ids[hub != ids]


def _search(batches: Iterator[pa.RecordBatch], radius: int, of: Callable[..., tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """What ``of`` finds in whole nodes; rows come sorted by node and Gray rank."""

    def found(node: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        columns = of(node, ids, ids.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    held: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "id"))
        if held is not None:
            parts = tuple(np.concatenate(x) for x in zip(held, parts))
        cut = int(np.searchsorted(parts[0], parts[0][-1]))  # the last node may go on in the next batch
        held = tuple(x[cut:] for x in parts)
        if cut:
            yield found(*(x[:cut] for x in parts))
    if held is not None:
        yield found(*held)


def name_bits(n: int, node_rows: int = NODE_ROWS) -> int:
    """Bits that deal ``n`` fingerprints to nodes of about ``node_rows``."""
    return max(0, (n // node_rows).bit_length() - 1)


def links(prints: DataFrame, radius: int = RADIUS, node_cap: int = NODE_CAP, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints ``prints(id)``, exact for the radius."""
    return _through_nodes(prints, radius, node_cap, node_rows, _hubs, ["a", "b"])


def pruning(prints: DataFrame, radius: int = RADIUS, node_cap: int = NODE_CAP, node_rows: int = NODE_ROWS) -> DataFrame:
    """``(level, met, kept)``: pairs that the search met and kept at each level, 0 being the fingerprints; level -1 holds all pairs of nodes."""
    rows = _through_nodes(prints, radius, node_cap, node_rows, _pruned, ["level", "met", "kept"])
    return rows.groupBy("level").agg(F.sum("met").alias("met"), F.sum("kept").alias("kept"))


def _through_nodes(prints: DataFrame, radius: int, node_cap: int, node_rows: int, of: Callable[..., tuple[np.ndarray, ...]], names: list[str]) -> DataFrame:
    """What ``of`` finds in every node, level by level."""
    found, schema = None, ", ".join(f"{n} long" for n in names)
    children, free = _pigeonholes(F.lit(0).cast("long"), F.col("id"), 64, radius + 1, name_bits(prints.count(), node_rows))
    while True:
        level = prints.select("id", F.explode(children).alias("child")).select("id", "child.node", "child.rest")
        hot = durable(level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_cap).select("node"))
        deeper = not hot.isEmpty() and free > 14
        here = level.join(hot, "node", "left_anti") if deeper else level
        pairs = here.select("node", "id").repartition("node").sortWithinPartitions("node", gray_rank(F.col("id"))).mapInArrow(lambda it: _search(it, radius, of, names), schema)
        found = pairs if found is None else found.unionByName(pairs)
        if not deeper:
            return found
        prints = level.join(hot, "node", "left_semi")
        children, free = _pigeonholes(F.col("node"), F.col("rest"), free, radius + 1)


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of all ends of ``edges(a, b)``; the root is a component's smallest id.

    Every round takes the smallest root among neighbours and then the root's root.
    Rounds end when nothing changes; each is cut off in the shared folder.
    """
    # Both directions of one row: a union would compute the edges twice.
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    ends = durable(edges.select(both.alias("end")).select("end.a", "end.b").distinct())
    roots = durable(ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).withColumn("root", F.least("id", "root")))
    while True:
        near = ends.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        hooked = roots.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        above = roots.select(F.col("id").alias("root"), F.col("root").alias("above"))
        jumped = stored(hooked.join(above, "root").select("id", "was", F.least("root", "above").alias("root")))
        roots = jumped.select("id", "root")
        if jumped.where("root < was").isEmpty():
            return roots


def component_roots(ids: DataFrame, radius: int = RADIUS, node_cap: int = NODE_CAP) -> DataFrame:
    """``(id, root)`` for every distinct fingerprint of durable ``ids(id)``."""
    distinct = durable(ids.select("id").distinct())
    roots = components(links(distinct, radius, node_cap))
    return distinct.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def op5(spark: SparkSession, sf_dir: str, node_cap: int = NODE_CAP) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = durable(documents(spark, sf_dir).select("doc_id", fingerprints(whole_text(), SHINGLE).alias("id")))
    roots = durable(component_roots(rows, RADIUS, node_cap))
    smallest = rows.groupBy("id").agg(F.min("doc_id").alias("least"))
    named = roots.join(smallest, "id").groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = roots.join(named, "root").select("id", "component_id")
    return rows.join(by_print, "id").select("doc_id", F.lpad(F.lower(F.hex("id")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = STAGE_SHINGLE, **blocks: int) -> DataFrame:
    """The documents with one of each group of near-duplicates, that of the smallest doc_id (null last).

    Near-duplicates have sets of ``shingle`` words with a Jaccard similarity of 0.8 or more:
    those that the index over fingerprints shows, verified, and then those that fingerprints
    miss. ``blocks`` are the sizes of blocks in a task, which change no result.
    """
    from .jaccard import set_facts, similar_roots

    keys = [F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text_key")]
    rows = packed(docs)
    trimmed = F.btrim(whole_text("row.text"), F.lit(SPACE_CHARS))
    texts = rows.select(F.xxhash64(trimmed).alias("id"), trimmed.alias("text"))
    # Sets are computed again where they are needed: stored they would be larger than the texts.
    narrow = durable(rows.select(*keys, F.xxhash64(trimmed).alias("id"), set_facts(trimmed, shingle).alias("set")))
    sizes = durable(narrow.groupBy("id").agg(F.first("set").alias("set")).select("id", "set.n", "set.print"))
    roots = similar_roots(texts, sizes, shingle, **blocks)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("kept")
    rooted = narrow.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # Within a struct nulls are equal. Its key is never null on either side: of one type, it deals rows once for join and window.
    at = F.struct("doc_id", "text_key").alias("at")
    never_null = F.coalesce("kept.text_key", F.lit(0).cast("long")).alias("text_key")
    kept = rooted.groupBy("root").agg(first).select(F.struct("kept.doc_id", never_null).alias("at"))
    stays = rows.select("row", *keys).select("row", at).join(kept, "at", "left_semi")
    # Repeated rows are copies too: one of them is left.
    one = F.row_number().over(Window.partitionBy("at").orderBy("at"))
    return stays.withColumn("one", one).where("one = 1").select("row.*")
