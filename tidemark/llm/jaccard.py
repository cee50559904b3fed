"""Exact groups of texts whose shingle sets have a Jaccard similarity of 0.8 or more.

Fingerprints. Each set has a SimHash fingerprint (a shingle counts once), and the Gray-order
index of ``simhash.py`` links fingerprints within its radius. Their components are the first
candidate groups; they are verified, and the verified links make classes.

The rest. Sets of similarity 0.8 may differ in more bits than any radius allows, so an exact
search follows for links between different classes; what fingerprints settled is neither
proposed nor compared again.

A set has a similar one only if others hold 0.8 of its shingles. To tell, all shingles go
out packed: cut to as many low bits as keep nearly all apart, dealt to parts by the highest
of these, sorted and laid out byte by byte, with a text's place in its batch instead of its
id. A part counts for each place the shingles that occur there more than once. Bits that
agree by chance and copies of a text only make a count too high, so no pair is lost; the
sets that reach 0.8 go on. All shingles of these are ordered by the number of sets that hold
them, rarest first.
Two sets of similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each,
whatever the order is; so sets that share none of these are never compared, and no pair is
lost. A shingle that a single set holds joins nothing and is dropped when shingles are
counted. Classes that share a shingle are linked to the smallest one, a row a class, and
the sets of connected classes make a candidate group. A shingle within one class proposes
nothing.

Verification. Each pair of a candidate group is compared by its shingles, or is in one
class or component already by pairs that were. A group above a block's size is cut into blocks by a
hash of the id and each pair of blocks goes to a task of its own; so a task's memory is
bounded and the size of blocks changes no result.

Defined cases: texts without words have the empty set and fingerprint zero; they come
trimmed, so they are one text; texts with equal sets are similar; texts of any length are
read whole; no rows give no groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .simhash import component_roots, components, majority, shingle_hashes

#: Sets and shingles of a block in a task, in expectation.
BLOCK_SETS = 1024
BLOCK_SHINGLES = 1 << 21
#: Rows of a batch that a worker sends.
SENT_ROWS = 1 << 17
#: Shingles that a worker packs at once (and at most so many texts, as places are two bytes), and those of a part in expectation.
PACKED_ROWS = 1 << 21
PACKED_TEXTS = 1 << 16
PART_ROWS = 1 << 18
#: Bits of a shingle beyond those that count all of them: one in 16 to 32 agrees with another by chance.
SPARE_BITS = 4
#: Most bits of a sieve, which is broadcast: 2 MB.
SIEVE_BITS = 24


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles' hashes in ascending order, as signed longs; empty without words."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def shingle_sets(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle) for t in texts], dtype=object)

    return sets(text)


def set_facts(text: Column, shingle: int) -> Column:
    """Number of distinct shingles ``n`` and their fingerprint ``print`` as a signed long; the sets themselves stay in the worker."""

    @F.pandas_udf("n long, print long")
    def facts(texts: pd.Series) -> pd.DataFrame:
        n, prints = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64)
        for i, text in enumerate(texts):
            own = shingle_set(text, shingle)
            n[i], prints[i] = len(own), majority(own.view(np.uint64))
        return pd.DataFrame({"n": n, "print": prints.view(np.int64)})

    return facts(text)


def shingle_rows(texts: DataFrame, shingle: int) -> DataFrame:
    """``(s, id)``: a row per text and distinct shingle, sent in batches of about ``SENT_ROWS`` rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(sets: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
            each = np.repeat(np.array(ids, np.int64), [len(x) for x in sets])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(each)], ["s", "id"])

        for batch in batches:
            sets, ids, held = [], [], 0
            for who, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                sets.append(shingle_set(text.as_py(), shingle))
                ids.append(who)
                held += len(sets[-1])
                if held >= SENT_ROWS:
                    yield sent(sets, ids)
                    sets, ids, held = [], [], 0
            if sets:
                yield sent(sets, ids)

    return texts.select("id", "text").mapInArrow(rows, "s long, id long")


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers: all first bytes, then all second ones; sorted numbers compress well so."""
    return values.view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes()


def _unplaned(raw: bytes, width: int) -> np.ndarray:
    """The numbers that ``_planes`` laid out, as unsigned longs."""
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def _pack(batches: Iterator[pa.RecordBatch], shingle: int, bits: int, part_bits: int, packed_rows: int) -> Iterator[pa.RecordBatch]:
    """Shingles of texts by part; a batch's ids go out once, with any part."""
    low = bits - part_bits
    width = -(-low // 8)
    number = TaskContext.get().partitionId() << 32

    def packed(sets: list[np.ndarray], ids: list[int], batch: int) -> pa.RecordBatch:
        word = np.concatenate(sets).view(np.uint64) & np.uint64((1 << bits) - 1)
        order = np.argsort(word)
        word, place = word[order], np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sets])[order]
        part = (word >> np.uint64(low)).astype(np.int64)
        word &= np.uint64((1 << low) - 1)
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
        spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(part)]))
        columns = [
            pa.array([batch % (1 << part_bits), *part[begin].tolist()], pa.int64()),
            pa.array([batch] * (1 + len(spans)), pa.int64()),
            pa.array([np.array(ids, np.int64).tobytes(), *[None] * len(spans)], pa.binary()),
            pa.array([None, *(_planes(word[x:y], width) for x, y in spans)], pa.binary()),
            pa.array([None, *(_planes(place[x:y], 2) for x, y in spans)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["part", "batch", "ids", "words", "places"])

    sets, ids, held = [], [], 0
    for batch in batches:
        for who, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            sets.append(shingle_set(text.as_py(), shingle))
            ids.append(who)
            held += len(sets[-1])
            if held >= packed_rows or len(sets) == PACKED_TEXTS:
                yield packed(sets, ids, number)
                sets, ids, held, number = [], [], 0, number + 1
    if sets:
        yield packed(sets, ids, number)


def _counted(batches: Iterator[pa.RecordBatch], low: int) -> Iterator[pa.RecordBatch]:
    """A row for each batch of texts with its places and how many of their shingles a part met more than once; ids pass through."""
    width = -(-low // 8)

    def found(part: pa.Array, batch: pa.Array, ids: pa.Array, words: pa.Array, places: pa.Array) -> pa.RecordBatch:
        part, batch = (x.to_numpy(zero_copy_only=False) for x in (part, batch))
        named, data = (np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) for x in (ids, words))
        # A batch's place as one number.
        numbers, seat = np.unique(batch, return_inverse=True)
        keys = [np.empty(0, np.int64)]
        for rows in np.split(data, np.flatnonzero(part[data][1:] != part[data][:-1]) + 1):
            if not len(rows):
                continue
            at = np.concatenate([_unplaned(places[k].as_py(), 2).view(np.int64) + (int(seat[k]) << 16) for k in rows.tolist()])
            word = np.concatenate([_unplaned(words[k].as_py(), width) for k in rows.tolist()])
            order = np.argsort(word)
            same = word[order][1:] == word[order][:-1]
            keys.append(at[order[np.append(same, False) | np.append(False, same)]])
        key, held = np.unique(np.concatenate(keys), return_counts=True)
        cuts = np.searchsorted(key, np.arange(len(numbers) + 1) << 16).tolist()
        spans = [(n, x, y) for n, x, y in zip(numbers.tolist(), cuts, cuts[1:]) if x < y]
        columns = [
            pa.array([*batch[named].tolist(), *(n for n, _, _ in spans)], pa.int64()),
            pa.array([*(ids[k].as_py() for k in named.tolist()), *[None] * len(spans)], pa.binary()),
            pa.array([*[None] * len(named), *(_planes(key[x:y], 2) for _, x, y in spans)], pa.binary()),
            pa.array([*[None] * len(named), *(_planes(held[x:y], 4) for _, x, y in spans)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["batch", "ids", "places", "held"])

    return _runs(batches, lambda b: [b.column(c) for c in ("part", "batch", "ids", "words", "places")], found)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, held)`` for each text of a batch, from the counts of all parts."""

    def found(batch: pa.Array, ids: pa.Array, places: pa.Array, held: pa.Array) -> pa.RecordBatch:
        batch, named = batch.to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
        own, sums = [], []
        for rows in np.split(np.arange(len(batch)), np.flatnonzero(batch[1:] != batch[:-1]) + 1):
            (name,) = rows[named[rows]].tolist()
            own.append(np.frombuffer(ids[name].as_py(), np.int64))
            sums.append(np.zeros(len(own[-1]), np.int64))
            for k in rows[~named[rows]].tolist():
                sums[-1][_unplaned(places[k].as_py(), 2).view(np.int64)] += _unplaned(held[k].as_py(), 4).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (own, sums)], ["id", "held"])

    return _runs(batches, lambda b: [b.column(c) for c in ("batch", "ids", "places", "held")], found)


def promising(texts: DataFrame, sizes: DataFrame, shingle: int, packed_rows: int = PACKED_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of ``sizes`` of which other sets may hold 0.8 of the shingles: all of which they do, and few others."""
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(63, total.bit_length() + SPARE_BITS)
    part_bits = min(bits - 1, (total // part_rows).bit_length())
    packed = texts.select("id", "text").mapInArrow(lambda it: _pack(it, shingle, bits, part_bits, packed_rows), "part long, batch long, ids binary, words binary, places binary")
    counted = packed.repartition("part").sortWithinPartitions("part").mapInArrow(lambda it: _counted(it, bits - part_bits), "batch long, ids binary, places binary, held binary")
    totals = counted.repartition("batch").sortWithinPartitions("batch").mapInArrow(_totals, "id long, held long")
    held = totals.groupBy("id").agg(F.max("held").alias("held"))  # copies of a text have a total each
    return sizes.join(held, "id").where("n > 0 AND 5 * held >= 4 * n").drop("held")


def sieved(rows: DataFrame, ids: DataFrame, most: int = SIEVE_BITS) -> DataFrame:
    """The rows whose ``id``, a hash, may be among durable ``ids(id)``: all that are, and few others; rows are not shuffled."""
    bits = min(most, max(6, ids.count().bit_length() + 6))
    word, bit = F.expr(f"shiftright(id & {(1 << bits) - 1}L, 6)"), F.expr("shiftleft(1L, CAST(id & 63L AS INT))")
    words = ids.select(word.alias("sieve_word"), bit.alias("bit")).groupBy("sieve_word").agg(F.bit_or("bit").alias("sieve_bits"))
    return rows.withColumn("sieve_word", word).join(F.broadcast(words), "sieve_word").where(F.col("sieve_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def similar(common: int, a: int, b: int) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers."""
    return 9 * common >= 4 * (a + b)


def prefix_length(n):
    """How many of a set's first shingles hold one of any set of similarity 0.8 (numbers, arrays and columns)."""
    return n - (4 * n + 4) // 5 + 1


def _runs(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], list], found: Callable[..., pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``found`` of the columns of whole runs of the first one, in which rows are sorted."""
    held: list[pa.Array] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = columns(batch)
        key = parts[0].to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
        held = held or [[] for _ in parts]
        if cut or (held[0] and held[0][-1][0].as_py() != key[0]):
            yield found(*(pa.concat_arrays([*h, p.slice(0, cut)]) for h, p in zip(held, parts)))
            held = [[] for _ in parts]
        for h, p in zip(held, parts):
            h.append(p.slice(cut))
    if held is not None:
        yield found(*(pa.concat_arrays(h) for h in held))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that more than one set holds, with the number of sets; rows come sorted by shingle and id."""

    def found(shingle: pa.Array, ids: pa.Array) -> pa.RecordBatch:
        s, i = (x.to_numpy(zero_copy_only=False) for x in (shingle, ids))
        once = np.append(True, (s[1:] != s[:-1]) | (i[1:] != i[:-1]))  # copies of a text repeat its shingles
        s, ids = s[once], pa.array(i[once])
        sizes = np.diff(np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s)))
        sizes = np.repeat(sizes, sizes)
        many = np.flatnonzero(sizes > 1)
        return pa.RecordBatch.from_arrays([pa.array(s[many]), ids.take(pa.array(many)), pa.array(sizes[many])], ["s", "id", "sets"])

    return _runs(batches, lambda b: [b.column("s"), b.column("id")], found)


def group_links(ids: np.ndarray, own: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each member of a component of similar sets with the component's smallest id, by exact comparison.

    Sets of one class ``own`` are known to be in one component.
    """
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(lengths, kind="stable")
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    starts = np.cumsum(lengths) - lengths
    label = np.unique(own, return_inverse=True)[1]
    holders: dict[int, list[int]] = {}
    for i in order.tolist():
        n = lengths[i]
        held = token[starts[i] : starts[i] + n]
        held = held[count[held] > 1] if n else held
        first = held[np.lexsort((held, count[held]))][: max(0, prefix_length(n) - (n - len(held)))].tolist()
        near = [holders[t] for t in first if t in holders]
        near = np.unique(np.concatenate([np.asarray(x) for x in near])) if near else np.empty(0, np.int64)
        near = near[5 * lengths[near] >= 4 * n]
        while len(near := near[label[near] != label[i]]):
            j, near = near[-1], near[:-1]
            if similar(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), n, lengths[j]):
                label[label == label[j]] = label[i]
        for t in first:
            holders.setdefault(t, []).append(i)
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, ids)
    hub = smallest[label]
    return hub[hub != ids], ids[hub != ids]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every task's group; rows come sorted by task."""

    def found(task: pa.Array, ids: pa.Array, own: pa.Array, shingles: pa.Array) -> pa.RecordBatch:
        key, who, own = (x.to_numpy(zero_copy_only=False) for x in (task, ids, own))
        values, ends = shingles.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(shingles.value_lengths()))
        sets = np.split(values, ends[:-1])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist()
        for x, y in zip(begin, [*begin[1:], len(key)]):
            hub, other = group_links(who[x:y], own[x:y], sets[x:y])
            a.append(hub)
            b.append(other)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z), pa.int64()) for z in (a, b)], ["a", "b"])

    return _runs(batches, lambda b: [b.column(c) for c in ("task", "id", "own", "shingles")], found)


def fingerprint_groups(sizes: DataFrame) -> DataFrame:
    """``(id, root, own)`` of the sets whose fingerprints share a component with those of others; each is a class of its own."""
    prints = component_roots(sizes.select(F.col("print").alias("id"))).select(F.col("id").alias("print"), "root")
    named = durable(sizes.join(prints, "print").select("id", "root", F.col("id").alias("own")))
    many = named.groupBy("root").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("root")
    return durable(named.join(many, "root", "left_semi"))


def candidates(texts: DataFrame, sizes: DataFrame, shingle: int) -> DataFrame:
    """Links ``(a, b)`` between classes that connect all sets of similarity 0.8 in different ones, and others; durable ``sizes(id, n, own)``."""
    sizes = durable(promising(texts, sizes, shingle))
    shared = shingle_rows(sieved(texts, sizes), shingle).repartition("s").sortWithinPartitions("s", "id").mapInArrow(_shared, "s long, id long, sets long")
    # What a set holds alone comes first in the order.
    ranked = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sets", "s"))).alias("ranked"))
    length = F.expr("CAST(n - (4 * n + 4) div 5 + 1 - (n - size(ranked)) AS INT)")
    first = ranked.join(sizes, "id").withColumn("length", length).where("length > 0")
    first = durable(first.select("own", F.explode(F.expr("slice(ranked, 1, length)")).alias("x")).select("own", F.col("x.s").alias("s")))
    hubs = first.groupBy("s").agg(F.min("own").alias("a"))
    return first.join(hubs, "s").where("a <> own").select("a", F.col("own").alias("b")).distinct()


def verified(texts: DataFrame, sizes: DataFrame, shingle: int, groups: DataFrame, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links ``(a, b)`` between similar sets of one group of durable ``groups(id, root, own)``; sets of a class ``own`` are linked already."""
    sized = groups.join(sizes, "id")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block_sets, F.sum("n") / block_shingles)).cast("int")
    blocks = sized.groupBy("root").agg(blocks.alias("blocks"))
    placed = groups.join(blocks, "root").withColumn("x", F.expr("CAST(pmod(xxhash64(id, 1), blocks) AS INT)"))
    others = F.expr("IF(blocks = 1, array(0), array_remove(sequence(0, blocks - 1), x))")
    tasks = placed.withColumn("y", F.explode(others)).select("id", "own", F.xxhash64("root", F.least("x", "y"), F.greatest("x", "y")).alias("task"))
    # Only texts of a candidate group are read again.
    sets = sieved(texts, groups).dropDuplicates(["id"]).select("id", shingle_sets(F.col("text"), shingle).alias("shingles"))
    return tasks.join(sets, "id").select("task", "id", "own", "shingles").repartition("task").sortWithinPartitions("task").mapInArrow(_verified, "a long, b long")


def similar_roots(texts: DataFrame, sizes: DataFrame, shingle: int, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``(id, root)`` of the sets that are similar to another.

    ``texts(id, text)`` may repeat an id with its text; durable ``sizes(id, n, print)`` has
    every id once, with its number of shingles and its fingerprint.
    """
    blocks = block_sets, block_shingles
    known = durable(verified(texts, sizes, shingle, fingerprint_groups(sizes), *blocks).distinct())
    named = durable(sizes.join(components(known), "id", "left").select("id", "n", F.coalesce("root", "id").alias("own")))
    groups = components(candidates(texts, named, shingle)).select(F.col("id").alias("own"), "root")
    rest = verified(texts, sizes, shingle, durable(named.join(groups, "own").select("id", "root", "own")), *blocks)
    return components(known.union(rest))
