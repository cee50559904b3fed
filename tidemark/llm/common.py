"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import durable, shared_folder, stored  # noqa: F401  for the operators

#: ASCII white space as one Java character class and as a plain trim set.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(text: str | Column = "text") -> Column:
    """Number of maximal runs of characters other than ASCII white space, as long."""
    trimmed = F.btrim(whole_text(text), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_CLASS + "+"))).cast("long")


def packed(docs: DataFrame, row: str = "row") -> DataFrame:
    """The whole input row in one struct, so that no column name can clash with a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias(row))


def unpacked(row: str, columns: list[str], new: list[str]) -> list[Column]:
    """The packed row's columns but those whose names ``new`` takes."""
    taken = {c.lower() for c in new}
    return [F.col(f"{row}.`{c.replace('`', '``')}`").alias(c) for c in columns if c.lower() not in taken]


# Linear work on arrays within a row


def record(**fields: Column) -> Column:
    """A struct whose names hold within lambdas, where aliases of constants are lost."""
    return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


#: Elements of a block; a fold reads the blocks before and then its own block.
_BLOCK = 64


def folded(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element the fold of all elements before it; ``step`` is associative and ``zero`` its neutral value.

    Appending to an array copies it, so one pass that appends every element takes quadratic
    time. Here only blocks are appended, and an element folds what stands before it in its
    block: n x 64 steps.
    """

    def by_block(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, step))
        start = record(at=zero, out=F.slice(F.array(zero), 1, 0))
        before = F.aggregate(sums, start, lambda acc, x: record(at=step(acc["at"], x), out=F.concat(acc["out"], F.array(acc["at"]))), lambda acc: acc["out"])
        return let(before, lambda at: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x, i: F.aggregate(F.slice(b, F.lit(1), i), F.get(at, k), step)))))

    def cut(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.floor(F.size(v) / _BLOCK).cast("int")), lambda k: k * _BLOCK < F.size(v))
        return let(F.transform(starts, lambda k: F.slice(v, k * _BLOCK + 1, F.lit(_BLOCK))), by_block)

    return let(values, cut)


def summed_before(values: Column) -> Column:
    """For each number the sum of those before it."""
    return folded(values, F.lit(0), lambda a, b: a + b)


def largest_before(values: Column, least: int = -1) -> Column:
    """For each number the largest of those before it, at least ``least``."""
    return folded(values, F.lit(least), lambda a, b: F.greatest(a, b))


def distinct_sorted(items: Column) -> Column:
    """The items in order, each once. ``array_distinct`` compares all pairs of structs."""
    return let(F.array_sort(items), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))


def runs(items: Column) -> Column:
    """Sorted items with ``start`` and ``end`` as an array of runs; items of different runs don't overlap."""

    def parts(s: Column) -> Column:
        reach = largest_before(F.transform(s, lambda x: x["end"]))
        firsts = let(reach, lambda far: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["start"] >= F.get(far, i)))
        return let(firsts, lambda f: F.transform(f, lambda a, k: F.slice(s, a + 1, F.coalesce(F.get(f, k + 1), F.size(s)) - a)))

    return let(items, lambda s: F.when(F.size(s) > 0, parts(s)).otherwise(F.slice(F.array(s), 1, 0)))


def best_apart(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items in ascending order of ``key``, each kept if it overlaps none that was kept before it.

    ``items`` are sorted by start. Runs that don't touch each other are resolved apart.
    """

    def resolve(run: Column) -> Column:
        def step(kept: Column, x: Column) -> Column:
            return F.when(F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(x)))

        ordered = F.transform(F.array_sort(F.transform(run, lambda x: record(key=key(x), x=x))), lambda r: r["x"])
        return F.when(F.size(run) == 1, run).otherwise(F.aggregate(ordered, F.slice(run, 1, 0), step))

    return F.array_sort(F.flatten(F.transform(runs(items), resolve)))


def clear_of(items: Column, kept: Column) -> Column:
    """The items that overlap none of ``kept``; both have ``start`` and ``end`` and no item is empty."""

    def marked(x: Column, own: bool) -> Column:
        return record(start=x["start"], own=F.lit(own), end=x["end"], item=x)

    def check(both: Column) -> Column:
        left = largest_before(F.transform(both, lambda x: F.when(x["own"], F.lit(-1)).otherwise(x["end"])))
        right = F.reverse(largest_before(F.reverse(F.transform(both, lambda x: F.when(x["own"], F.lit(-(1 << 31) + 1)).otherwise(-x["start"]))), -(1 << 31) + 1))
        clear = lambda a, b: F.filter(both, lambda x, i: x["own"] & (F.get(a, i) <= x["start"]) & (-F.get(b, i) >= x["end"]))
        return F.transform(let(F.struct(left.alias("l"), right.alias("r")), lambda s: clear(s["l"], s["r"])), lambda x: x["item"])

    # Both sides get one shape: what is kept is carried as its span only.
    both = F.concat(F.transform(items, lambda x: marked(x, True)), F.transform(kept, lambda k: record(start=k["start"], own=F.lit(False), end=k["end"], item=F.get(F.slice(items, 1, 0), 0))))
    return F.when((F.size(items) == 0) | (F.size(kept) == 0), items).otherwise(let(F.array_sort(both), check))
