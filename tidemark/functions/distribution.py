"""Order statistics that never put all rows into one task.

Without groups, a statistic is selected: one pass takes counts and approximate quantiles
that bracket each wanted rank, a second one sums the rows of the brackets by distinct value
and finds the ranks; under a thousandth of the rows lies in a bracket. The driver gets a
number a statistic, and plans built on them hold literals.

With groups, and where every value's rank is wanted, a sample is summed per distinct value,
values are dealt to ranges between approximate quantiles, as many as the values need, and
running sums are a range's offset plus a running sum within the range.

Defined cases: null values are left out; NaN counts as the largest value; no rows give
nulls (or no groups); ties are one value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import durable

#: Distinct values of a range in ``running``, in expectation, and ranges at most.
RANGE_VALUES, MOST_RANGES = 500_000, 1024
ACCURACY = 10_000


@dataclass(frozen=True)
class Wanted:
    """An order statistic of ``value`` where it is not null: 0-based ranks from the number of rows, and their mix."""

    value: Column
    share: Callable[[int], float]
    ranks: Callable[[int], tuple[int, int, float]]


def interpolated(value: Column, q: float) -> Wanted:
    """The linearly interpolated quantile."""

    def ranks(n: int) -> tuple[int, int, float]:
        place = (n - 1) * q
        return math.floor(place), math.ceil(place), place - math.floor(place)

    return Wanted(value, lambda n: q, ranks)


def at_rank(value: Column, rank: Callable[[int], int]) -> Wanted:
    """The value of a 1-based rank."""
    return Wanted(value, lambda n: rank(n) / n, lambda n: (rank(n) - 1, rank(n) - 1, 0.0))


def lower(value: Column, q: float) -> Wanted:
    """The smallest value whose share of rows reaches q."""
    return at_rank(value, lambda n: min(n, max(1, math.ceil(round(n * q, 9)))))


def select(rows: DataFrame, wanted: dict[str, Wanted], **extra: Column) -> dict[str, float]:
    """The wanted statistics, their numbers of rows as ``n_<name>``, and further aggregates of the rows."""
    values = {k: w.value.cast("double") for k, w in wanted.items()}
    counts = rows.agg(*[F.count(v).alias(f"n_{k}") for k, v in values.items()], *[c.alias(k) for k, c in extra.items()]).first().asDict()
    out = dict(counts)
    open_ = {k: w for k, w in wanted.items() if counts[f"n_{k}"]}
    out |= {k: None for k in wanted if k not in open_}
    if not open_:
        return out
    # Brackets: the share with twice the sketch's error and two rows to each side.
    ends = {}
    for k, w in open_.items():
        n = counts[f"n_{k}"]
        slack = 2 / ACCURACY + 3 / n
        ends[k] = [min(1.0, max(0.0, w.share(n) + d)) for d in (-slack, slack)]
    cuts = rows.agg(*[F.percentile_approx(values[k], e, ACCURACY).alias(k) for k, e in ends.items()]).first()
    names = list(open_)
    entries = []
    for i, k in enumerate(names):
        v, (low, high) = values[k], cuts[k]
        low = -math.inf if ends[k][0] == 0.0 else low
        high = math.nan if ends[k][1] == 1.0 else high  # NaN is the largest value
        entries.append(F.when(v.isNotNull() & (v <= F.lit(high)), F.struct(F.lit(i).alias("i"), F.when(v >= F.lit(low), v).alias("v"))))
    kept = F.filter(F.array(*entries), lambda x: x.isNotNull())
    summed = rows.select(F.explode(kept).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
    seen = summed.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy(F.col("v").asc_nulls_first())))
    ranks = {k: w.ranks(counts[f"n_{k}"]) for k, w in open_.items()}
    at = F.array(*[F.struct(F.lit(ranks[k][0]).alias("a"), F.lit(ranks[k][1]).alias("b")) for k in names])
    found = seen.groupBy("i").agg(*[F.min(F.when(F.col("upto") > F.get(at, F.col("i"))[x], F.col("v"))).alias(x) for x in "ab"]).collect()
    for r in found:
        k = names[r["i"]]
        part = ranks[k][2]
        out[k] = r["a"] if not part else r["a"] + (r["b"] - r["a"]) * part
    return out


def one_row_of(rows: DataFrame, values: dict[str, float | int | None], kinds: dict[str, str] | None = None) -> DataFrame:
    """A frame of one row of literals."""
    kinds = kinds or {}
    return rows.sparkSession.sql("SELECT 1").select(*[F.lit(v).cast(kinds.get(k, "double")).alias(k) for k, v in values.items()])


def number(rows: DataFrame, value: Column, n: int) -> float:
    """A column expression over the number of rows ``n``, as a number."""
    return rows.sparkSession.sql(f"SELECT {n}L AS n").select(value.alias("x")).first()["x"]


def distribution(rows: DataFrame, value: str | Column, weight: str | Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., v, n, w)``: rows and weight at each distinct value; null values are left out."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    return rows.select(*by, v.cast("double").alias("v"), w.cast("double").alias("w")).where("v IS NOT NULL").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


def cuts_of(rows: DataFrame, order: str) -> list[float]:
    """Approximate quantiles that cut the rows into ranges of about ``RANGE_VALUES``; none for few rows."""
    n = rows.count()
    ranges = min(MOST_RANGES, -(-n // RANGE_VALUES))
    if ranges < 2:
        return []
    return sorted(set(rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], ACCURACY).alias("c")).first()["c"]))


def in_range(cuts: list[float], value: Column) -> Column:
    """Number of cuts below a value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)


def running(rows: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<s>`` (up to and with the row) and ``all_<s>`` for rows of distinct ``order`` within ``by``."""
    rows = durable(rows)
    dealt = rows.withColumn("_range", in_range(cuts_of(rows, order), F.col(order)))
    per_range = dealt.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(group).alias(f"all_{s}") for s in sums],
    )
    within = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    joined = dealt.join(offsets, same)
    return joined.withColumns({f"cum_{s}": F.sum(s).over(within) + F.col(f"_o_{s}") for s in sums}).drop("_range", "_r", *[f"_b{i}" for i in range(len(by))], *[f"_o_{s}" for s in sums])


def quantiles(rows: DataFrame, value: str | Column, qs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, one column per name of ``qs``."""
    if not by:
        v = F.col(value) if isinstance(value, str) else value
        found = select(rows, {k: interpolated(v, q) for k, q in qs.items()})
        return one_row_of(rows, {k: found[k] for k in qs})
    seen = running(distribution(rows, value, by=by), "v", ["n"], by)
    parts = []
    for name, q in qs.items():
        place = (F.col("all_n") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            parts.append(F.min(F.when(F.col("cum_n") > at, F.col("v"))).alias(f"{name}_{side}"))
    found = seen.groupBy(*by).agg(F.max("all_n").alias("_n"), *parts)
    out = []
    for name, q in qs.items():
        place = (F.col("_n") - 1) * F.lit(float(q))
        out.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (place - F.floor(place))).alias(name))
    return found.select(*by, *out)


def lower_quantiles(rows: DataFrame, value: str | Column, qs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The smallest value whose share of rows reaches q; for 0.5 the lower of two middle values."""
    if not by:
        v = F.col(value) if isinstance(value, str) else value
        found = select(rows, {k: lower(v, q) for k, q in qs.items()})
        return one_row_of(rows, {k: found[k] for k in qs})
    seen = running(distribution(rows, value, by=by), "v", ["n"], by)
    return seen.groupBy(*by).agg(*[F.min(F.when(F.col("cum_n") >= F.col("all_n") * F.lit(float(q)), F.col("v"))).alias(k) for k, q in qs.items()])


def order_statistic(rows: DataFrame, value: str | Column, rank: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The value of a 1-based rank that may depend on ``n``, the number of rows."""
    if not by:
        v = F.col(value) if isinstance(value, str) else value
        rows = rows.select(v.alias("_v"))
        found = select(rows, {name: at_rank(F.col("_v"), lambda n: int(number(rows, rank, n)))})
        return one_row_of(rows, {name: found[name], "n": found[f"n_{name}"]}, {"n": "long"})
    seen = running(distribution(rows, value, by=by), "v", ["n"], by).withColumnsRenamed({"n": "here", "all_n": "n"})
    return seen.groupBy(*by).agg(F.min(F.when(F.col("cum_n") >= rank, F.col("v"))).alias(name), F.max("n").alias("n"))


def weighted_select(rows: DataFrame, value: Column, weight: Column, level: Callable[[int], float], **extra: Column) -> dict[str, float]:
    """``threshold``: the first value whose share of weight reaches the level, else the last; with ``n``, ``weight`` and further aggregates.

    One pass for sums and cuts, one for the weight between cuts, one within the range where the level is reached.
    """
    cuts_wanted = F.percentile_approx(value.cast("double"), [i / 256 for i in range(1, 256)], ACCURACY)
    kept = rows.where(value.isNotNull())
    w = F.greatest(weight, F.lit(1e-12))
    first = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight"), F.max(value).alias("last"), cuts_wanted.alias("cuts"), *[c.alias(k) for k, c in extra.items()]).first().asDict()
    n, total, cuts = first["n"], first["weight"], sorted(set(first.pop("cuts") or []))
    last = first.pop("last")
    first["threshold"] = None
    if not n:
        return first
    goal = level(n)
    where = in_range(cuts, value) if n > 256 else F.lit(0)
    before, target = 0.0, 0
    if n > 256:
        for r in kept.groupBy(where.alias("r")).agg(F.sum(w).alias("w")).orderBy("r").collect():
            target = r["r"]
            if (before + r["w"]) / total >= goal - 1e-9:
                break
            before += r["w"]
    # A range more on each side: sums in another order may differ in the last digits.
    near = kept.select(value.alias("v"), w.alias("w"), where.alias("r"))
    low = near.where(F.col("r") < target).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()["w"] if target else 0.0
    values = near.where(F.col("r").isin(target, target + 1)).groupBy("v").agg(F.sum("w").alias("w"))
    cum = (F.sum("w").over(Window.orderBy("v")) + F.lit(low)) / F.lit(total)
    hit = values.withColumn("f", cum).where(F.col("f") >= F.lit(goal)).agg(F.min("v").alias("v")).first()["v"]
    first["threshold"] = last if hit is None else hit
    return first


def weighted_quantile(rows: DataFrame, value: str | Column, weight: str | Column, level: Column, name: str = "threshold", by: Sequence[str] = ()) -> DataFrame:
    """First value whose share of weight reaches ``level`` (of ``n`` rows), else the last; weights count 1e-12 at least."""
    w = F.col(weight) if isinstance(weight, str) else weight
    v = F.col(value) if isinstance(value, str) else value
    if not by:
        found = weighted_select(rows, v, w, lambda n: number(rows, level, n))
        return one_row_of(rows, {name: found["threshold"], "n": found["n"], "weight": found["weight"]}, {"n": "long"})
    seen = running(distribution(rows, value, F.greatest(w, F.lit(1e-12)), by), "v", ["n", "w"], by).withColumnsRenamed({"n": "here", "all_n": "n"})
    hit = F.min(F.when(F.col("cum_w") / F.col("all_w") >= level, F.col("v")))
    return seen.groupBy(*by).agg(F.coalesce(hit, F.max("v")).alias(name), F.max("n").alias("n"), F.max("all_w").alias("weight"))


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add the rank of ``value``; ties share their mean rank."""
    ranks = running(distribution(rows, value), "v", ["n"]).select(F.col("v").alias("_v"), (F.col("cum_n") - (F.col("n") - 1) / 2).alias(name))
    return rows.join(ranks, F.col(value).cast("double") == F.col("_v"), "left").drop("_v")


def ecdf_gap(a: DataFrame, b: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Union grid ``(v, fa, fb)`` of both distribution functions; ``a`` may be weighted."""
    both = distribution(a, value, weight).select("v", F.col("w").alias("wa"), F.lit(0.0).alias("wb")).unionAll(distribution(b, value).select("v", F.lit(0.0), F.col("w")))
    grid = both.groupBy("v").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    seen = running(grid, "v", ["wa", "wb"])
    return seen.select("v", (F.col("cum_wa") / F.col("all_wa")).alias("fa"), (F.col("cum_wb") / F.col("all_wb")).alias("fb"))


def wasserstein(a: DataFrame, b: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """One row ``w1``: the area between the two distribution functions.

    The gap to the next value is a range's own within it, and across ranges the next range's least value.
    """
    grid = durable(ecdf_gap(a, b, value, weight))
    dealt = grid.withColumn("range", in_range(cuts_of(grid, "v"), F.col("v")))
    firsts = dealt.groupBy("range").agg(F.min("v").alias("first"))
    nexts = firsts.select("range", F.lead("first").over(Window.orderBy("range")).alias("next_first"))
    nxt = F.coalesce(F.lead("v").over(Window.partitionBy("range").orderBy("v")), F.col("next_first"))
    return dealt.join(nexts, "range").withColumn("gap", nxt - F.col("v")).agg(F.sum(F.col("gap") * F.abs(F.col("fa") - F.col("fb"))).alias("w1"))
