"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a text with up to ``k`` edits, a fixed share of its length. Cut into
k + 1 pieces, at least one of them occurs unchanged. An Aho-Corasick automaton over all
pieces reads every whole text once. A hit climbs a tree of pieces: a stretch of p pieces
may hold p - 1 edits, and if it holds no more, so does one of its halves. Each stretch is
verified by Myers' bit-parallel edit distance, so chance hits end at short stretches and
the whole item, with its k edits, is verified for few.

Texts and items are compared in lower case with runs of white space as one blank. Items
under ``SHORT`` characters have no budget and must stand as whole words: a few letters
with an edit or within words would be found everywhere.

The items travel to the executors in passes of at most about ``PASS_CHARS`` characters, one
pass after the other: each collects its items, reads the documents, stores what it finds
and leaves before the next begins. So one automaton is alive at a time and its size is
bounded whatever the benchmark holds. A benchmark of one pass is streamed without storing.

Defined cases: null and empty texts match nothing; null items and items of white space
match nothing; equal items are reported each; repeated documents are reported each; an
empty benchmark or no documents give no matches; other columns are kept; an item's id may be
null, a number or a string, and keeps its type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, packed, whole_text

ERROR_SHARE = 0.1
SHORT = 25
PASS_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def matches_type(items: DataFrame) -> str:
    """Type of the matches in a text; an item's id keeps the type it has."""
    return f"array<struct<item_id:{items.schema['item_id'].dataType.simpleString()},distance:int,places:int,first_end:int>>"


def budget(length: int) -> int:
    """Edits that an item of this length may have."""
    return int(length * ERROR_SHARE) if length >= SHORT else 0


def stands_alone(read: str, a: int, b: int) -> bool:
    """Whether no letter or digit touches ``read[a:b]``."""
    return not (a > 0 and read[a - 1].isalnum() and read[a].isalnum()) and not (b < len(read) and read[b].isalnum() and read[b - 1].isalnum())


def pieces(item: str) -> list[tuple[int, str]]:
    """Start and text of the ``budget + 1`` pieces of an item, of nearly equal length."""
    n = budget(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(mask: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Smallest edit distance between the item and any stretch of ``text``, and where the first such ends (Myers 1999)."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best, at = full, 0, length, length, 0
    for i, c in enumerate(text, 1):
        eq = mask.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best:
            best, at = score, i
    return best, at


def ladders(item: str) -> tuple[list[tuple[int, str]], list[list[tuple[int, int, dict[str, int], int]]]]:
    """Pieces of an item, and for each the stretches above it, smallest first: start, length, masks, edits allowed."""
    cut = pieces(item)
    above: list[list[tuple[int, int, dict[str, int], int]]] = [[] for _ in cut]

    def climb(a: int, b: int) -> None:
        if b - a < 2:
            return
        middle = (a + b) // 2
        climb(a, middle)
        climb(middle, b)
        start, end = cut[a][0], cut[b - 1][0] + len(cut[b - 1][1])
        step = (start, end - start, masks(item[start:end]), b - a - 1)
        for i in range(a, b):
            above[i].append(step)

    climb(0, len(cut))
    return cut, above


def holds(read: str, diagonal: int, steps: list[tuple[int, int, dict[str, int], int]]) -> bool:
    """Whether every stretch but the whole item occurs about the diagonal within its edits."""
    for start, length, mask, edits in steps[:-1]:
        a = diagonal + start - edits
        if least_distance(mask, length, read[max(0, a) : a + length + 2 * edits])[0] > edits:
            return False
    return True


def matcher(items: list[tuple[Any, str]]) -> Callable[[str | None], list[dict]]:
    """A function that lists the items which occur in a text."""
    import ahocorasick

    automaton, known = ahocorasick.Automaton(), []
    for item_id, text in items:
        for (start, piece), steps in zip(*ladders(text)):
            if piece not in automaton:
                automaton.add_word(piece, (len(piece), []))
            automaton.get(piece)[1].append((len(known), start, steps))
        known.append((item_id, text, masks(text)))
    if known:
        automaton.make_automaton()

    def match(text: str | None) -> list[dict]:
        read = normal(text)
        if not known or not read:
            return []
        diagonals: dict[int, set[int]] = {}
        for end, (size, owners) in automaton.iter(read):
            for item, start, steps in owners:
                if len(known[item][1]) < SHORT and not stands_alone(read, end + 1 - size, end + 1):
                    continue
                diagonal = end + 1 - size - start
                if diagonal not in diagonals.setdefault(item, set()) and holds(read, diagonal, steps):
                    diagonals[item].add(diagonal)
        out = []
        for item, found in sorted(diagonals.items()):
            item_id, pattern, mask = known[item]
            m, k = len(pattern), budget(len(pattern))
            best, places, first = k + 1, 0, 0
            for a, b in _stretches(sorted(found), m, k):
                if read.startswith(pattern, a + k):
                    distance, at = 0, k + m
                else:
                    distance, at = least_distance(mask, m, read[max(0, a) : b])
                    at += max(0, a) - a
                if distance <= k:
                    places += 1
                    first = first or a + at
                    best = min(best, distance)
            if places:
                out.append({"item_id": item_id, "distance": best, "places": places, "first_end": first})
        return out

    return match


def _stretches(diagonals: list[int], m: int, k: int) -> list[tuple[int, int]]:
    """Stretches of text to verify; hits whose stretches would overlap for the most part share one."""
    out: list[tuple[int, int]] = []
    for d in diagonals:
        a, b = d - k, d + m + k
        if out and a <= out[-1][0] + 2 * k:
            out[-1] = (out[-1][0], b)
        elif out and a < out[-1][1] - m // 2 and b - out[-1][0] <= 2 * m:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def passes(benchmark: DataFrame, pass_chars: int = PASS_CHARS) -> tuple[int, Iterator[list[tuple[Any, str]]]]:
    """The number of passes, and their items; a pass is collected when its turn comes."""
    items = benchmark.where(F.length(F.trim("text")) > 0).select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // pass_chars)

    def collected() -> Iterator[list[tuple[Any, str]]]:
        for i in range(n):
            part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
            yield [(r.item_id, t) for r in part.collect() if (t := normal(r.text))]

    return n, collected()


def matches(text: Column, items: list[tuple[Any, str]], spark: SparkSession, kind: str) -> Column:
    """Array of the items that occur in ``text``, with distance and places; ``kind`` is its type."""
    sent = spark.sparkContext.broadcast(items)

    @F.pandas_udf(kind)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = matcher(sent.value)
        for texts in batches:
            yield pd.Series([match(t) for t in texts], dtype=object)

    return found(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The documents in which no benchmark item occurs."""
    rows = packed(docs)
    n, each = passes(benchmark, pass_chars)
    for items in each:
        rows = rows.where(F.size(matches(whole_text("row.text"), items, docs.sparkSession, matches_type(benchmark))) == 0)
        rows = durable(rows) if n > 1 else rows
    return rows.select("row.*")


def contaminations(docs: DataFrame, benchmark: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance, places, first_end)``: every benchmark item in every document."""
    n, each = passes(benchmark, pass_chars)
    parts = []
    for items in each:
        found = docs.select("doc_id", F.explode(matches(whole_text(), items, docs.sparkSession, matches_type(benchmark))).alias("m")).select("doc_id", "m.item_id", "m.distance", "m.places", "m.first_end")
        parts.append(durable(found) if n > 1 else found)
    empty = docs.select("doc_id", F.explode(F.lit(None).cast(matches_type(benchmark))).alias("m")).select("doc_id", "m.*")
    return reduce(DataFrame.unionByName, parts) if parts else empty


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that occurs in it."""
    return contaminations(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
