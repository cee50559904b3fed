"""Merkle manifest of a table: a trie over exact ranks, with a proof for every row.

Rows become leaves (SHA-256 of their fields), ordered by id within groups. Ranks come without
a global sort. A histogram counts rows by group and leading digits of the id, as many digits
as the number of rows asks for; added up digit by digit, with at most 256 siblings a parent,
it gives the number of rows in front of each cell, and a row's rank is that plus its place in
the cell. Cells that hold too many rows are dealt again by further digits, then by digits of
the leaf and of the row's number, so that neither clustered nor repeated ids end up in one task.

The digits of a rank in base ``FANOUT`` are the path of a leaf in the trie: nodes that share
all digits but the last are the children of one node, and every level is one grouping by that
prefix, an eighth of the level below. The groups' roots are the leaves of a last trie of the
same make. Proofs go down again: a node's steps are its own siblings and the steps of its
parent, joined by group and place, and only the last join has as many rows as an eighth of
the table. No key is hot, as every key holds a place in a level.

Defined cases: a null field is ``-``; a null id comes first among its group and its row is
never taken for tampered; a null group is a group of its own, the first; rows of one id are
ordered by their leaves, and equal rows are interchangeable; a lone leaf is its group's root
and a lone group's root is the root; texts of any length are hashed whole where they are
read; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, documents, durable

FANOUT = 8
#: Rows that one window ranks, at most, and hexadecimal digits of a level of the histogram.
MOST, DIGITS = 1 << 15, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**fields: Column) -> Column:
    return sha(*[encoded(c) for c in fields.values()])


def digits(value: Column, kind: str) -> Column:
    """Characters in whose order values stand as in their own; null comes first, and no two values are one."""
    if kind in ("bigint", "int", "smallint", "tinyint"):
        text = F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        text = F.concat(F.hex(value.cast("string").cast("binary")), F.lit(" "))
    return F.coalesce(F.concat(F.lit("1"), text), F.lit("0"))


# Ranks


def common_beginning(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def cell_starts(cells: DataFrame, top: int, bottom: int) -> DataFrame:
    """Per cell ``(g, base, p, n)`` the number of rows in front of it, as ``start``; digits are added up level by level."""
    out = cells.withColumn("start", F.col("base"))
    for depth in range(bottom, top, -DIGITS):
        prefix = F.substring("p", 1, depth)
        level = cells.groupBy("g", "base", prefix.alias("q")).agg(F.sum("n").alias("n")).withColumn("parent", F.substring("q", 1, max(top, depth - DIGITS)))
        before = level.select(
            F.col("g").alias("l_g"), F.col("base").alias("l_base"), "q",
            (F.sum("n").over(Window.partitionBy("g", "base", "parent").orderBy("q")) - F.col("n")).alias("front"),
        )
        out = out.join(before, (F.col("g") == F.col("l_g")) & (F.col("base") == F.col("l_base")) & (prefix == F.col("q"))).withColumn("start", F.col("start") + F.col("front")).drop("l_g", "l_base", "q", "front")
    return out


def radix_ranks(rows: DataFrame, key: Column, most: int = MOST) -> DataFrame:
    """Add ``rank`` from 0 of each row of durable ``rows`` by ``key`` within ``g``, both strings and not null, and ``below``, the rows of its ``g``."""
    left = rows.withColumn("key", key).withColumn("base", F.lit(0).cast("long"))
    n, low, high, longest = left.agg(F.count("*"), F.min("key"), F.max("key"), F.max(F.length("key"))).first()
    if not n:
        return rows.withColumn("rank", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
    top, ranked = common_beginning(low, high), []
    while True:
        levels = max(1, math.ceil(math.log(max(1, n / most), 16**DIGITS)))
        bottom = top + DIGITS * levels
        celled = left.withColumn("p", F.substring("key", 1, bottom))
        counts = durable(celled.groupBy("g", "base", "p").agg(F.count("*").alias("n")))
        cells, found = cell_starts(counts, top, bottom), ["start"]
        if "below" not in left.columns:
            # Sizes of groups join the cells; the rows get them by their cell, which is no hot key.
            cells, found = cells.join(counts.groupBy("g").agg(F.sum("n").alias("below")), "g"), ["start", "below"]
        cells = durable(cells)
        at = cells.select(F.col("g").alias("c_g"), F.col("base").alias("c_base"), F.col("p").alias("c_p"), *found, F.col("n").alias("c_n"))
        placed = celled.join(at, F.expr("g = c_g AND base = c_base AND p = c_p")).drop("c_g", "c_base", "c_p", "base", "p")
        last = bottom >= longest
        n = 0 if last else cells.where(F.col("n") > most).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        light = placed if not n else placed.where(F.col("c_n") <= most)
        within = F.row_number().over(Window.partitionBy("g", "start").orderBy("key"))
        ranked.append(light.withColumn("rank", F.col("start") + within - 1).drop("key", "start", "c_n"))
        if not n:
            break
        left, top = durable(placed.where(F.col("c_n") > most).withColumnRenamed("start", "base").drop("c_n")), bottom
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionByName(more)
    return out


# The trie


def grow(leaves: DataFrame, most_leaves: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of tries over ``leaves(g, rank, below, digest, ...)``, from the bottom; ``below`` is the number of leaves of ``g``.

    A row is a node ``(g, i, below, digest, members)``; its members are structs of what the
    level below has, in order, and ``below`` counts the nodes of that level. A lone leaf is
    handed up as it is.
    """

    def level(nodes: DataFrame) -> DataFrame:
        named = [c for c in nodes.columns if c not in ("g", "below")]
        grouped = nodes.groupBy("g", F.expr(f"at div {fanout}").alias("i")).agg(F.max("below").alias("below"), F.array_sort(F.collect_list(F.struct("at", *[c for c in named if c != "at"]))).alias("members"))
        joined = F.array_join(F.transform("members", lambda m: m["digest"]), "")
        return durable(grouped.withColumn("digest", F.when(F.col("below") == 1, F.get("members", F.lit(0))["digest"]).otherwise(F.sha2(joined, 256))))

    levels = [level(leaves.withColumnRenamed("rank", "at"))]
    count = -(-most_leaves // fanout)
    while count > 1:
        below = F.expr(f"(below + {fanout - 1}) div {fanout}")
        levels.append(level(levels[-1].select("g", F.col("i").alias("at"), below.alias("below"), "digest").where("below > 1")))
        count = -(-count // fanout)
    return levels


def tops(levels: list[DataFrame], fanout: int = FANOUT) -> list[DataFrame]:
    """Of each level the nodes without a parent, ``(g, digest)``."""
    return [t.where(F.col("below") <= fanout).select("g", "digest") for t in levels]


def members_with_steps(nodes: DataFrame) -> DataFrame:
    """Members of nodes ``(g, members, below, steps, subroot)``, each with its own step before its parent's.

    A step is the digests left and right of a node in its run, joined; a lone leaf has none.
    """
    each = nodes.select("g", "below", "steps", "subroot", "members", F.posexplode("members").alias("k", "m"))
    names = F.transform("members", lambda m: m["digest"])
    own = F.struct(F.array_join(F.slice(names, F.lit(1), F.col("k")), "").alias("left"), F.array_join(F.slice(names, F.col("k") + 2, F.size("members")), "").alias("right"))
    return each.select("g", "m", "subroot", F.when(F.col("below") == 1, F.col("steps")).otherwise(F.concat(F.array(own), F.col("steps"))).alias("steps"))


def descend(levels: list[DataFrame], roots: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves ``(g, m, subroot, steps)`` of ``levels``; ``roots(g, subroot, steps)`` are the steps above each trie."""
    above = None
    for table in reversed(levels):
        ends = table.where(F.col("below") <= fanout).select("g").join(roots, "g").select(F.col("g").alias("u_g"), F.lit(0).cast("long").alias("u_i"), "subroot", "steps")
        if above is not None:
            ends = ends.unionByName(above.select(F.col("g").alias("u_g"), F.col("m.at").alias("u_i"), "subroot", "steps"))
        above = members_with_steps(table.join(ends, F.expr("g = u_g AND i = u_i")))
    return above


def fold(digest: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its steps."""
    return F.aggregate(steps, digest, lambda acc, s: sha(s["left"], acc, s["right"]))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, key: str, group: str, digest: Column, carry: dict[str, Column] | None = None, fanout: int = FANOUT, most: int = MOST) -> DataFrame:
    """For each row ``key``, ``carry``, its leaf ``digest``, ``subroot``, ``root`` and ``steps``, an array of (left, right) digests up to the root."""
    carry = carry or {}
    kinds = dict(rows.dtypes)
    leaves = durable(rows.select(digits(F.col(group), kinds[group]).alias("g"), F.col(key).alias("id"), digest.alias("digest"), *[c.alias(k) for k, c in carry.items()]))
    # The row's number tells equal rows apart; stored rows keep theirs.
    full = F.concat(digits(F.col("id"), kinds[key]), F.substring("digest", 1, 16), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    largest = leaves.groupBy("g").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    first = grow(radix_ranks(leaves, full, most), largest, fanout)
    ends = tops(first, fanout)
    subroots = ends[0]
    for t in ends[1:]:
        subroots = subroots.unionByName(t)
    subroots = durable(subroots.withColumnsRenamed({"g": "lang_key"}).withColumn("g", F.lit("")))
    groups = subroots.count()
    last = grow(radix_ranks(subroots, F.col("lang_key"), most), groups, fanout)
    top = last[-1].first()
    root = F.lit(top and top["digest"]).cast("string")
    none = F.slice(F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))), 1, 0)
    roots = descend(last, rows.sparkSession.range(1).select(F.lit("").alias("g"), root.alias("subroot"), none.alias("steps")), fanout)
    roots = durable(roots.select(F.col("m.lang_key").alias("g"), F.col("m.digest").alias("subroot"), "steps"))
    found = descend(first, roots, fanout)
    return found.select(F.col("m.id").alias(key), *[F.col(f"m.{k}").alias(k) for k in carry], F.col("m.digest").alias("leaf"), "subroot", root.alias("root"), "steps")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; every document of which 3 divides the id's checksum is tampered with."""
    docs = documents(spark, sf_dir).select(*FIELDS)
    columns = {c: F.col(c) for c in FIELDS}
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(**columns | {"text": ascii_lower(F.col("text"))}))
    rows = manifest(docs, "doc_id", "lang", leaf(**columns), {"changed": changed})
    folded = rows.withColumn("proof_sha256", proof_digest(F.col("steps"))).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql(levels: int = 6, top: int = 2) -> str:
    """The same in DuckDB, level by level, for up to ``FANOUT ** levels`` rows a language and ``FANOUT ** top`` languages."""
    n = FANOUT

    def code(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def digest(text: str) -> str:
        return f"sha256({' || '.join([*[code(c) for c in FIELDS[:-1]], code(text)])})"

    def runs(t: str, k: int) -> str:
        return f"{t}r{k} AS MATERIALIZED (SELECT g, i // {n} AS run, list(d ORDER BY i) AS m, any_value(c) AS c FROM {t}{k} GROUP BY 1, 2)"

    def up(t: str, k: int) -> str:
        return f"{t}{k} AS MATERIALIZED (SELECT g, run AS i, CASE WHEN c = 1 THEN m[1] ELSE sha256(array_to_string(m, '')) END AS d, (c + {n - 1}) // {n} AS c FROM {t}r{k - 1})"

    def folded(f: str, t: str, k: int, group: str) -> str:
        left, right = f"array_to_string(m[1:pos % {n}], '')", f"array_to_string(m[pos % {n} + 2:], '')"
        met = f"SELECT f.*, {left} AS l, {right} AS r, q.c AS c FROM {f}{k} f JOIN {t}r{k} q ON q.g = f.{group} AND q.run = f.pos // {n}"
        return f"{f}{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (pos, acc, proof, l, r, c), pos // {n} AS pos, CASE WHEN c = 1 THEN acc ELSE sha256(l || acc || r) END AS acc, proof || l || r AS proof FROM ({met}))"

    crc = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(0, 256)) AS i)"
    crc_of = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce('1' || hex(encode(lang)), '0') AS g, {digest('text')} AS leaf, CASE WHEN {crc_of} % 3 = 0 THEN {digest(lower)} END AS changed FROM documents, ({crc}))""",
        "a0 AS MATERIALIZED (SELECT doc_id, leaf, changed, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d, count(*) OVER (PARTITION BY g) AS c FROM d)",
    ]
    for k in range(levels):
        steps += [runs("a", k), up("a", k + 1)]
    steps.append(f"b0 AS MATERIALIZED (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS i, d, count(*) OVER () AS c FROM a{levels})")
    for k in range(top):
        steps += [runs("b", k), up("b", k + 1)]
    steps.append("f0 AS MATERIALIZED (SELECT doc_id, leaf, changed, g, i AS pos, coalesce(changed, leaf) AS acc, '' AS proof FROM a0)")
    for k in range(levels):
        steps.append(folded("f", "a", k, "g"))
    steps.append(f"h0 AS MATERIALIZED (SELECT f.* EXCLUDE (pos), '' AS one, b0.i AS pos, b0.d AS subroot FROM f{levels} f JOIN b0 ON b0.lang = f.g)")
    for k in range(top):
        steps.append(folded("h", "b", k, "one"))
    return f"WITH {', '.join(steps)}\nSELECT doc_id, leaf, subroot, b.d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = b.d AS verified FROM h{top}, b{top} b"
