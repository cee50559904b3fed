"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

The mix is cut into about ``BLOCKS`` blocks of equal word counts. Blocks go to sources by
the highest quotients target / (2k + 1); the order in which they are won deals them to the
mix's shards, so that each shard has an integer quota per source. A source takes as many
words as its quotas hold blocks, and no more than ``CAP`` times its own. Its words, in
seeded document order, form blocks too, and a seeded order of these, pass after pass, is
the line from which its shards take their quotas one after another, the last block cut
where the last quota ends. So every taken word has a shard, and a source's words differ
from its target by about half a block (a share of 1 / ``2 BLOCKS`` of the mix), unless many
sources are worth less than half a block and win none; the method gives their blocks to
the others.

The quotients are listed uncut: of all that are at or above W / (2 seats + m), for W words
and m sources, there are at least as many as seats and at most m more.

Word positions within a source come from offsets of hash ranges plus a running sum in a
range, so a source with a third of all rows is never summed up in one task. Windows over
all sources see a row a source, the ranking of quotients at most ``BLOCKS`` and three a
source.

Defined cases: a null source is a source of its own, last in order; a null or empty text
has size 0 and is not taken; a null doc_id hashes like an empty one; repeated rows are
separate rows, and rows of one doc_id and size are interchangeable (``mix_documents`` tells
them apart by their whole contents); an empty table gives an empty result; targets of
sources without words are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_words, documents, durable, packed
from .sharding import hash_range, seeded_hash

BLOCKS = 1 << 17
SEED = 977
CAP = 3
SHARDS = 24
#: A prime above every block count, so that it has no factor in common with any of them.
STRIDE = 1_000_003


def targets(sizes: DataFrame, cap: int = CAP, blocks: int = BLOCKS) -> DataFrame:
    """Per source of ``sizes(source, size)``: words, weight, target and the mix's block.

    Sources by code point, null last, weigh 1, 2, 3 repeating. Targets share all words by
    weight but stop at ``cap`` times the source; what is above goes to the others by
    weight. Sorted by words per weight the capped sources come first, so running sums
    find the level of the rest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return (
        per_source.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("int"))
        .withColumn("all_words", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("capped_before", (F.sum("source_size").over(level) - F.col("source_size")) * cap)
        .withColumn("weight_left", F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(level) + F.col("weight"))
        .withColumn("rate", (F.col("all_words") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("capped", F.col("source_size") * cap <= F.col("weight") * F.col("rate"))
        .withColumn("rate", F.max(F.when(~F.col("capped"), F.col("rate"))).over(Window.partitionBy()))
        .withColumn("target", F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * F.col("rate")))
        .withColumn("block", F.greatest(F.lit(1), F.expr(f"(all_words + {blocks - 1}) div {blocks}")).cast("long"))
        .select("source", "source_size", "weight", "target", "all_words", "block")
    )


def seats(goals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Blocks won by each source, and the shard each goes to: highest quotients first.

    The mix has as many seats as whole blocks fit into all words, to the nearest.
    """
    won = Window.orderBy(F.col("quotient").desc(), F.col("source").asc_nulls_last(), "k")
    # A source has no fewer seats at the divisor d than target / 2d - 1/2, so with this one all seats are listed; one more for rounding.
    listed = "CAST(floor((target * (2 * seats + sources) / all_words + 1) / 2) AS BIGINT)"
    return (
        goals.where("target > 0")
        .withColumn("seats", F.expr("(2 * all_words + block) div (2 * block)"))
        .withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy()))
        .withColumn("k", F.explode(F.expr(f"sequence(0L, {listed})")))
        .withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
        .withColumn("seat", F.row_number().over(won).cast("long"))
        .where("seat <= seats")
        .select("source", "block", "k", "seat", F.expr(f"CAST(((seat - 1) * {shards}) div seats AS INT)").alias("shard"))
    )


def quotas(goals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Integer quotas ``(shard, source, blocks, words)`` of the mix."""
    return seats(goals, shards).groupBy("shard", "source").agg(F.count(F.lit(1)).alias("blocks"), F.sum("block").alias("words"))


def plan(sizes: DataFrame, seed: int = SEED, shards: int = SHARDS, cap: int = CAP, blocks: int = BLOCKS) -> DataFrame:
    """Per source: target, blocks won, where each shard's quota ends on the source's line, number of its blocks and seeded shift."""
    goals = targets(sizes, cap, blocks)
    own = F.struct("shard", "blocks", "words")
    won = quotas(goals, shards).groupBy(F.col("source").alias("w_source")).agg(F.collect_list(own).alias("quotas"), F.sum("blocks").alias("source_blocks"))
    ends = f"transform(sequence(0, {shards - 1}), h -> least(source_size * {cap}, aggregate(filter(coalesce(quotas, array()), q -> q.shard <= h), 0L, (s, q) -> s + q.words)))"
    return (
        goals.join(won, F.expr("source <=> w_source"), "left")
        .withColumn("source_blocks", F.coalesce("source_blocks", F.lit(0)).cast("long"))
        .withColumn("ends", F.expr(ends))
        .withColumn("n", F.greatest(F.lit(1), F.expr("(source_size + block - 1) div block")).cast("long"))
        .withColumn("shift", F.expr(f"CAST(conv(substring(md5(concat('{seed}:', coalesce(source, ''))), 1, 8), 16, 10) AS BIGINT) % n"))
        .withColumn("last_rank", F.expr(f"({STRIDE} * (n - 1) + shift) % n"))
        .withColumn("last_gap", F.expr("n * block - source_size"))
        .select(F.col("source").alias("p_source"), "source_size", "target", "source_blocks", "block", "ends", "n", "shift", "last_rank", "last_gap")
    )


#: Place of the block j on its source's line: behind the blocks of lower seeded rank, of which the source's last one is shorter.
_PLACE = f"(({STRIDE} * j + shift) % n) * block - IF((({STRIDE} * j + shift) % n) > last_rank, last_gap, 0L)"


def mix(rows: DataFrame, seed: int = SEED, ties: tuple[str, ...] = (), cap: int = CAP, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """Add ``source_size``, ``target``, ``source_blocks``, ``taken`` and ``by_shard`` to durable ``rows`` with doc_id, source and size.

    ``by_shard`` has the words that each shard takes of the row, ``taken`` their sum; ``ties``
    are further columns that order rows of one doc_id and size.
    """
    keyed = rows.withColumn("h", seeded_hash(seed, F.col("doc_id"))).withColumn("hb", hash_range(F.col("h")))
    per_range = keyed.groupBy("source", "hb").agg(F.sum("size").alias("w"))
    offsets = per_range.select(
        F.col("source").alias("o_source"), F.col("hb").alias("o_hb"),
        (F.sum("w").over(Window.partitionBy("source").orderBy("hb")) - F.col("w")).alias("before"),
    )
    chosen = plan(rows.select("source", "size"), seed, shards, cap, blocks)
    prepared = offsets.join(chosen, F.expr("o_source <=> p_source"))
    running = Window.partitionBy("source", "hb").orderBy("h", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    # A row's pieces of blocks, pass after pass, as intervals of the line; shards own the stretches between ends.
    own = "sequence(p div block, (p + size - 1) div block)"
    pieces = f"""flatten(transform(sequence(0, {cap - 1}), t -> transform({own}, j -> named_struct(
        'at', t * source_size + {_PLACE} + greatest(p - j * block, 0L), 'n', least(p + size, (j + 1) * block) - greatest(p, j * block)))))"""
    taken = "transform(ends, (e, h) -> aggregate(pieces, 0L, (s, x) -> s + greatest(0L, least(x.at + x.n, e) - greatest(x.at, IF(h = 0, 0L, ends[h - 1])))))"
    return (
        keyed.withColumn("p", F.sum("size").over(running) - F.col("size"))
        .join(prepared, F.expr("source <=> o_source AND hb = o_hb"))
        .withColumn("p", F.col("p") + F.col("before"))
        .withColumn("pieces", F.when(F.col("size") > 0, F.expr(pieces)).otherwise(F.expr("array()")))
        .withColumn("by_shard", F.expr(taken))
        .withColumn("taken", F.aggregate("by_shard", F.lit(0).cast("long"), lambda s, x: s + x))
        .drop("h", "hb", "p", "o_source", "o_hb", "p_source", "before", "block", "ends", "n", "shift", "last_rank", "last_gap", "pieces")
    )


def copies_of(taken: Column, size: Column, chance: Column) -> Column:
    """How often a document stands in the mix; one without words weighs nothing and stays once."""
    return F.when(size > 0, F.floor(taken / size + chance)).otherwise(F.lit(1)).cast("int")


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix: each as often as its taken words make up its size.

    A part of a document is rounded up as often as it is large, by a seeded hash, so that a
    source's words stay near its target. Only keys and sizes are ranked; the texts are read
    a second time and joined by a hash of id, source and text. Rows that share all three
    take the same number of copies each, that of their words together.
    """
    rows = packed(docs).select("row", F.xxhash64("row.doc_id", "row.source", "row.text").alias("key"))
    narrow = rows.select("key", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), count_words("row.text").alias("size"))
    mixed = mix(durable(narrow), seed, ("key",))
    per_key = mixed.groupBy(F.col("key").alias("c_key")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "c_key"), F.lit(1 << 30)) / (1 << 30)
    counts = per_key.select("c_key", copies_of(F.col("taken"), F.col("size"), chance).alias("copies")).where("copies > 0")
    return rows.join(counts, F.col("key") == F.col("c_key")).select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, and of which shards: ``shard:words``, comma-joined."""
    rows = durable(documents(spark, sf_dir).select("doc_id", "source", count_words().alias("size")))
    said = F.filter(F.transform("by_shard", lambda n, h: F.when(n > 0, F.concat_ws(":", h.cast("string"), n.cast("string")))), lambda x: x.isNotNull())
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken", "source", "source_blocks", F.array_join(said, ",").alias("shards"))


#: The same in DuckDB, from the definitions: quotients without a cut, every block's and every quota's stretch of its source's line, and where they overlap.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY 1),
lev AS (SELECT *, sum(source_size) OVER ()::BIGINT AS all_words, (sum(source_size) OVER o - source_size) * {CAP} AS before, sum(weight) OVER () - sum(weight) OVER o + weight AS left_over
 FROM src WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
rat AS (SELECT *, source_size * {CAP} <= weight * ((all_words - before) / left_over) AS capped, (all_words - before) / left_over AS rate FROM lev),
goal AS (SELECT source, source_size, all_words, CASE WHEN capped THEN (source_size * {CAP})::DOUBLE ELSE weight * max(rate) FILTER (NOT capped) OVER () END AS target, greatest(1, (all_words + {BLOCKS - 1}) // {BLOCKS})::BIGINT AS block FROM rat),
bid AS (SELECT source, block, (2 * all_words + block) // (2 * block) AS seats, unnest(range(0, (2 * all_words + block) // (2 * block))) AS k, target FROM goal WHERE target > 0),
won AS (SELECT *, ((seat - 1) * {SHARDS}) // seats AS shard FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS seat FROM bid) WHERE seat <= seats),
quota AS (SELECT won.source, shard, count(*) AS blocks, count(*) * any_value(won.block) AS words FROM won GROUP BY 1, 2),
line AS (SELECT quota.source, shard, blocks, least(source_size * {CAP}, (sum(words) OVER o)::BIGINT - words) AS lo, least(source_size * {CAP}, (sum(words) OVER o)::BIGINT) AS hi
 FROM quota JOIN goal ON quota.source IS NOT DISTINCT FROM goal.source WINDOW o AS (PARTITION BY quota.source ORDER BY shard)),
blk AS (SELECT *, (('0x' || substr(md5(concat('{SEED}:', coalesce(source, ''))), 1, 8))::BIGINT % n + {STRIDE} * j) % n AS r, least(block, source_size - j * block) AS len FROM
 (SELECT *, unnest(range(0, n)) AS j FROM (SELECT source, source_size, block, greatest(1, (source_size + block - 1) // block) AS n FROM goal))),
placed AS (SELECT *, (sum(len) OVER (PARTITION BY source ORDER BY r))::BIGINT - len AS place FROM blk),
pos AS (SELECT row_number() OVER () AS id, *, (sum(size) OVER (PARTITION BY source ORDER BY substr(md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, ''))), 1, 16), doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS p FROM d),
cell AS (SELECT id, pos.source, p, size, block, unnest(range(p // block, (p + size - 1) // block + 1)) AS j FROM pos JOIN goal ON pos.source IS NOT DISTINCT FROM goal.source WHERE size > 0),
piece AS (SELECT id, c.source, t * source_size + place + greatest(p - c.j * c.block, 0) AS a, least(p + size, (c.j + 1) * c.block) - greatest(p, c.j * c.block) AS n
 FROM cell c JOIN placed ON c.source IS NOT DISTINCT FROM placed.source AND c.j = placed.j, (SELECT unnest(range(0, {CAP})) AS t)),
part AS (SELECT id, shard, sum(least(a + n, hi) - greatest(a, lo))::BIGINT AS words FROM piece JOIN line ON piece.source IS NOT DISTINCT FROM line.source AND a < hi AND a + n > lo GROUP BY 1, 2),
doc AS (SELECT id, sum(words)::BIGINT AS taken, string_agg(concat(shard, ':', words), ',' ORDER BY shard) AS shards FROM part GROUP BY 1),
has AS (SELECT source, sum(blocks)::BIGINT AS source_blocks FROM quota GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, pos.source AS source, coalesce(source_blocks, 0) AS source_blocks, coalesce(shards, '') AS shards
FROM pos JOIN goal ON pos.source IS NOT DISTINCT FROM goal.source LEFT JOIN doc USING (id) LEFT JOIN has ON pos.source IS NOT DISTINCT FROM has.source
"""
