"""Proportional stratified interleaving of documents into shards.

Rows are shuffled by a seeded hash within their source and ranked. A row of rank r
among the n of its source has the fractional rank (2r - 1) / 2n. Sorted by that, every
stretch of rows holds the sources in the proportions of the whole table, so equal cuts
give shards that all match the mixture.

No source is ever ranked in one task: the hash's leading digits deal a source into
4,096 ranges, and ranks are a range's offset plus a rank within the range. The fractional
ranks are uniform by construction, so the second sort is dealt by equal ranges whose
offsets follow from the sources' sizes alone.

Defined cases: a null source is a source of its own, last where ranks are equal; a null
doc_id hashes like an empty one; a null text has no bytes (size 8, checksum 0); rows of one
doc_id are ordered by further columns, so reruns agree; rows that are equal in all of them
are interchangeable; an empty table gives an empty result. ``shard_documents`` replaces
columns named shard or slot and keeps all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, packed, whole_text

SHARDS = 24
SEED = 20240229
#: Hexadecimal digits of a hash in use, and how many of them name a range.
DIGITS, RANGE_DIGITS = 16, 3
RANGES = 4096


def seeded_hash(seed: int, key: Column) -> Column:
    """Hexadecimal digits from the MD5 of seed and key, which other engines compute as well."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, DIGITS)


def hash_range(h: Column) -> Column:
    return F.substring(h, 1, RANGE_DIGITS)


def interleave(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows``, which have ``source``, ``doc_id`` and the columns ``ties`` and no others that matter.

    Shards' row counts are at most one apart, and slots count from 0 without gaps.
    """
    keyed = rows.withColumn("h", seeded_hash(seed, F.col("doc_id"))).withColumn("hb", hash_range(F.col("h")))

    # Offsets of the hash ranges within each source: small, from two columns only.
    per_range = keyed.groupBy("source", "hb").agg(F.count(F.lit(1)).alias("n"))
    by_source = Window.partitionBy("source")
    offsets = per_range.select(
        "source", "hb",
        (F.sum("n").over(by_source.orderBy("hb")) - F.col("n")).alias("before"),
        F.sum("n").over(by_source).alias("n_source"),
    )

    # Rows in front of each range of fractional ranks: floor(ceil(2nj / RANGES) / 2) of a source of n rows.
    sources = per_range.groupBy("source").agg(F.sum("n").alias("n"))
    starts = (
        sources.select("n", F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("fb"))
        .select("fb", "n", F.expr(f"((2 * n * fb + {RANGES - 1}) div {RANGES}) div 2").alias("front"))
        .groupBy("fb")
        .agg(F.sum("front").alias("front"), F.sum("n").alias("total"))
    )

    within = Window.partitionBy("source", "hb").orderBy("h", "doc_id", *ties)
    ranked = (
        keyed.withColumn("r", F.row_number().over(within).cast("long"))
        .join(offsets.withColumnsRenamed({"source": "o_source", "hb": "o_hb"}), F.expr("source <=> o_source AND hb = o_hb"))
        .withColumn("r", F.col("r") + F.col("before"))
        .withColumn("fb", F.expr(f"CAST(((2 * r - 1) * {RANGES}) div (2 * n_source) AS INT)"))
        .withColumn("f", F.expr("(2 * r - 1) / (2 * n_source)"))
    )
    placed = Window.partitionBy("fb").orderBy("f", F.col("source").asc_nulls_last())
    return (
        ranked.withColumn("pos", F.row_number().over(placed).cast("long") - 1)
        .join(starts, "fb")
        .withColumn("pos", F.col("pos") + F.col("front"))
        .withColumn("shard", F.expr(f"CAST((pos * {shards}) div total AS INT)"))
        .withColumn("slot", F.expr(f"pos - (shard * total + {shards - 1}) div {shards}"))
        .drop("h", "hb", "r", "before", "n_source", "fb", "f", "pos", "front", "total", "o_source", "o_hb")
    )


def text_size(text: Column) -> Column:
    return (F.octet_length(whole_text(text)) + 8).cast("long")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The documents with ``shard`` and ``slot``, in place of columns of these names; the whole rows travel along."""
    rows = packed(docs.drop("shard", "slot"))
    keyed = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.xxhash64("row.text").alias("tie"))
    return interleave(keyed, shards, seed, ("tie",)).select("row.*", "shard", "slot")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of all documents under the law ``rows`` (counts at most one apart)."""
    narrow = documents(spark, sf_dir).select(
        "doc_id", "source",
        text_size(F.col("text")).alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
    )
    return interleave(narrow, ties=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


#: The same in DuckDB: one sort by fractional rank, and CRC-32 byte by byte from the table of its polynomial.
ORACLE_SQL = f"""
WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(0, 256)) AS i)),
d AS (SELECT doc_id, source, (strlen(coalesce(text, '')) + 8)::BIGINT AS size,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
 FROM documents, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY substr(md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, ''))), 1, {DIGITS}), doc_id, size, text_crc32) AS r, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), source NULLS LAST) - 1 AS pos FROM r),
s AS (SELECT *, ((pos * {SHARDS}) // total)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, NULL::INT AS grown_shard, source FROM s
"""
