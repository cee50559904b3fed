"""Random walks with restart, sampled by hashes, and scores that compare a node with its walk.

A step is one join: each walker's next node is the neighbour that a hash of walk, round and
step picks among those of its node. Walks repeat exactly. Neighbour lists are kept per node
in blocks of ``BLOCK`` so that a hub's list is dealt over rows. Defined cases: a walker at a
node without neighbours goes home; seeds without edges visit themselves only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import durable
from ..functions.vectors import cosine, hash_uniform
from .graph import pagerank
from .neighbours import both_ways

BLOCK = 4096


def neighbour_blocks(edges: DataFrame) -> DataFrame:
    """``(node_id, deg, block, near)``: a node's neighbours in blocks, in order of their ids within hash ranges."""
    ways = both_ways(edges).where("src <> dst").distinct()
    deg = ways.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("deg") / BLOCK)).alias("part")
    dealt = ways.join(deg, "src").select("src", "deg", part, "dst").groupBy("src", "deg", "part").agg(F.array_sort(F.collect_list("dst")).alias("near"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(F.col("src").alias("node_id"), "deg", "near", F.coalesce(F.sum(F.size("near")).over(before), F.lit(0)).alias("first"))


def sampled_walks(edges: DataFrame, seeds: DataFrame, length: int = 8, rounds: int = 1, restart: float = 0.3, seed: int = 5) -> DataFrame:
    """``(node_id, round, step, visited)`` of walks from every seed; step 0 is the seed."""
    blocks = durable(neighbour_blocks(edges))
    now = seeds.select("node_id").distinct().withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("visited", F.col("node_id"))
    out = now.withColumn("step", F.lit(0))
    degrees = blocks.select(F.col("node_id").alias("visited"), "deg").distinct()
    for step in range(1, length + 1):
        u = hash_uniform("node_id", "round", F.lit(step), F.lit(seed))
        home = hash_uniform("node_id", "round", F.lit(step), F.lit(seed + 1)) < restart
        placed = now.join(degrees, "visited", "left").withColumn("k", F.floor(u * F.col("deg"))).withColumn("home", home | F.col("deg").isNull())
        stay = placed.where("home").select("node_id", "round", F.col("node_id").alias("visited"))
        moving = placed.where("NOT home").join(blocks.select(F.col("node_id").alias("visited"), "first", "near"), "visited").where("k >= first AND k < first + size(near)")
        now = durable(stay.unionByName(moving.select("node_id", "round", F.get("near", (F.col("k") - F.col("first")).cast("int")).alias("visited"))))
        out = out.unionByName(now.withColumn("step", F.lit(step)))
    return out.select("node_id", "round", "step", "visited")


def walk_top(edges: DataFrame, nodes: DataFrame, seed_id: int, k: int, restart: float = 0.15) -> DataFrame:
    """The ``k`` nodes of most mass of one seed's walk, itself left out."""
    seed = nodes.where(F.col("node_id") == seed_id).select("node_id")
    return pagerank(edges, nodes, seed, restart).where(F.col("node_id") != seed_id).orderBy(F.desc("ppr"), "node_id").limit(k)


def contrast_scores(edges: DataFrame, nodes: DataFrame, length: int = 4, rounds: int = 8, seed: int = 5) -> DataFrame:
    """``(node_id, s)``: mean over rounds of the agreement with another node's walk less that with the own one.

    The other node is the next in hash order; a normal node agrees with its own surroundings.
    """
    from .split import hash_rank

    walks = sampled_walks(edges, nodes, length, rounds, seed=seed).where("step > 0")
    seen = walks.join(nodes.select(F.col("node_id").alias("visited"), "x"), "visited").select("node_id", "round", F.posexplode("x").alias("dim", "val"))
    means = seen.groupBy("node_id", "round", "dim").agg(F.avg("val").alias("val"))
    pairs = F.array_sort(F.collect_list(F.struct("dim", "val")))
    around = durable(means.groupBy("node_id", "round").agg(F.transform(pairs, lambda p: p["val"]).alias("m")))
    ranked = hash_rank(nodes.select("node_id"), "node_id", seed)
    nxt = ranked.select(F.col("node_id").alias("other"), "rn")
    other = ranked.withColumn("rn", F.pmod(F.col("rn"), F.col("n")) + 1).join(nxt, "rn").select("node_id", "other")
    own = nodes.select("node_id", "x").join(around, "node_id").join(other, "node_id")
    both = own.join(around.select(F.col("node_id").alias("other"), "round", F.col("m").alias("mo")), ["other", "round"])
    return both.groupBy("node_id").agg(F.avg(cosine(F.col("x"), F.col("mo")) - cosine(F.col("x"), F.col("m"))).alias("s"))
