"""Diffusion with restart from many seeds at once, by pushing residuals.

The state is a table ``(seed, node_id, deg, mass, rest)``. In a round every entry whose
residual exceeds ``eps`` times its node's degree keeps the share ``restart`` of it as mass
and sends the remainder to its neighbours in equal parts; all seeds push in the same join.
An entry is pushed only while its node has fewer than 1 / ``eps`` neighbours, so no hub's
list is ever sent, and a seed makes at most 1 / (``restart`` * ``eps``) messages whatever
the size of the graph. Stored after every round, so neither lineage nor a lost executor
costs more than a round.

When no residual is left above its bound, 0 <= exact - mass <= ``eps`` * degree of the node,
and <= the seed's remaining residual (undirected graphs).

Defined cases: repeated edges, both directions of one, and loops count once or not; a seed
without edges keeps all of its mass; repeated seeds count once; no seeds give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import durable
from .neighbours import both_ways

STATE = "seed", "node_id", "deg", "mass", "rest"


def diffusion(edges: DataFrame, seeds: DataFrame, restart: float = 0.15, eps: float = 1e-4) -> DataFrame:
    """``(seed, node_id, deg, mass, rest)`` for every node that a seed's diffusion reaches."""
    if not (0 < restart <= 1 and eps > 0):
        raise ValueError("restart must be in (0, 1] and eps above 0")
    ways = both_ways(edges).where("src <> dst").distinct()
    degrees = durable(ways.groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("deg")))
    # A node of 1 / eps neighbours or more never has enough residual to push.
    senders = degrees.where(F.col("deg") < 1 / eps).select("src")
    steps = durable(ways.join(senders, "src", "left_semi").join(degrees.select(F.col("src").alias("dst"), F.col("deg").alias("to_deg")), "dst").select("src", "dst", "to_deg"))
    starts = seeds.select("node_id").distinct().join(degrees.withColumnRenamed("src", "node_id"), "node_id", "left")
    state = durable(starts.select(F.col("node_id").alias("seed"), "node_id", F.coalesce("deg", F.lit(0.0)).alias("deg"), F.lit(0.0).alias("mass"), F.lit(1.0).alias("rest")))
    high = F.col("rest") > eps * F.col("deg")
    while state.where(high).limit(1).count():
        keep = F.when(high, F.when(F.col("deg") == 0, F.col("rest")).otherwise(restart * F.col("rest"))).otherwise(0.0)
        own = state.select("seed", "node_id", "deg", (F.col("mass") + keep).alias("mass"), F.when(high, 0.0).otherwise(F.col("rest")).alias("rest"))
        sent = state.where(high).withColumnRenamed("node_id", "src").join(steps, "src")
        got = sent.select("seed", F.col("dst").alias("node_id"), F.col("to_deg").alias("deg"), F.lit(0.0).alias("mass"), ((1 - restart) * F.col("rest") / F.col("deg")).alias("rest"))
        both = own.unionAll(got).groupBy("seed", "node_id")
        state = durable(both.agg(F.max("deg").alias("deg"), F.sum("mass").alias("mass"), F.sum("rest").alias("rest")))
    return state.select(*STATE)


def diffusion_top(edges: DataFrame, seeds: DataFrame, k: int, restart: float = 0.15, eps: float = 1e-4) -> DataFrame:
    """``(seed, node_id, mass, rank, certain)``: each seed's ``k`` nodes of most mass, itself left out, ties by id.

    ``certain`` tells whether no other node can belong among them: the last one's mass is
    above the next one's by more than what the next could still gain.
    """
    state = durable(diffusion(edges, seeds, restart, eps))
    left = state.groupBy("seed").agg(F.sum("rest").alias("left"))
    reached = state.where("node_id <> seed AND mass > 0")
    best = Window.partitionBy("seed").orderBy(F.desc(F.round("mass", 9)), "node_id")
    ranked = durable(reached.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1))
    ends = ranked.groupBy("seed").agg(F.max(F.when(F.col("rank") == k, F.col("mass"))).alias("last"), F.max(F.when(F.col("rank") == k + 1, F.col("mass"))).alias("next"))
    sure = ends.join(left, "seed").select("seed", F.coalesce(F.col("last") > F.coalesce("next", F.lit(0.0)) + F.col("left"), F.lit(False)).alias("certain"))
    return ranked.where(F.col("rank") <= k).join(sure, "seed").select("seed", "node_id", "mass", "rank", "certain")
