"""Hypergraph propagation, consistency, homophily, energies and walks as joins and sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distribution import cuts_of, in_range, lower_quantiles, quantiles, running
from ..functions.lineage import durable
from ..functions.vectors import cosine, dot, long_form, mean_vector, norm, sigmoid, unit_vector, wide_form
from .neighbours import both_ways


# Degrees and sets of edges


def hypergraph_degrees(knn: DataFrame) -> DataFrame:
    """``(node_id, d_v, d_e)``: hyperedges that hold the node, and members of its own."""
    v = knn.groupBy(F.col("j").alias("node_id")).agg(F.count(F.lit(1)).alias("d_v"))
    e = knn.groupBy(F.col("i").alias("node_id")).agg(F.count(F.lit(1)).alias("d_e"))
    return e.join(v, "node_id", "full").select("node_id", F.greatest(F.coalesce("d_v", F.lit(0)), F.lit(1)).alias("d_v"), F.greatest(F.coalesce("d_e", F.lit(0)), F.lit(1)).alias("d_e"))


def endpoint_degrees(edges: DataFrame) -> DataFrame:
    """``(node_id, deg)`` over both ends, repeated edges counted."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("deg"))


def neighbour_degrees(edges: DataFrame) -> DataFrame:
    """``(node_id, deg)``: different neighbours in the symmetrised graph."""
    return both_ways(edges).where("src <> dst").distinct().groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("deg"))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose two ends are among ``kept(node_id)``."""
    return edges.join(kept.select(F.col("node_id").alias("src")), "src", "left_semi").join(kept.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def without_hubs(nodes: DataFrame, edges: DataFrame, q: float = 0.98) -> DataFrame:
    """Nodes of degree up to the floored q-quantile of degrees (1 at least)."""
    degrees = nodes.select("node_id").join(endpoint_degrees(edges), "node_id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    limit = quantiles(degrees, "deg", {"cut": q}).select(F.greatest(F.floor("cut"), F.lit(1)).alias("cut"))
    return degrees.crossJoin(F.broadcast(limit)).where("deg <= cut").select("node_id", "deg")


def negative_edges(nodes: DataFrame, edges: DataFrame, n: int, seed: int = 11) -> DataFrame:
    """``n`` pairs by hash that are no edges: for each node a few partners by hash rank, less the edges."""
    from .split import hash_rank

    ranked = hash_rank(nodes.select("node_id"), "node_id", seed)
    tries = ranked.select(F.col("node_id").alias("src"), "rn", "n", F.explode(F.array(*[F.lit(s) for s in (3, 7, 13, 29)])).alias("step"))
    partner = ranked.select(F.col("node_id").alias("dst"), F.col("rn").alias("at"))
    pairs = tries.withColumn("at", F.pmod(F.col("rn") - 1 + F.col("step"), F.col("n")) + 1).join(partner, "at").where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs.join(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), ["src", "dst"], "left_anti").orderBy(F.md5(F.concat_ws(":", "src", "dst")), "src", "dst").limit(n)


# Propagation


def smooth(long: DataFrame, knn: DataFrame, degrees: DataFrame | None = None, gate: bool = False) -> DataFrame:
    """One two-hop step through the hypergraph: members to hyperedges by size, back by degree."""
    d = degrees if degrees is not None else hypergraph_degrees(knn)
    members = knn.join(d.select(F.col("node_id").alias("j"), "d_v"), "j").select("i", "j", (1 / F.sqrt("d_v")).alias("w"))
    sizes = d.select(F.col("node_id").alias("i"), F.col("d_e").cast("double").alias("d_e"))
    if gate:
        middle = lower_quantiles(sizes.select((1 / F.col("d_e")).alias("inv")), "inv", {"mid": 0.5})
        sizes = sizes.crossJoin(F.broadcast(middle)).withColumn("d_e", F.col("d_e") / sigmoid(F.log(1 / F.col("d_e")) - F.log("mid"))).drop("mid")
    edges = members.join(long.withColumnRenamed("node_id", "j"), "j").groupBy("i", "dim").agg(F.sum(F.col("val") * F.col("w")).alias("m")).join(sizes, "i").select("i", "dim", (F.col("m") / F.col("d_e")).alias("m"))
    return members.join(edges, "i").groupBy(F.col("j").alias("node_id"), "dim").agg(F.sum(F.col("m") * F.col("w")).alias("val"))


def propagate(long: DataFrame, knn: DataFrame, layers: int = 2, alpha: float = 0.5, beta: float = 0.0, gate: bool = False) -> DataFrame:
    """x <- (1 - a - b) x + a low + b (x - low), ``layers`` times; lineage is cut from the fourth layer on."""
    degrees = hypergraph_degrees(knn)
    for layer in range(layers):
        low = smooth(long, knn, degrees, gate).withColumnRenamed("val", "low")
        mixed = (1 - alpha - beta) * F.col("val") + alpha * F.col("low") + beta * (F.col("val") - F.col("low"))
        long = long.join(low, ["node_id", "dim"]).select("node_id", "dim", mixed.alias("val"))
        if layer >= 3:
            long = durable(long)
    return long


# Neighbourhood statistics and consistency


def neighbour_scores(knn: DataFrame, scores: DataFrame) -> DataFrame:
    """``(node_id, med, mean)`` of members' scores; the median is the lower of two middle ones. A hyperedge is small."""
    s = knn.join(scores.select(F.col("node_id").alias("j"), "s"), "j")
    return s.groupBy(F.col("i").alias("node_id")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY s)").alias("med"), F.avg("s").alias("mean"))


def neighbour_centroids(knn: DataFrame, nodes: DataFrame, include_self: bool = True, unit: bool = False) -> DataFrame:
    """``(node_id, centroid)``: mean vector of the members, of unit vectors if asked."""
    x = nodes.select(F.col("node_id").alias("j"), (unit_vector(F.col("x")) if unit else F.col("x")).alias("x"))
    members = knn if include_self else knn.where("i <> j")
    # A row a member, not a component: a hyperedge is small.
    held = members.join(x, "j").groupBy(F.col("i").alias("node_id")).agg(F.collect_list("x").alias("xs"))
    return held.mapInArrow(_means, held.select("node_id", F.get("xs", 0).alias("centroid")).schema).where("size(centroid) > 0")


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean vectors of lists of vectors, added member by member; null components count nowhere."""
    for b in batches:
        lists = b.column(1)
        inner = lists.flatten()
        width, sizes = pc.max(pc.list_value_length(inner)).as_py() or 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        lengths = pc.list_value_length(inner).to_numpy(zero_copy_only=False)
        vals = inner.flatten()
        row, dim = np.repeat(owner, lengths), np.arange(len(vals)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place, seen = row * width + dim, vals.is_valid().to_numpy(zero_copy_only=False)
        total = np.bincount(place[seen], vals.drop_null().to_numpy(zero_copy_only=False), len(sizes) * width)
        n = np.bincount(place[seen], minlength=len(sizes) * width)
        longest = np.zeros(len(sizes), np.int64)
        np.maximum.at(longest, owner, lengths)
        kept = (np.arange(width)[None] < longest[:, None]).ravel() if width else np.zeros(0, bool)
        means = pa.array(np.divide(total, n, out=np.zeros_like(total), where=n > 0)[kept], pa.float64(), mask=(n == 0)[kept])
        ends = np.concatenate([[0], np.cumsum(longest)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), means)], ["node_id", "centroid"])


def consistency(nodes: DataFrame, knn: DataFrame, scores: DataFrame, parts: bool = False) -> DataFrame:
    """``(node_id, c)``: geometric mean of score and feature agreement with the hyperedge.

    Both deviations are scaled by their mean over all calibration rows.
    """
    dev = scores.join(neighbour_scores(knn, scores), "node_id").select("node_id", F.abs(F.col("s") - F.col("med")).alias("dev"))
    dist = nodes.join(neighbour_centroids(knn, nodes), "node_id").select("node_id", "split", (1 - cosine(F.col("x"), F.col("centroid"))).alias("dist"))
    both = dist.join(dev, "node_id")
    scale = both.where("split = 'cal'").agg(F.greatest(F.avg("dev"), F.lit(1e-8)).alias("m_dev"), F.greatest(F.avg("dist"), F.lit(1e-8)).alias("m_dist"))
    c_s, c_f = F.exp(-F.col("dev") / F.col("m_dev")), F.exp(-F.col("dist") / F.col("m_dist"))
    out = both.crossJoin(F.broadcast(scale)).withColumn("c_score", c_s).withColumn("c_feat", c_f)
    out = out.withColumn("c", F.greatest(F.lit(1e-8), F.least(F.lit(1.0), F.sqrt(F.col("c_score") * F.col("c_feat")))))
    return out.select("node_id", "c", "c_score", "c_feat", "dev", "dist") if parts else out.select("node_id", "c")


def contrastive_consistency(nodes: DataFrame, knn: DataFrame) -> DataFrame:
    """``(node_id, c)``: sigmoid agreement with the neighbourhood times that with the calibration normals."""
    unit = nodes.where("split = 'cal' AND y = 0").select(unit_vector(F.col("x")).alias("x"))
    mu = mean_vector(unit)
    near = nodes.join(neighbour_centroids(knn, nodes), "node_id").crossJoin(F.broadcast(mu))
    return near.select("node_id", (sigmoid(cosine(F.col("x"), F.col("centroid"))) * sigmoid(cosine(F.col("x"), F.col("mu")))).alias("c"))


def class_homophily(knn: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per class: share of nodes whose neighbours' majority (ties 0) is the class, and mean share of like neighbours."""
    y = nodes.select("node_id", "y")
    votes = knn.where("i <> j").join(y.select(F.col("node_id").alias("j"), F.col("y").alias("yj")), "j").groupBy(F.col("i").alias("node_id")).agg(F.avg(F.col("yj").cast("double")).alias("ones"))
    seen = y.join(votes, "node_id")
    vote = F.when(F.col("ones") > 0.5, 1).otherwise(0)
    like = F.when(F.col("y") == 1, F.col("ones")).otherwise(1 - F.col("ones"))
    return seen.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg((vote == F.col("y")).cast("double")).alias("agree"), F.avg(like).alias("like"))


def edge_homophily(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = (labels.select(F.col("node_id").alias(e), F.col("y").alias(f"y_{e}")) for e in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").agg(F.avg((F.col("y_src") == F.col("y_dst")).cast("double")).alias("homophily"), F.count(F.lit(1)).alias("n_edges"))


def dirichlet_energy(knn: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, energy)``: squared differences of degree-scaled vectors over the hyperedge, without self."""
    d = hypergraph_degrees(knn).select("node_id", "d_v")
    x = nodes.select("node_id", "x").join(d, "node_id").select("node_id", F.transform("x", lambda v: v / F.sqrt("d_v")).alias("u"))
    pairs = knn.where("i <> j").join(x.select(F.col("node_id").alias("i"), F.col("u").alias("a")), "i").join(x.select(F.col("node_id").alias("j"), F.col("u").alias("b")), "j")
    diff = F.zip_with("a", "b", lambda p, q: p - q)
    return pairs.groupBy(F.col("i").alias("node_id")).agg(F.sum(dot(diff, diff)).alias("energy"))


def graph_energy(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same over a given graph; nodes without edges have energy 0."""
    ways = both_ways(edges).where("src <> dst").distinct()
    d = ways.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("deg"))
    u = nodes.select("node_id", "x").join(d, "node_id").select("node_id", F.transform("x", lambda v: v / F.sqrt("deg")).alias("u"))
    pairs = ways.join(u.select(F.col("node_id").alias("src"), F.col("u").alias("a")), "src").join(u.select(F.col("node_id").alias("dst"), F.col("u").alias("b")), "dst")
    diff = F.zip_with("a", "b", lambda p, q: p - q)
    sums = pairs.groupBy(F.col("src").alias("node_id")).agg(F.sum(dot(diff, diff)).alias("energy"))
    return nodes.select("node_id").join(sums, "node_id", "left").select("node_id", F.coalesce("energy", F.lit(0.0)).alias("energy"))


def neighbour_moments(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, dim, mean, log_var)`` of in-neighbours, without self-loops."""
    m = edges.where("src <> dst").join(long_form(nodes).withColumnRenamed("node_id", "src"), "src").groupBy(F.col("dst").alias("node_id"), "dim").agg(F.avg("val").alias("mean"), F.avg(F.col("val") * F.col("val")).alias("square"))
    return m.select("node_id", "dim", "mean", F.log(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(1e-6))).alias("log_var"))


def neighbour_stack(edges: DataFrame, nodes: DataFrame, rounds: int = 2) -> DataFrame:
    """``(node_id, round, dim, val)``: features, then rounds of two-way neighbour means of them (0 without neighbours)."""
    ways = both_ways(edges)
    now = long_form(nodes)
    out = now.withColumn("round", F.lit(0))
    for r in range(1, rounds + 1):
        means = ways.join(now.withColumnRenamed("node_id", "dst"), "dst").groupBy(F.col("src").alias("node_id"), "dim").agg(F.avg("val").alias("m"))
        now = now.join(means, ["node_id", "dim"], "left").select("node_id", "dim", F.coalesce("m", F.lit(0.0)).alias("val"))
        out = out.unionByName(now.withColumn("round", F.lit(r)))
    return out.select("node_id", "round", "dim", "val")


def incident_error(edges: DataFrame, errors: DataFrame) -> DataFrame:
    """``(node_id, err)``: mean error of the edges at either end; ``errors(src, dst, e)`` has one per edge."""
    ends = errors.select(F.explode(F.array("src", "dst")).alias("node_id"), "e")
    return ends.groupBy("node_id").agg(F.avg("e").alias("err"))


def topology_score(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, topo)``: mean of three min-max scaled signs of a node that is unlike its surroundings.

    The first sign is one less the mean cosine to the neighbours; it is 1 without neighbours or length.
    """
    ways = both_ways(edges).where("src <> dst").distinct()
    deg = nodes.select("node_id").join(ways.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("deg")), "node_id", "left").select("node_id", F.log1p(F.coalesce("deg", F.lit(0))).alias("ld"))
    unit = nodes.select("node_id", unit_vector(F.col("x")).alias("u"))
    pairs = ways.join(unit.toDF("src", "a"), "src").join(unit.toDF("dst", "b"), "dst")
    like = pairs.groupBy(F.col("src").alias("node_id")).agg(F.avg(dot(F.col("a"), F.col("b"))).alias("like"))
    unlike = nodes.select("node_id").join(like, "node_id", "left").select("node_id", (1 - F.coalesce("like", F.lit(0.0))).alias("a"))
    stats = quantiles(deg, "ld", {"mid": 0.5}).crossJoin(deg.agg(F.greatest(F.stddev_pop("ld"), F.lit(1e-6)).alias("sd")))
    around = ways.join(deg.select(F.col("node_id").alias("dst"), F.col("ld").alias("nd")), "dst").groupBy(F.col("src").alias("node_id")).agg(F.avg("nd").alias("nd"))
    parts = unlike.join(deg, "node_id").join(around, "node_id", "left").crossJoin(F.broadcast(stats)).select(
        "node_id", "a",
        F.least(F.abs(F.col("ld") - F.col("mid")) / F.col("sd"), F.lit(5.0)).alias("b"),
        F.least(F.abs(F.col("ld") - F.coalesce("nd", "ld")) / F.col("sd"), F.lit(5.0)).alias("c"),
    )
    ends = parts.agg(*[f(c).alias(f"{c}_{n}") for c in "abc" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    scaled = [F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), (F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))).otherwise(0.0) for c in "abc"]
    return parts.crossJoin(F.broadcast(ends)).select("node_id", ((scaled[0] + scaled[1] + scaled[2]) / 3).alias("topo"))


# Walks


def pagerank(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, restart: float = 0.15, rounds: int = 60, tolerance: float = 1e-6, directed: bool = False, check_every: int = 5) -> DataFrame:
    """``(node_id, ppr)``: pi <- (1 - r) P'pi + r seed, from equal seeds; stops early when the change is small.

    ``directed`` follows edges as they stand; sinks then leak mass.
    """
    ways = (edges.select("src", "dst") if directed else both_ways(edges)).where("src <> dst").distinct()
    out = ways.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    steps = durable(ways.join(out, "src").select("src", "dst", (1 / F.col("deg")).alias("p")))
    seed = durable(seeds.select("node_id").distinct().crossJoin(F.broadcast(seeds.select("node_id").distinct().agg(F.count(F.lit(1)).alias("n")))).select("node_id", (1.0 / F.col("n")).alias("seed")))
    now = last = seed.withColumnRenamed("seed", "pi")
    for i in range(1, rounds + 1):
        moved = steps.join(now.withColumnRenamed("node_id", "src"), "src").select(F.col("dst").alias("node_id"), ((1 - restart) * F.col("pi") * F.col("p")).alias("part"))
        home = seed.select("node_id", (restart * F.col("seed")).alias("part"))
        now = moved.unionAll(home).groupBy("node_id").agg(F.sum("part").alias("pi"))
        if i % check_every == 0 and i < rounds:
            now = durable(now)
            change = now.withColumnRenamed("pi", "new").join(last, "node_id", "full").agg(F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("pi", F.lit(0.0))))).first()[0]
            if (change or 0.0) < tolerance:
                break
            last = now
    return nodes.select("node_id").join(now, "node_id", "left").select("node_id", F.coalesce("pi", F.lit(0.0)).alias("ppr"))


def rank01(rows: DataFrame, value: str, key: str = "node_id", name: str = "r") -> DataFrame:
    """Add the rank of ``value`` over the number of rows, in (0, 1]; ties by key.

    Values and, where one holds more than a range, keys cut the rows, so ties of one value
    are ranked in several tasks.
    """
    rows = durable(rows)
    cuts = cuts_of(rows, value)
    dealt = rows.withColumn("_range", in_range(cuts, F.col(value)))
    keyed = F.col(key) if dict(rows.dtypes)[key] in ("bigint", "int") else F.lit(0)
    keys = cuts_of(rows.select(keyed.alias("k")), "k") if cuts else []
    # Below a range's first value nothing is cut; a value that fills ranges alone is cut by key.
    at_cut = F.when(F.array_contains(F.array(*map(F.lit, cuts)), F.col(value)), in_range(keys, keyed)).otherwise(F.lit(-1)) if cuts else F.lit(-1)
    dealt = dealt.withColumn("_part", at_cut)
    per = dealt.groupBy("_range", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per.select("_range", "_part", (F.sum("_n").over(Window.orderBy("_range", "_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    within = Window.partitionBy("_range", "_part").orderBy(value, key)
    return dealt.join(offsets, ["_range", "_part"]).withColumn(name, (F.row_number().over(within) + F.col("_before")) / F.col("_all")).drop("_range", "_part", "_before", "_all")


def structure_score(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, **walk) -> DataFrame:
    """``(node_id, c)``: rank of the walk's mass, in [1e-8, 1]."""
    return rank01(pagerank(edges, nodes, seeds, **walk), "ppr", name="c").select("node_id", F.greatest("c", F.lit(1e-8)).alias("c"))


def pull_kernel(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, restart: float = 0.15, rounds: int = 3) -> DataFrame:
    """Row-normalised pull instead of push: pi_row <- mean of neighbours' pi."""
    ways = both_ways(edges).where("src <> dst").distinct()
    n = seeds.select("node_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    seed = nodes.select("node_id").join(seeds.select("node_id").distinct().withColumn("on", F.lit(1.0)), "node_id", "left").crossJoin(F.broadcast(n)).select("node_id", (F.coalesce("on", F.lit(0.0)) / F.col("n")).alias("seed"))
    now = seed.withColumnRenamed("seed", "pi")
    for i in range(rounds):
        pulled = ways.join(now.withColumnRenamed("node_id", "dst"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.avg("pi").alias("pulled"))
        now = seed.join(pulled, "node_id", "left").select("node_id", ((1 - restart) * F.coalesce("pulled", F.lit(0.0)) + restart * F.col("seed")).alias("pi"))
        if i % 5 == 4:
            now = durable(now)
    return now.withColumnRenamed("pi", "ppr")


def cumulative(rows: DataFrame, order: str, value: str) -> DataFrame:
    return running(rows, order, [value])
