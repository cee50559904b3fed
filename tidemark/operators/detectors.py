"""Detectors behind one surface: nodes and edges in, ``(node_id, s)`` out, larger = more anomalous.

Message passing is a join and a sum in long form; dense layers, whose weights are small
arrays, run on Arrow batches. Subspace and tree models are fitted by MLlib.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distribution import quantiles
from ..functions.vectors import cosine, dot, long_form, mean_vector, norm, sigmoid, unit_vector, wide_form
from .graph import both_ways, neighbour_stack, topology_score
from .split import min_max


class Detector(ABC):
    """``fit`` once on training normals, ``score`` any graph for all of its nodes."""

    def fit(self, nodes: DataFrame, edges: DataFrame) -> Detector:
        return self

    @abstractmethod
    def score(self, nodes: DataFrame, edges: DataFrame) -> DataFrame: ...

    def missing(self, nodes: DataFrame, scores: DataFrame) -> DataFrame:
        """Nodes without a score; empty if the contract holds."""
        return nodes.select("node_id").join(scores.where("s IS NOT NULL"), "node_id", "left_anti")


_REGISTRY: dict[str, Callable[..., Detector]] = {}


def register(name: str) -> Callable:
    def add(factory: Callable[..., Detector]) -> Callable[..., Detector]:
        _REGISTRY[name] = factory
        return factory

    return add


def build(name: str, **parameters) -> Detector:
    if name not in _REGISTRY:
        raise KeyError(f"no detector {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name](**parameters)


@register("direction")
class Direction(Detector):
    """Half of one less the cosine to the mean direction of the training normals."""

    def fit(self, nodes: DataFrame, edges: DataFrame | None = None) -> Direction:
        unit = nodes.where("split = 'train' AND y = 0").select(unit_vector(F.col("x")).alias("x"))
        self.mu = mean_vector(unit)
        return self

    def score(self, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        return nodes.crossJoin(F.broadcast(self.mu)).select("node_id", F.round((1 - cosine(F.col("x"), F.col("mu"))) / 2, 9).alias("s"))


@register("precomputed")
class Precomputed(Detector):
    def __init__(self, scores: DataFrame):
        self.scores = scores

    def score(self, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        return nodes.select("node_id").join(self.scores, "node_id", "left").select("node_id", "s")


def subspace(nodes: DataFrame, variance: float = 0.92, k_max: int = 32) -> tuple[list[float], list[list[float]], list[float]]:
    """Mean, components (as rows) up to the share of variance, and all shares."""
    mu = mean_vector(nodes).first()["mu"]
    k = min(k_max, len(mu))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(nodes.select(array_to_vector(F.zip_with("x", F.array(*map(F.lit, mu)), lambda a, b: a - b)).alias("v")))
    shares = model.explainedVariance.toArray()
    keep = min(k, int(np.searchsorted(np.cumsum(shares), variance)) + 1)
    return mu, model.pc.toArray().T[:keep].tolist(), shares.tolist()


def residual(x: Column, mu: list[float], components: list[list[float]]) -> Column:
    """Squared distance to the subspace: all of the square less that of the projections."""
    z = F.zip_with(x, F.array(*map(F.lit, mu)), lambda a, b: a - b)
    inside = sum((F.pow(dot(z, F.array(*map(F.lit, c))), 2) for c in components), F.lit(0.0))
    return F.greatest(dot(z, z) - inside, F.lit(0.0))


def auto_alpha(rows: DataFrame, value: str) -> DataFrame:
    """One row ``alpha``: 0.8 + 0.2 sigmoid((median / IQR - 2) / 1.5)."""
    q = quantiles(rows, value, {"q1": 0.25, "mid": 0.5, "q3": 0.75})
    rho = F.col("mid") / F.greatest(F.col("q3") - F.col("q1"), F.lit(1e-8))
    return q.select((0.8 + 0.2 * sigmoid((rho - 2) / 1.5)).alias("alpha"))


@register("subspace")
class Subspace(Detector):
    """Residual to the training normals' subspace, fused with the topology score."""

    def __init__(self, alpha: float | None = None, variance: float = 0.92):
        self.alpha, self.variance = alpha, variance

    def fit(self, nodes: DataFrame, edges: DataFrame) -> Subspace:
        normals = nodes.where("split = 'train' AND y = 0")
        self.mu, self.components, self.shares = subspace(normals, self.variance)
        rated = normals.select(residual(F.col("x"), self.mu, self.components).alias("r"))
        self.mix = auto_alpha(rated, "r") if self.alpha is None else nodes.sparkSession.createDataFrame([(float(self.alpha),)], "alpha double")
        return self

    def score(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        rated = min_max(nodes.select("node_id", residual(F.col("x"), self.mu, self.components).alias("r")), "r", "r01")
        both = rated.join(topology_score(edges, nodes), "node_id").crossJoin(F.broadcast(self.mix))
        return min_max(both.select("node_id", (F.col("alpha") * F.col("r01") + (1 - F.col("alpha")) * F.col("topo")).alias("f")), "f", "s").select("node_id", "s")


@register("boosted")
class Boosted(Detector):
    """Boosted trees over features and rounds of neighbour means."""

    def __init__(self, rounds: int = 1, trees: int = 10, depth: int = 4, seed: int = 42):
        self.rounds, self.trees, self.depth, self.seed = rounds, trees, depth, seed

    def table(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        first = nodes.select(F.size("x").alias("d")).first()
        d = first["d"] if first else 1
        stacked = neighbour_stack(edges, nodes, self.rounds).withColumn("dim", F.col("round") * d + F.col("dim"))
        return wide_form(stacked.select("node_id", "dim", "val"), x="stack").select("node_id", array_to_vector("stack").alias("features"))

    def fit(self, nodes: DataFrame, edges: DataFrame) -> Boosted:
        train = self.table(nodes, edges).join(nodes.where("split = 'train'").select("node_id", F.col("y").cast("double").alias("label")), "node_id")
        share = train.agg(F.avg("label")).first()[0] or 0.0
        weighted = train.withColumn("w", F.when(F.col("label") == 1, 1 - share).otherwise(share))
        self.model = GBTClassifier(maxIter=self.trees, maxDepth=self.depth, weightCol="w", seed=self.seed).fit(weighted)
        return self

    def score(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return self.model.transform(self.table(nodes, edges)).select("node_id", F.element_at(vector_to_array("probability"), 2).alias("s"))


# Graph neural networks: inference with given weights


def normalised_adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src, dst, w)``: both directions and self-loops, repeated edges summed, scaled by both degrees."""
    loops = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    counted = both_ways(edges).unionAll(loops).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("m"))
    deg = counted.groupBy("src").agg(F.sum("m").alias("deg"))
    return counted.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("deg_d")), "dst").select("src", "dst", (F.col("m") / F.sqrt(F.col("deg") * F.col("deg_d"))).alias("w"))


def spread(adjacency: DataFrame, long: DataFrame) -> DataFrame:
    """One product of the adjacency with long-form features."""
    return adjacency.join(long.withColumnRenamed("node_id", "dst"), "dst").groupBy(F.col("src").alias("node_id"), "dim").agg(F.sum(F.col("w") * F.col("val")).alias("val"))


def dense(x: Column, weight: np.ndarray, bias: np.ndarray, relu: bool = False) -> Column:
    """A linear layer over Arrow batches; weights are outputs by inputs."""

    @F.pandas_udf("array<double>")
    def layer(values: pd.Series) -> pd.Series:
        out = np.array(values.tolist(), np.float64).reshape(len(values), -1) @ weight.T + bias
        return pd.Series(list(np.maximum(out, 0) if relu else out), dtype=object)

    return layer(x)


def beta_polynomials(degree: int) -> list[list[float]]:
    """Coefficients in L of the wavelets L^p (2 - L)^q / (2^(d+1) B(p + 1, q + 1)), p + q = d."""
    out = []
    for p in range(degree + 1):
        q = degree - p
        scale = math.exp(-(math.lgamma(p + 1) + math.lgamma(q + 1) - math.lgamma(degree + 2))) / 2 ** (degree + 1)
        poly = np.array([1.0])
        for factor, times in ((np.array([0.0, 1.0]), p), (np.array([2.0, -1.0]), q)):
            for _ in range(times):
                poly = np.convolve(poly, factor)
        out.append((poly * scale).tolist())
    return out


def wavelets(adjacency: DataFrame, long: DataFrame, degree: int = 2) -> DataFrame:
    """``(node_id, band, dim, val)``: all filters from the powers of L = 1 - A, each computed once."""
    powers = [long]
    for _ in range(degree):
        low = spread(adjacency, powers[-1]).withColumnRenamed("val", "low")
        powers.append(powers[-1].join(low, ["node_id", "dim"]).select("node_id", "dim", (F.col("val") - F.col("low")).alias("val")))
    stacked = powers[0].withColumn("k", F.lit(0))
    for k, p in enumerate(powers[1:], 1):
        stacked = stacked.unionByName(p.withColumn("k", F.lit(k)))
    coefficients = [F.array(*map(F.lit, c + [0.0] * (degree + 1 - len(c)))) for c in beta_polynomials(degree)]
    bands = F.posexplode(F.array(*coefficients)).alias("band", "c")
    return stacked.select("node_id", "dim", "k", "val", bands).groupBy("node_id", "band", "dim").agg(F.sum(F.col("val") * F.get("c", F.col("k"))).alias("val"))


@register("wavelet")
class Wavelet(Detector):
    """Beta-wavelet network: two dense layers, a filter and a dense layer per band, two dense layers, softmax of two.

    ``weights`` has ``w1`` to ``w4`` with ``b1`` to ``b4``, and ``f0``, ``fb0`` and so on for the bands.
    """

    def __init__(self, weights: dict[str, np.ndarray], degree: int = 2):
        self.w, self.degree = weights, degree

    def score(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        w = self.w
        h = nodes.select("node_id", dense(dense(F.col("x"), w["w1"], w["b1"], True), w["w2"], w["b2"], True).alias("x"))
        width = len(w["b2"])
        bands = wavelets(normalised_adjacency(edges, nodes), long_form(h), self.degree).withColumn("dim", F.col("band") * width + F.col("dim"))
        # The bands' own layers side by side are one layer of a block-diagonal matrix.
        filters = [np.asarray(w[f"f{p}"]) for p in range(self.degree + 1)]
        joint = np.zeros((sum(map(len, filters)), width * len(filters)))
        for p, f in enumerate(filters):
            top = sum(map(len, filters[:p]))
            joint[top : top + len(f), p * width : (p + 1) * width] = f
        shift = np.concatenate([w[f"fb{p}"] for p in range(self.degree + 1)])
        filtered = dense(F.col("z"), joint, shift, True)
        z = wide_form(bands.select("node_id", "dim", "val"), x="z").select("node_id", dense(dense(filtered, w["w3"], w["b3"], True), w["w4"], w["b4"]).alias("o"))
        return z.select("node_id", sigmoid(F.get("o", 1) - F.get("o", 0)).alias("s"))


@register("convolution")
class Convolution(Detector):
    """Two graph convolutions and the softmax of two outputs."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def score(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        a = normalised_adjacency(edges, nodes)
        h = nodes.select("node_id", dense(F.col("x"), self.w["w1"], self.w["b1"]).alias("x"))
        h = wide_form(spread(a, long_form(h)).withColumn("val", F.greatest("val", F.lit(0.0))))
        o = wide_form(spread(a, long_form(h.select("node_id", dense(F.col("x"), self.w["w2"], self.w["b2"]).alias("x")))), x="o")
        return o.select("node_id", sigmoid(F.get("o", 1) - F.get("o", 0)).alias("s"))


def attention(edges: DataFrame, nodes: DataFrame, weight: np.ndarray, left: np.ndarray, right: np.ndarray, slope: float = 0.2) -> DataFrame:
    """``(node_id, x)``: one head; the softmax runs over all of a node's edges and its self-loop."""
    h = nodes.select("node_id", dense(F.col("x"), weight, np.zeros(len(weight))).alias("h"))
    h = h.withColumn("l", dot(F.col("h"), F.array(*map(F.lit, left.tolist())))).withColumn("r", dot(F.col("h"), F.array(*map(F.lit, right.tolist()))))
    loops = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    ways = both_ways(edges).unionAll(loops).distinct()
    e = ways.join(h.select(F.col("node_id").alias("src"), "l"), "src").join(h.select(F.col("node_id").alias("dst"), "r", "h"), "dst").withColumn("e", F.col("l") + F.col("r"))
    e = e.withColumn("e", F.when(F.col("e") > 0, F.col("e")).otherwise(slope * F.col("e")))
    top = e.groupBy("src").agg(F.max("e").alias("top"))
    soft = e.join(top, "src").withColumn("p", F.exp(F.col("e") - F.col("top")))
    sums = soft.select("src", "p", F.posexplode("h").alias("dim", "v")).groupBy(F.col("src").alias("node_id"), "dim").agg((F.sum(F.col("p") * F.col("v")) / F.sum("p")).alias("val"))
    return wide_form(sums)


def reconstruction_scores(nodes: DataFrame, rebuilt: DataFrame, edges: DataFrame, alpha: float = 0.8) -> DataFrame:
    """``(node_id, s)``: attribute error and mean error of incident edges, whose rebuilt strength is a sigmoid of the dot product."""
    both = nodes.select("node_id", "x").join(rebuilt.select("node_id", F.col("x").alias("xh")), "node_id")
    diff = F.zip_with("x", "xh", lambda a, b: a - b)
    attr = both.select("node_id", norm(diff).alias("attr"))
    ends = [both.select(F.col("node_id").alias(k), F.col("xh").alias(f"h_{k}")) for k in ("src", "dst")]
    errors = edges.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", (1 - sigmoid(dot(F.col("h_src"), F.col("h_dst")))).alias("e"))
    incident = errors.select(F.explode(F.array("src", "dst")).alias("node_id"), "e").groupBy("node_id").agg(F.avg("e").alias("edge"))
    return attr.join(incident, "node_id", "left").select("node_id", (alpha * F.col("attr") + (1 - alpha) * F.coalesce("edge", F.lit(0.0))).alias("s"))


# Density ratios and clusters


def logistic_ratio(cal: DataFrame, test: DataFrame, at: DataFrame, clip: tuple[float, float] = (0.05, 20.0)) -> DataFrame:
    """``(node_id, w)``: odds of test against calibration by logistic regression, clipped, over the mean."""
    data = cal.select(array_to_vector("x").alias("features"), F.lit(0.0).alias("label")).unionAll(test.select(array_to_vector("x"), F.lit(1.0)))
    model = LogisticRegression(regParam=1e-3, maxIter=50).fit(data)
    p = F.element_at(vector_to_array("probability"), 2)
    rated = model.transform(at.select("node_id", array_to_vector("x").alias("features"))).select("node_id", F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), p / F.greatest(1 - p, F.lit(1e-6)))).alias("w"))
    return rated.crossJoin(F.broadcast(rated.agg(F.avg("w").alias("m")))).select("node_id", (F.col("w") / F.col("m")).alias("w"))


def kernel_ratio(cal: DataFrame, test: DataFrame, at: DataFrame, bases: int = 100, sample: int = 2000, steps: int = 300) -> DataFrame:
    """``(node_id, w)``: KLIEP with RBF bases; fitted on at most ``sample`` hash-chosen rows a side, applied to every row."""
    pick = lambda d: np.array([r.x for r in d.orderBy(F.md5(F.col("node_id").cast("string"))).limit(sample).select("x").collect()], np.float64)
    a, b = pick(cal), pick(test)
    centres = b[:bases]
    square = lambda u, v: np.maximum((u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * u @ v.T, 0)
    width = np.median(square(b, centres)) or 1.0
    kb, ka = np.exp(-square(b, centres) / width), np.exp(-square(a, centres) / width).mean(0)
    theta = np.ones(len(centres)) / max(ka.sum(), 1e-12)
    for _ in range(steps):
        theta *= (kb / np.maximum(kb @ theta, 1e-12)[:, None]).mean(0) / np.maximum(ka, 1e-12)
        theta /= max(float(ka @ theta), 1e-12)

    @F.pandas_udf("double")
    def ratio(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), np.float64).reshape(len(x), -1)
        return pd.Series(np.clip(np.exp(-square(m, centres) / width) @ theta, 0.05, 20.0))

    rated = at.select("node_id", ratio("x").alias("w"))
    return rated.crossJoin(F.broadcast(rated.agg(F.avg("w").alias("m")))).select("node_id", (F.col("w") / F.col("m")).alias("w"))


def pseudo_classes(nodes: DataFrame, k: int = 6, seed: int = 42) -> DataFrame:
    """``(node_id, cluster)`` of normals by k-means."""
    v = nodes.where("y = 0").select("node_id", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select("node_id", F.col("prediction").alias("cluster"))
