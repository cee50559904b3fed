"""Detector that rebuilds a node's neighbourhood: its vector, its degree and its neighbours' distribution.

Vectors are brought to ``hidden`` numbers by a fixed random projection. Two convolutions make
a code of a node and its surroundings; heads on the code rebuild the projected vector, the
logarithm of one plus the degree, and the mean and log-variance of the neighbours' projected
vectors. A score is the weighted sum of the squared errors and of the Kullback-Leibler
divergence of the rebuilt Gaussian from the neighbours': larger is more anomalous. No label is
read; the loss is the mean score of the training rows.

The targets and the first convolution's product with the projected vectors never change, so
they are made and stored once. An epoch sends one vector of ``hidden`` numbers a node forward
and one back (``training.py``), whatever the number of heads.

Defined cases: neighbours are counted once, in both directions, without the node itself; a node
without neighbours has degree 1, mean 0 and the least variance (1e-6), as has one whose
neighbours are all equal their mean; without training rows the first weights stay; an empty
graph gives no scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import durable
from .detectors import Detector, normalised_adjacency, register
from .neighbours import both_ways
from .training import Network, Run, Weights, descend, filled, glorot, mapped, messages, stacked, summed

LEAST_VARIANCE = 1e-6
#: Weights of the vector's, the degree's and the neighbours' part.
SHARES = (0.8, 0.5, 0.001)


def moments(matrix: DataFrame, rows: DataFrame, value: str, width: int) -> DataFrame:
    """``(node_id, mu, lv)``: mean and log-variance of ``value`` under the weights of each row of ``(src, dst, w)``."""
    both = rows.select("node_id", F.concat(F.col(value), F.transform(value, lambda v: v * v)).alias("m"))
    got = messages(matrix, both, "m", 2 * width).select("node_id", F.slice("m", 1, width).alias("mu"), F.slice("m", width + 1, width).alias("square"))
    variance = F.zip_with("square", "mu", lambda q, m: F.greatest(q - m * m, F.lit(LEAST_VARIANCE)))
    return got.select("node_id", "mu", F.transform(variance, lambda v: F.log(v)).alias("lv"))


def neighbourhoods(rows: DataFrame, edges: DataFrame, value: str, width: int) -> DataFrame:
    """``(node_id, d, mu, lv)``: log1p of the degree, and the moments of ``value`` over different neighbours."""
    ways = both_ways(edges).where("src <> dst").distinct()
    degrees = ways.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    got = moments(ways.join(degrees, "src").select("src", "dst", (1 / F.col("n")).alias("w")), rows, value, width)
    sized = rows.select("node_id").join(degrees.withColumnRenamed("src", "node_id"), "node_id", "left").join(got, "node_id", "left")
    flat = lambda v: F.array_repeat(F.lit(float(v)), width)
    return sized.select("node_id", F.log1p(F.coalesce("n", F.lit(1))).alias("d"), F.coalesce("mu", flat(0)).alias("mu"), F.coalesce("lv", flat(np.log(LEAST_VARIANCE))).alias("lv"))


def neighbourhood_loss(goal: str, rebuilt: str, shares: tuple[float, float, float] = SHARES) -> Column:
    """Loss of a row from two structs ``(x, d, mu, lv)``, the true and the rebuilt neighbourhood."""
    part = lambda side, name: F.col(f"{side}.{name}")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    squares = lambda name: F.zip_with(part(rebuilt, name), part(goal, name), lambda a, b: (a - b) * (a - b))
    own = total(squares("x")) / F.size(part(goal, "x"))
    degree = (part(rebuilt, "d") - part(goal, "d")) * (part(rebuilt, "d") - part(goal, "d"))
    wider = total(F.zip_with(part(goal, "lv"), part(rebuilt, "lv"), lambda t, p: t - p + F.exp(p - t) - 1))
    off = total(F.zip_with(squares("mu"), part(goal, "lv"), lambda q, t: q * F.exp(-t)))
    return shares[0] * own + shares[1] * degree + shares[2] * 0.5 * (wider + off)


def _head(w: Weights, name: str, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = np.maximum(code @ w[f"{name}1"].T + w[f"{name}b1"], 0)
    return middle, middle @ w[f"{name}2"].T + w[f"{name}b2"]


def decoded(w: Weights, around: np.ndarray) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Codes, each head's middle layer and output, and the degrees, from the second convolution's messages."""
    code = np.maximum(around @ w["w2"].T + w["b2"], 0)
    return code, {k: _head(w, k, code) for k in ("x", "m", "v")}, code @ w["d"] + w["db"][0]


def slopes(w: Weights, around: np.ndarray, goal: np.ndarray, t: np.ndarray, shares: tuple[float, float, float]) -> tuple[Weights, np.ndarray]:
    """Loss and gradients of the rows by the weights above the messages, and by the messages themselves."""
    size = len(w["b2"])
    x, d, mu, lv = goal[:, :size], goal[:, size], goal[:, size + 1 : 2 * size + 1], goal[:, 2 * size + 1 :]
    code, heads, degree = decoded(w, around)
    off, width = heads["m"][1] - mu, np.exp(heads["v"][1] - lv)
    own = ((heads["x"][1] - x) ** 2).mean(1)
    spread = 0.5 * (lv - heads["v"][1] + width + off**2 * np.exp(-lv) - 1).sum(1)
    loss = shares[0] * own + shares[1] * (degree - d) ** 2 + shares[2] * spread
    by = {"x": shares[0] * 2 / size * (heads["x"][1] - x), "m": shares[2] * off * np.exp(-lv), "v": shares[2] * 0.5 * (width - 1)}
    g = t * shares[1] * 2 * (degree - d)
    out: Weights = {"loss": (t * loss).sum(), "d": g @ code, "db": np.array([g.sum()])}
    down = g[:, None] * w["d"]
    for k, slope in by.items():
        slope, middle = t[:, None] * slope, heads[k][0]
        inner = (slope @ w[f"{k}2"]) * (middle > 0)
        out |= {f"{k}2": slope.T @ middle, f"{k}b2": slope.sum(0), f"{k}1": inner.T @ code, f"{k}b1": inner.sum(0)}
        down = down + inner @ w[f"{k}1"]
    down = down * (code > 0)
    return out | {"w2": down.T @ around, "b2": down.sum(0)}, down @ w["w2"]


class NeighbourhoodNetwork(Network):
    """Stored rows ``(node_id, a, goal, t)``: convolved projections, targets and weight in the loss."""

    name = "autoencoder"

    def __init__(self, nodes: DataFrame, edges: DataFrame, projection: np.ndarray, shares: tuple[float, float, float] = SHARES):
        self.parameters, self.shares, self.size = {}, shares, len(projection)
        train = F.coalesce(F.col("split") == "train", F.lit(False)) if "split" in nodes.columns else F.lit(True)
        n = nodes.where(train).count()
        self.fits = n > 0
        base = nodes.select("node_id", "x", F.when(train, 1.0 / max(n, 1)).otherwise(0.0).alias("t"))
        rows = durable(mapped(base, lambda b: stacked(b["x"], projection.shape[1]) @ projection.T, "p", ["node_id", "t"]))
        self.matrix = durable(normalised_adjacency(edges, nodes))
        around = messages(self.matrix, rows, "p", self.size).withColumnRenamed("p", "a")
        met = rows.join(around, "node_id").join(neighbourhoods(rows, edges, "p", self.size), "node_id")
        self.rows = durable(met.select("node_id", "a", F.concat("p", F.array("d"), "mu", "lv").alias("goal"), "t"))

    def first(self, hidden: int, seed: int) -> Weights:
        rng = np.random.default_rng(seed)
        w = {k: v for n in "12" for k, v in ((f"w{n}", glorot(rng, hidden, hidden)), (f"b{n}", np.zeros(hidden)))}
        w |= {k: v for h in "xmv" for n in "12" for k, v in ((f"{h}{n}", glorot(rng, hidden, hidden)), (f"{h}b{n}", np.zeros(hidden)))}
        return w | {"d": glorot(rng, 1, hidden)[0], "db": np.zeros(1)}

    def forward(self, w: Weights) -> DataFrame:
        size = self.size
        hidden = mapped(self.rows, lambda b: np.maximum(stacked(b["a"], size) @ w["w1"].T + w["b1"], 0), "m", ["node_id"])
        return self.rows.join(messages(self.matrix, hidden, "m", size), "node_id")

    def backward(self, w: Weights, out: DataFrame) -> tuple[float, Weights]:
        size, shares = self.size, self.shares
        at = lambda b: (stacked(b["m"], size), stacked(b["goal"], 3 * size + 1), b["t"].to_numpy())
        sent = mapped(out.where("t > 0"), lambda b: slopes(w, *at(b), shares)[1], "u", ["node_id"])
        come = messages(self.matrix, sent, "u", size, back=True)

        def part(b: pd.DataFrame) -> Weights:
            a = stacked(b["a"], size)
            first = filled(b["u"], size) * (a @ w["w1"].T + w["b1"] > 0)
            return slopes(w, *at(b), shares)[0] | {"w1": first.T @ a, "b1": first.sum(0)}

        return summed(out.join(come, "node_id", "left"), part, w)

    def losses(self, w: Weights) -> DataFrame:
        """``(node_id, s)``: every row's loss."""
        size = self.size

        def rebuilt(b: pd.DataFrame) -> np.ndarray:
            _, heads, degree = decoded(w, stacked(b["m"], size))
            return np.column_stack([heads["x"][1], degree, heads["m"][1], heads["v"][1]])

        cut = lambda c: F.struct(F.slice(c, 1, size).alias("x"), F.get(c, F.lit(size)).alias("d"), F.slice(c, size + 2, size).alias("mu"), F.slice(c, 2 * size + 2, size).alias("lv"))
        rows = mapped(self.forward(w), rebuilt, "o", ["node_id", "goal"]).select("node_id", cut("goal").alias("goal"), cut("o").alias("rebuilt"))
        return rows.select("node_id", neighbourhood_loss("goal", "rebuilt", self.shares).alias("s"))


@register("autoencoder")
class Autoencoder(Detector):
    """``fit`` on the rows whose split is train (all rows without that column), ``score`` any graph of equal width."""

    def __init__(self, hidden: int = 16, epochs: int = 200, rate: float = 0.01, decay: float = 0.0, shares: tuple[float, float, float] = SHARES, seed: int = 42, path: str | None = None):
        self.size, self.epochs, self.rate, self.decay = hidden, epochs, rate, decay
        self.shares, self.seed, self.path = tuple(shares), seed, path
        self.projection: np.ndarray | None = None
        self.run: Run | None = None

    def fit(self, nodes: DataFrame, edges: DataFrame) -> Autoencoder:
        top = nodes.select(F.size("x").alias("d")).first()
        self.projection = np.random.default_rng(self.seed).normal(0, 0.1, (self.size, top["d"] if top else 1))
        net = NeighbourhoodNetwork(nodes, edges, self.projection, self.shares)
        self.run = descend(net, net.first(self.size, self.seed), self.epochs if net.fits else 0, self.rate, self.decay, path=self.path)
        return self

    def score(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        if self.run is None:
            raise ValueError("fit the detector first")
        return NeighbourhoodNetwork(nodes, edges, self.projection, self.shares).losses(self.run.weights)
