"""Detector with trained prompts: vectors are shifted by prompts, pooled, and classified; a graph path must agree.

A row's vector gets a sum of prompt vectors, each by its own sigmoid gate. The shifted vector
chooses among pool vectors by a softmax; their mixture is classified by one linear layer, and
the sigmoid of that is the score. Beside it two convolutions of the shifted vectors pass a
small head with a trained slope below zero, and its cosine to the neighbours' mixtures, over
the training normals, counts in the loss by ``agreement``: so prompts and pool learn from the
graph, while a score needs none.

The loss is the mean cross-entropy of the labelled training rows, anomalies by the ratio of
normals to anomalies (``least_ratio`` at least), less ``agreement`` times the mean cosine. An
epoch has two joins with the adjacency forward and two back (``training.py``); without
agreement it has none.

Defined cases: the adjacency counts neighbours once, in both directions, without loops, scaled
by both degrees; a node without neighbours has zero vectors there, and its cosine is that of
zeros, 0; without labelled training rows the first weights stay; null labels count for
messages only; an empty graph gives no scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import durable
from ..functions.vectors import sigmoid
from .detectors import Detector, register
from .neighbours import both_ways
from .training import Network, Run, Weights, cross_entropy, descend, filled, glorot, mapped, messages, stacked, summed

LEAST_NORM = 1e-8


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def pooled(w: Weights, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gates, shifted vectors, shares of the pool, mixtures and margins."""
    gate = _logistic(x @ w["gate"].T + w["gate_b"])
    shifted = x + gate @ w["prompts"]
    z = shifted @ w["pool"].T + w["pool_b"]
    share = np.exp(z - z.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    mix = share @ w["parts"]
    return gate, shifted, share, mix, mix @ w["side"] + w["side_b"][0]


def pooled_slopes(w: Weights, x: np.ndarray, dz: np.ndarray, more_shifted: np.ndarray, more_mix: np.ndarray) -> Weights:
    """Gradients of all that ``pooled`` uses, from those of margins and, from the graph, of shifted vectors and mixtures."""
    gate, shifted, share, mix, _ = pooled(w, x)
    dmix = dz[:, None] * w["side"] + more_mix
    dshare = dmix @ w["parts"].T
    dpool = share * (dshare - (share * dshare).sum(1, keepdims=True))
    dshifted = dpool @ w["pool"] + more_shifted
    dgate = (dshifted @ w["prompts"].T) * gate * (1 - gate)
    return {
        "side": dz @ mix, "side_b": np.array([dz.sum()]), "parts": share.T @ dmix, "pool": dpool.T @ shifted, "pool_b": dpool.sum(0),
        "prompts": gate.T @ dshifted, "gate": dgate.T @ x, "gate_b": dgate.sum(0),
    }


def cosines(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosine of each pair of rows, and its slopes by both."""
    p, q = (np.maximum(np.linalg.norm(v, axis=1), LEAST_NORM)[:, None] for v in (a, b))
    c = (a * b).sum(1, keepdims=True) / (p * q)
    return c[:, 0], b / (p * q) - c * a / p**2, a / (p * q) - c * b / q**2


def agreement_slopes(w: Weights, h: np.ndarray, near: np.ndarray, share: np.ndarray) -> tuple[float, Weights, np.ndarray, np.ndarray]:
    """Weighted loss of the rows' cosines, gradients of the head, and of both sides' messages."""
    z = h @ w["head1"].T + w["head_b1"]
    slope = np.where(z > 0, 1.0, w["bend"][0])
    middle = z * slope
    c, da, db = cosines(middle @ w["head2"].T + w["head_b2"], near)
    da, db = -share[:, None] * da, -share[:, None] * db
    dmiddle = da @ w["head2"]
    dhead = dmiddle * slope
    out = {
        "head2": da.T @ middle, "head_b2": da.sum(0), "head1": dhead.T @ h, "head_b1": dhead.sum(0),
        "bend": np.array([(dmiddle * np.minimum(z, 0)).sum()]),
    }
    return -(share * c).sum(), out, dhead @ w["head1"], db


class PromptNetwork(Network):
    """Stored rows ``(node_id, x, y, t, a)``: label, weight in the cross-entropy and weight in the agreement."""

    name = "prompts"

    def __init__(self, nodes: DataFrame, edges: DataFrame, prompts: int = 10, size: int = 64, agreement: float = 0.05, least_ratio: float = 5.0):
        self.parameters, self.prompts, self.size, self.agreement = {}, prompts, size, agreement
        train = F.coalesce((F.col("split") == "train") & F.col("y").isNotNull(), F.lit(False))
        n = nodes.where(train).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).first()
        self.fits = n["pos"] + n["neg"] > 0
        total, ratio = max(n["pos"] + n["neg"], 1), max(least_ratio, n["neg"] / max(n["pos"], 1))
        weight = F.when(train, F.when(F.col("y") == 1, ratio / total).otherwise(1 / total)).otherwise(0.0)
        agrees = F.when(train & (F.col("y") == 0), agreement / max(n["neg"], 1)).otherwise(0.0)
        self.rows = durable(nodes.select("node_id", "x", F.coalesce("y", F.lit(0)).cast("double").alias("y"), weight.alias("t"), agrees.alias("a")))
        top = self.rows.select(F.size("x").alias("d")).first()
        self.width = top["d"] if top else 1
        ways = both_ways(edges).where("src <> dst").distinct()
        degrees = ways.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        scaled = ways.join(degrees, "src").join(degrees.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst")
        self.matrix = durable(scaled.select("src", "dst", (1 / F.sqrt(F.col("n") * F.col("m"))).alias("w")))

    def first(self, hidden: int, seed: int) -> Weights:
        rng, d, k, e = np.random.default_rng(seed), self.width, self.prompts, self.size
        return {
            "gate": glorot(rng, k, d), "gate_b": np.zeros(k), "prompts": glorot(rng, k, d), "pool": glorot(rng, k, d), "pool_b": np.zeros(k), "parts": glorot(rng, k, e),
            "side": glorot(rng, 1, e)[0], "side_b": np.zeros(1), "w1": glorot(rng, hidden, d), "w2": glorot(rng, e, hidden), "near": glorot(rng, e, e),
            "head1": glorot(rng, hidden, e), "head_b1": np.zeros(hidden), "head2": glorot(rng, e, hidden), "head_b2": np.zeros(e), "bend": np.array([0.25]),
        }

    def forward(self, w: Weights) -> DataFrame:
        """Rows with ``m``, the first convolution beside the neighbours' mixtures, and ``h``, the second."""
        if not self.agreement:
            return self.rows
        d, hidden, e = self.width, len(w["w1"]), self.size

        def sent(b: pd.DataFrame) -> np.ndarray:
            _, shifted, _, mix, _ = pooled(w, stacked(b["x"], d))
            return np.hstack([shifted @ w["w1"].T, mix @ w["near"].T])

        one = messages(self.matrix, mapped(self.rows, sent, "m", ["node_id"]), "m", hidden + e)
        two = messages(self.matrix, mapped(one, lambda b: np.maximum(stacked(b["m"], hidden + e)[:, :hidden], 0) @ w["w2"].T, "h", ["node_id"]), "h", e)
        return self.rows.join(one, "node_id", "left").join(two, "node_id", "left")

    def backward(self, w: Weights, out: DataFrame) -> tuple[float, Weights]:
        d, hidden, e, graph = self.width, len(w["w1"]), self.size, bool(self.agreement)
        apart = {k: v for k, v in w.items() if graph or k in ("gate", "gate_b", "prompts", "pool", "pool_b", "parts", "side", "side_b")}
        met = lambda b: agreement_slopes(w, filled(b["h"], e), filled(b["m"], hidden + e)[:, hidden:], b["a"].to_numpy())
        rows = out
        if graph:
            # Of the second convolution, then with its result of the first, beside the mixtures.
            ends = mapped(out.where("a > 0"), lambda b: np.hstack(met(b)[2:]), "u", ["node_id"])
            second = messages(self.matrix, ends.select("node_id", F.slice("u", 1, e).alias("v")), "v", e, back=True)
            both = out.select("node_id", "m").join(second, "node_id", "left").join(ends, "node_id", "left").where("v IS NOT NULL OR u IS NOT NULL")

            def down(b: pd.DataFrame) -> np.ndarray:
                first = (filled(b["v"], e) @ w["w2"]) * (filled(b["m"], hidden + e)[:, :hidden] > 0)
                return np.hstack([first, filled(b["u"], 2 * e)[:, e:]])

            come = messages(self.matrix, mapped(both, down, "g", ["node_id"]), "g", hidden + e, back=True)
            rows = out.join(second, "node_id", "left").join(come, "node_id", "left")

        def part(b: pd.DataFrame) -> Weights:
            x = stacked(b["x"], d)
            _, shifted, _, mix, z = pooled(w, x)
            loss, dz = cross_entropy(z, b["y"].to_numpy(), b["t"].to_numpy())
            if not graph:
                return {"loss": loss.sum(), **pooled_slopes(w, x, dz, np.zeros_like(x), np.zeros_like(mix))}
            g, v = filled(b["g"], hidden + e), filled(b["v"], e)
            cost, head, _, _ = met(b)
            first = np.maximum(filled(b["m"], hidden + e)[:, :hidden], 0)
            own = {"w1": g[:, :hidden].T @ shifted, "near": g[:, hidden:].T @ mix, "w2": v.T @ first}
            return {"loss": loss.sum() + cost, **head, **own, **pooled_slopes(w, x, dz, g[:, :hidden] @ w["w1"], g[:, hidden:] @ w["near"])}

        loss, gradient = summed(rows, part, apart)
        return loss, {k: gradient.get(k, np.zeros_like(a)) for k, a in w.items()}


@register("prompts")
class Prompts(Detector):
    """``fit`` on labelled rows whose split is train; ``score`` needs vectors only."""

    def __init__(
        self, prompts: int = 10, hidden: int = 64, size: int = 64, epochs: int = 30, rate: float = 1e-3, decay: float = 5e-4,
        agreement: float = 0.05, least_ratio: float = 5.0, seed: int = 42, path: str | None = None,
    ):
        self.prompts, self.hidden, self.size, self.epochs, self.rate, self.decay = prompts, hidden, size, epochs, rate, decay
        self.agreement, self.least_ratio, self.seed, self.path = agreement, least_ratio, seed, path
        self.run: Run | None = None

    def fit(self, nodes: DataFrame, edges: DataFrame) -> Prompts:
        net = PromptNetwork(nodes, edges, self.prompts, self.size, self.agreement, self.least_ratio)
        self.run = descend(net, net.first(self.hidden, self.seed), self.epochs if net.fits else 0, self.rate, self.decay, path=self.path)
        return self

    def score(self, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        if self.run is None:
            raise ValueError("fit the detector first")
        w = self.run.weights
        z = mapped(nodes.select("node_id", "x"), lambda b: pooled(w, stacked(b["x"], w["gate"].shape[1]))[-1][:, None], "z", ["node_id"])
        return z.select("node_id", sigmoid(F.get("z", F.lit(0))).alias("s"))
