"""Contrastive detector: a bilinear discriminator tells a node's own walks from those of another node.

A walk is a row of a matrix over nodes (visits over length), so contexts are messages over
that matrix, and the gradient of the encoder comes back through its transpose, as in
``training.py``. Each epoch reads the walks of one round; scoring goes through its rounds in
blocks, each reduced to one sum a node before the next. The other node is the one some
places further in hash order, a different distance in every round.

A score is the mean over rounds of the probability that another's walk is the node's own
less that of its own walk: larger is more anomalous.

Defined cases: a node without edges is its own context; fewer than two nodes have no other,
so nothing is learned and scores are 0; labels are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import durable
from ..functions.vectors import sigmoid
from .detectors import Detector, register
from .split import hash_rank
from .training import Run, Weights, adam, glorot, mapped, messages, stacked, summed
from .walks import sampled_walks


def walk_matrix(edges: DataFrame, nodes: DataFrame, rounds: int, length: int, restart: float, seed: int) -> DataFrame:
    """``(round, src, dst, w)``: the share of a walk's steps at each node it visits."""
    steps = sampled_walks(edges, nodes, length, rounds, restart, seed).where("step > 0")
    return steps.groupBy("round", F.col("node_id").alias("src"), F.col("visited").alias("dst")).agg((F.count(F.lit(1)) / length).alias("w"))


def others(ranked: DataFrame, n: int, shift: int) -> DataFrame:
    """``(node_id, other)``: the node ``1 + shift mod (n - 1)`` places further in hash order, never itself."""
    far = 1 + shift % (n - 1)
    return ranked.select("node_id", (F.pmod(F.col("rn") - 1 + far, F.lit(n)) + 1).alias("rn")).join(ranked.select(F.col("node_id").alias("other"), "rn"), "rn").select("node_id", "other")


class Pairs:
    """Nodes, their order and their walks, stored once."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, rounds: int, length: int, restart: float, seed: int):
        self.rows = durable(nodes.select("node_id", "x"))
        self.ranked = durable(hash_rank(self.rows.select("node_id"), "node_id", seed).select("node_id", "rn"))
        self.n = self.rows.count()
        top = self.rows.select(F.size("x").alias("d")).first()
        self.width = top["d"] if top else 1
        self.walks = durable(walk_matrix(edges, self.rows, rounds, length, restart, seed)) if self.n > 1 else None

    def hidden(self, w: Weights) -> DataFrame:
        width = self.width
        return mapped(self.rows, lambda b: np.maximum(stacked(b["x"], width) @ w["w"].T + w["b"], 0), "h", ["node_id"])

    def contexts(self, w: Weights, h: DataFrame, walks: DataFrame, at: int) -> DataFrame:
        """``(node_id, other, h, c, o)``: hidden vectors, own contexts and those of the other node."""
        c = messages(walks, h, "h", len(w["b"])).withColumnRenamed("h", "c")
        rows = h.join(c, "node_id").join(others(self.ranked, self.n, at), "node_id")
        return rows.join(c.select(F.col("node_id").alias("other"), F.col("c").alias("o")), "other")

    def gradient(self, w: Weights, at: int) -> tuple[float, Weights]:
        """Mean cross-entropy of both kinds of pairs in round ``at``, and its gradient."""
        walks, size, width, n = self.walks.where(F.col("round") == at).drop("round"), len(w["b"]), self.width, self.n
        seen = self.contexts(w, self.hidden(w), walks, at).persist()

        def slopes(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
            h, c, o = (stacked(b[k], size) for k in "hco")
            own, other = ((h @ w["mix"] * v).sum(1) + w["shift"][0] for v in (c, o))
            loss = (np.logaddexp(0, -own) + np.logaddexp(0, other)).sum() / (2 * n)
            return h, c, o, loss, (np.tanh(own / 2) - 1) / (4 * n), (np.tanh(other / 2) + 1) / (4 * n)

        def sends(b: pd.DataFrame) -> np.ndarray:
            h, c, o, _, g, k = slopes(b)
            up = h @ w["mix"]
            return np.hstack([(g[:, None] * c + k[:, None] * o) @ w["mix"].T, g[:, None] * up, k[:, None] * up])

        sent = mapped(seen, sends, "u", ["node_id", "other"])
        piece = lambda key, k: sent.select(F.col(key).alias("node_id"), F.slice("u", k * size + 1, size).alias("u"))
        # A context is met by its own node and by one other, so this sum has two rows a node.
        sums = piece("node_id", 1).unionAll(piece("other", 2)).groupBy("node_id").agg(*[F.sum(F.get("u", F.lit(i))).alias(f"v{i}") for i in range(size)])
        back = messages(walks, sums.select("node_id", F.array(*[f"v{i}" for i in range(size)]).alias("u")), "u", size, back=True)
        rows = self.rows.join(seen, "node_id").join(piece("node_id", 0).withColumnRenamed("u", "d"), "node_id").join(back, "node_id", "left")

        def part(b: pd.DataFrame) -> Weights:
            h, c, o, loss, g, k = slopes(b)
            down = np.array([np.zeros(size) if u is None else u for u in b["u"]], np.float64).reshape(-1, size)
            dh = (stacked(b["d"], size) + down) * (h > 0)
            return {"loss": loss, "w": dh.T @ stacked(b["x"], width), "b": dh.sum(0), "mix": h.T @ (g[:, None] * c + k[:, None] * o), "shift": np.array([g.sum() + k.sum()])}

        out = summed(rows, part, w)
        seen.unpersist()
        return out


@register("contrastive")
class Contrastive(Detector):
    """``fit`` learns encoder and discriminator on a graph without labels; ``score`` draws new walks."""

    def __init__(self, hidden: int = 64, epochs: int = 100, rate: float = 0.01, length: int = 4, restart: float = 0.3, rounds: int = 256, block: int = 16, train_rounds: int = 16, seed: int = 42):
        self.size, self.epochs, self.rate, self.length, self.restart = hidden, epochs, rate, length, restart
        self.rounds, self.block, self.train_rounds, self.seed = rounds, block, train_rounds, seed
        self.w: Weights | None = None
        self.losses: list[float] = []

    def first(self, width: int) -> Weights:
        rng = np.random.default_rng(self.seed)
        return {"w": glorot(rng, self.size, width), "b": np.zeros(self.size), "mix": glorot(rng, self.size, self.size), "shift": np.zeros(1)}

    def fit(self, nodes: DataFrame, edges: DataFrame) -> Contrastive:
        pairs = Pairs(nodes, edges, min(self.train_rounds, self.epochs) or 1, self.length, self.restart, self.seed)
        w = self.first(pairs.width)
        zeros = lambda: {k: np.zeros_like(a) for k, a in w.items()}
        run = Run(w, (zeros(), zeros()), w)
        while pairs.n > 1 and run.epoch < self.epochs:
            loss, gradient = pairs.gradient(run.weights, run.epoch % self.train_rounds)
            self.losses.append(loss)
            adam(run, gradient, self.rate)
        self.w = run.weights
        return self

    def score(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        if self.w is None:
            raise ValueError("fit the detector first")
        w, total = self.w, None
        for first in range(0, self.rounds, self.block):
            count = min(self.block, self.rounds - first)
            pairs = Pairs(nodes, edges, count, self.length, self.restart, self.seed + 1 + first)
            if pairs.n < 2:
                return nodes.select("node_id", F.lit(0.0).alias("s"))
            h, size = durable(pairs.hidden(w)), self.size
            met = pairs.walks.join(h.select(F.col("node_id").alias("dst"), "h"), "dst").groupBy("round", F.col("src").alias("node_id"))
            means = met.agg(*[F.sum(F.col("w") * F.get("h", F.lit(i))).alias(f"v{i}") for i in range(size)])
            c = durable(means.select("round", "node_id", F.array(*[f"v{i}" for i in range(size)]).alias("c")))
            # All rounds of a block as one join: the distance in hash order follows from the round.
            far = 1 + F.pmod(F.col("round") + first, F.lit(pairs.n - 1))
            own = c.join(h, "node_id").join(pairs.ranked, "node_id").withColumn("rn", F.pmod(F.col("rn") - 1 + far, F.lit(pairs.n)) + 1)
            both = own.join(c.join(pairs.ranked, "node_id").select("round", "rn", F.col("c").alias("o")), ["round", "rn"])

            def margins(b: pd.DataFrame, w: Weights = w, size: int = size) -> np.ndarray:
                up = stacked(b["h"], size) @ w["mix"]
                return np.stack([(up * stacked(b[k], size)).sum(1) + w["shift"][0] for k in "co"], axis=1)

            rated = mapped(both, margins, "m", ["node_id"]).select("node_id", (sigmoid(F.get("m", F.lit(1))) - sigmoid(F.get("m", F.lit(0)))).alias("s"))
            part = rated.groupBy("node_id").agg(F.sum("s").alias("s"))
            total = durable(part if total is None else part.unionAll(total).groupBy("node_id").agg(F.sum("s").alias("s")))
        return total.select("node_id", (F.col("s") / self.rounds).alias("s"))
