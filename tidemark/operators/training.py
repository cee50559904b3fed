"""Training of the graph networks on Spark: reverse mode over joins.

Messages go forward as a join with the adjacency and a sum by receiver, and their gradients
come back as the same join and sum with both ends exchanged. Dense layers and their
derivatives are matrix products on the Arrow batches of a task, which adds up its part of
the weights' gradient; parts are summed by weight in a shuffle. The driver sees one number a
weight, takes the step (Adam) and starts the next round's plan anew from the stored inputs,
so lineage does not grow and a lost executor costs the round's lost tasks.

The loss is the class-weighted cross-entropy of the training rows: weight 1 for normals,
normals over anomalies for anomalies. A hash-chosen fold of the training rows is left out of
the loss and rates the weights by AUROC; the best ones are kept.

Defined cases: rows whose label is null count for messages only; without anomalies, their
weight is the number of normals; a fold without both classes rates by the loss; without
training rows, the first weights stay.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import durable
from ..functions.metrics import ranking_metrics
from ..functions.vectors import hash_uniform, sigmoid
from .detectors import Detector, beta_polynomials, build, normalised_adjacency

Weights = dict[str, np.ndarray]
#: All numbers of a training run, by epoch; the header is the row without a shape.
STATE = "epoch int, name string, shape array<int>, values array<double>"


def messages(matrix: DataFrame, rows: DataFrame, value: str, width: int, back: bool = False) -> DataFrame:
    """``(node_id, value)``: the product of a matrix ``(src, dst, w)``, or of its transpose, with vectors of equal width."""
    to, at = ("dst", "src") if back else ("src", "dst")
    met = matrix.join(rows.select(F.col("node_id").alias(at), value), at)
    sums = met.groupBy(F.col(to).alias("node_id")).agg(*[F.sum(F.col("w") * F.get(value, F.lit(i))).alias(f"v{i}") for i in range(width)])
    return sums.select("node_id", F.array(*[f"v{i}" for i in range(width)]).alias(value))


def stacked(values: pd.Series, width: int) -> np.ndarray:
    return np.array(values.tolist(), np.float64).reshape(len(values), width)


def mapped(rows: DataFrame, layer: Callable[[pd.DataFrame], np.ndarray], name: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the vectors that ``layer`` makes of each batch."""
    kept = rows.select(*keep).schema
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), f"{name} array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[keep].assign(**{name: list(layer(b))})

    return rows.mapInPandas(run, schema)


def summed(rows: DataFrame, part: Callable[[pd.DataFrame], Weights], like: Weights) -> tuple[float, Weights]:
    """``loss`` and gradients, each the sum of the tasks' parts; one row a weight reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + sum(a.size for a in like.values()))
        for b in batches:
            if len(b):
                got = part(b)
                total += np.concatenate([[got["loss"]], *(got[k].ravel() for k in like)])
        yield pd.DataFrame({"k": np.arange(len(total), dtype=np.int32), "val": total})

    flat = np.zeros(1 + sum(a.size for a in like.values()))
    for r in rows.mapInPandas(run, "k int, val double").groupBy("k").agg(F.sum("val").alias("val")).collect():
        flat[r["k"]] = r["val"]
    out, at = {}, 1
    for k, a in like.items():
        out[k] = flat[at : at + a.size].reshape(a.shape)
        at += a.size
    return float(flat[0]), out


def cross_entropy(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses and their derivatives by the margin ``z`` of the anomalous class."""
    return w * np.logaddexp(0, np.where(y > 0, -z, z)), w * (0.5 * (1 + np.tanh(z / 2)) - y)


def labelled(nodes: DataFrame, hold: float, seed: int) -> DataFrame:
    """``(node_id, x, y, t, fold)``: ``t`` is the weight in the loss (all together 1; 0 outside), ``fold`` marks the rating rows."""
    train = (F.col("split") == "train") & F.col("y").isNotNull()
    rows = nodes.withColumn("fold", F.coalesce(train, F.lit(False)) & (hash_uniform("node_id", F.lit(seed)) < hold)).withColumn("fit", F.coalesce(train, F.lit(False)) & ~F.col("fold"))
    n = rows.agg(F.count_if(F.col("fit") & (F.col("y") == 1)).alias("pos"), F.count_if(F.col("fit") & (F.col("y") == 0)).alias("neg")).first()
    ratio = n["neg"] / max(n["pos"], 1)
    total = n["neg"] + ratio * n["pos"] or 1.0
    weight = F.when(F.col("fit"), F.when(F.col("y") == 1, ratio / total).otherwise(1.0 / total)).otherwise(0.0)
    return rows.select("node_id", "x", F.coalesce("y", F.lit(0)).cast("double").alias("y"), weight.alias("t"), "fold")


def filled(values: pd.Series, width: int) -> np.ndarray:
    """Vectors of a column as rows; a null is a row of zeros."""
    return np.array([np.zeros(width) if v is None else v for v in values], np.float64).reshape(len(values), width)


def glorot(rng: np.random.Generator, out: int, into: int) -> np.ndarray:
    return rng.uniform(-1, 1, (out, into)) * np.sqrt(6 / (out + into))


class Network(ABC):
    """Stored inputs of one graph, a forward pass that ends in ``z`` a node, and the gradient of the loss."""

    name: str
    parameters: dict
    rows: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    @abstractmethod
    def first(self, hidden: int, seed: int) -> Weights: ...

    @abstractmethod
    def forward(self, w: Weights) -> DataFrame:
        """``(node_id, y, t, fold, z)`` and what the way back needs."""

    @abstractmethod
    def backward(self, w: Weights, out: DataFrame) -> tuple[float, Weights]: ...


class ConvolutionNetwork(Network):
    """Two convolutions: A relu(A (x W1' + b1)) W2' + ...

    The features' own product with A is made once; an epoch sends one margin a node forward
    and one number a node back, whatever the widths.
    """

    name = "convolution"

    def __init__(self, nodes: DataFrame, edges: DataFrame, hold: float, seed: int):
        self.parameters = {}
        rows = labelled(nodes, hold, seed)
        top = rows.select(F.size("x").alias("d")).first()
        self.width = top["d"] if top else 1
        self.matrix = durable(normalised_adjacency(edges, nodes))
        # The last entry, from a constant input of one, carries the bias.
        around = messages(self.matrix, rows.select("node_id", F.concat("x", F.array(F.lit(1.0))).alias("a")), "a", self.width + 1)
        self.rows = durable(rows.drop("x").join(around, "node_id"))

    def first(self, hidden: int, seed: int) -> Weights:
        rng = np.random.default_rng(seed)
        return {"w1": glorot(rng, hidden, self.width), "b1": np.zeros(hidden), "w2": glorot(rng, 2, hidden), "b2": np.zeros(2)}

    def forward(self, w: Weights) -> DataFrame:
        width, joint = self.width + 1, np.column_stack([w["w1"], w["b1"]])
        side, shift = w["w2"][1] - w["w2"][0], w["b2"][1] - w["b2"][0]
        margin = mapped(self.rows, lambda b: (np.maximum(stacked(b["a"], width) @ joint.T, 0) @ side + shift)[:, None], "z", ["node_id"])
        got = messages(self.matrix, margin, "z", 1).select("node_id", F.get("z", F.lit(0)).alias("z"))
        return self.rows.drop("a").join(got, "node_id")

    def backward(self, w: Weights, out: DataFrame) -> tuple[float, Weights]:
        width, joint, side = self.width + 1, np.column_stack([w["w1"], w["b1"]]), w["w2"][1] - w["w2"][0]
        slope = out.where("t > 0").select("node_id", F.array(F.col("t") * (sigmoid(F.col("z")) - F.col("y"))).alias("g"))
        come = messages(self.matrix, slope, "g", 1, back=True).select("node_id", F.get("g", F.lit(0)).alias("g"))
        rows = self.rows.select("node_id", "a").join(come, "node_id", "left").join(out.select("node_id", "y", "t", "z"), "node_id")

        def part(b: pd.DataFrame) -> Weights:
            a, g = stacked(b["a"], width), b["g"].fillna(0.0).to_numpy()
            before = a @ joint.T
            up = g @ np.maximum(before, 0)
            first = ((g[:, None] * side) * (before > 0)).T @ a
            loss, _ = cross_entropy(b["z"].to_numpy(), b["y"].to_numpy(), b["t"].to_numpy())
            return {"loss": loss.sum(), "w1": first[:, :-1], "b1": first[:, -1], "w2": np.stack([-up, up]), "b2": np.array([-g.sum(), g.sum()])}

        return summed(rows, part, w)


def wavelet_head(c: np.ndarray, w: Weights, powers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bands ``(band, node, hidden)``, their filtered form, the third layer and the margins."""
    z = np.einsum("pk,nkh->pnh", c, powers)
    f = np.stack([z[p] @ w[f"f{p}"].T + w[f"fb{p}"] for p in range(len(c))])
    cat = np.concatenate(list(np.maximum(f, 0)), axis=1)
    third = cat @ w["w3"].T + w["b3"]
    return z, f, cat, third, np.maximum(third, 0) @ (w["w4"][1] - w["w4"][0]) + w["b4"][1] - w["b4"][0]


def wavelet_slopes(c: np.ndarray, w: Weights, b: pd.DataFrame) -> tuple[Weights, np.ndarray]:
    """Gradients of the layers above the filters, and of the powers ``(node, power, hidden)``."""
    hidden, bands = len(w["b2"]), len(c)
    powers = stacked(b["s"], bands * hidden).reshape(-1, bands, hidden)
    z, f, cat, third, margin = wavelet_head(c, w, powers)
    loss, g = cross_entropy(margin, b["y"].to_numpy(), b["t"].to_numpy())
    up = g @ np.maximum(third, 0)
    d3 = g[:, None] * (w["w4"][1] - w["w4"][0]) * (third > 0)
    dcat = d3 @ w["w3"]
    out = {"loss": loss.sum(), "w4": np.stack([-up, up]), "b4": np.array([-g.sum(), g.sum()]), "w3": d3.T @ cat, "b3": d3.sum(0)}
    dz = np.empty_like(z)
    for p in range(bands):
        df = dcat[:, p * hidden : (p + 1) * hidden] * (f[p] > 0)
        out |= {f"f{p}": df.T @ z[p], f"fb{p}": df.sum(0)}
        dz[p] = df @ w[f"f{p}"]
    return out, np.einsum("pk,pnh->nkh", c, dz)


class WaveletNetwork(Network):
    """Two dense layers, a filter and a dense layer for each band, two dense layers.

    Forward: powers of L = 1 - A applied to the hidden vectors. Back: the bands' gradients
    are gathered by power and come down by Horner's rule through the transpose of L.
    """

    name = "wavelet"

    def __init__(self, nodes: DataFrame, edges: DataFrame, hold: float, seed: int, degree: int = 2):
        self.parameters, self.degree = {"degree": degree}, degree
        self.coefficients = np.array([c + [0.0] * (degree + 1 - len(c)) for c in beta_polynomials(degree)])
        adjacency = normalised_adjacency(edges, nodes)
        self.matrix = durable(adjacency.select("src", "dst", (F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0) - F.col("w")).alias("w")))
        self.rows = durable(labelled(nodes, hold, seed))
        top = self.rows.select(F.size("x").alias("d")).first()
        self.width = top["d"] if top else 1

    def first(self, hidden: int, seed: int) -> Weights:
        rng, bands = np.random.default_rng(seed), self.degree + 1
        shapes = {"1": (hidden, self.width), "2": (hidden, hidden), "3": (hidden, hidden * bands), "4": (2, hidden)}
        w = {k: v for n, s in shapes.items() for k, v in ((f"w{n}", glorot(rng, *s)), (f"b{n}", np.zeros(s[0])))}
        return w | {k: v for p in range(bands) for k, v in ((f"f{p}", glorot(rng, hidden, hidden)), (f"fb{p}", np.zeros(hidden)))}

    def forward(self, w: Weights) -> DataFrame:
        width, hidden, bands, c = self.width, len(w["b2"]), self.degree + 1, self.coefficients
        power = mapped(self.rows, lambda b: np.maximum(np.maximum(stacked(b["x"], width) @ w["w1"].T + w["b1"], 0) @ w["w2"].T + w["b2"], 0), "h", ["node_id"])
        rows = self.rows.join(power.withColumnRenamed("h", "s"), "node_id")
        for _ in range(self.degree):
            power = messages(self.matrix, power, "h", hidden)
            rows = rows.join(power, "node_id").withColumn("s", F.concat("s", "h")).drop("h")
        out = mapped(rows, lambda b: wavelet_head(c, w, stacked(b["s"], bands * hidden).reshape(-1, bands, hidden))[-1][:, None], "z", ["node_id", "x", "y", "t", "fold", "s"])
        return out.withColumn("z", F.get("z", F.lit(0)))

    def backward(self, w: Weights, out: DataFrame) -> tuple[float, Weights]:
        width, hidden, c = self.width, len(w["b2"]), self.coefficients
        # Only rows of the loss have a gradient here; all others receive theirs by messages.
        parts = mapped(out.where("t > 0"), lambda b: wavelet_slopes(c, w, b)[1].reshape(len(b), -1), "u", ["node_id"])
        at = lambda k: parts.select("node_id", F.slice("u", k * hidden + 1, hidden).alias("u"))
        down = at(self.degree)
        for k in range(self.degree - 1, -1, -1):
            come = messages(self.matrix, down, "u", hidden, back=True).withColumnRenamed("u", "m")
            own = at(k)
            add = F.when(F.col("u").isNull(), F.col("m")).when(F.col("m").isNull(), F.col("u")).otherwise(F.zip_with("u", "m", lambda p, q: p + q))
            down = come.join(own, "node_id", "full").select("node_id", add.alias("u"))

        def part(b: pd.DataFrame) -> Weights:
            x = stacked(b["x"], width)
            one = x @ w["w1"].T + w["b1"]
            two = np.maximum(one, 0) @ w["w2"].T + w["b2"]
            dh = np.array([np.zeros(hidden) if u is None else u for u in b["u"]], np.float64).reshape(-1, hidden)
            d2 = dh * (two > 0)
            d1 = (d2 @ w["w2"]) * (one > 0)
            return wavelet_slopes(c, w, b)[0] | {"w2": d2.T @ np.maximum(one, 0), "b2": d2.sum(0), "w1": d1.T @ x, "b1": d1.sum(0)}

        return summed(out.select("node_id", "x", "y", "t", "s").join(down, "node_id", "left"), part, w)


@dataclass
class Run:
    """Weights, moments and the best weights so far."""

    weights: Weights
    moments: tuple[Weights, Weights]
    best: Weights
    epoch: int = 0
    rating: float = float("-inf")
    history: list[tuple[int, float, float | None]] = field(default_factory=list)


def _zeros(w: Weights) -> Weights:
    return {k: np.zeros_like(a) for k, a in w.items()}


def adam(run: Run, gradient: Weights, rate: float, decay: float = 0.0) -> None:
    """One step in place, with decay of the weights added to the gradient."""
    run.epoch += 1
    for k, g in gradient.items():
        g = g + decay * run.weights[k]
        m, v = run.moments[0][k], run.moments[1][k]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        run.weights[k] = run.weights[k] - rate * (m / (1 - 0.9**run.epoch)) / (np.sqrt(v / (1 - 0.999**run.epoch)) + 1e-8)


def store_run(spark: SparkSession, run: Run, path: str) -> None:
    """Append the state after an epoch as one file."""
    sets = {"weights": run.weights, "first": run.moments[0], "second": run.moments[1], "best": run.best}
    head = json.dumps({"rating": run.rating if np.isfinite(run.rating) else None, "history": run.history})
    rows = [(run.epoch, head, None, None), *((run.epoch, f"{s}/{k}", list(a.shape), a.ravel().tolist()) for s, w in sets.items() for k, a in w.items())]
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("append").parquet(path)


def stored_run(spark: SparkSession, path: str) -> Run | None:
    """The state of the last stored epoch; none if nothing is stored there."""
    try:
        rows = spark.read.schema(STATE).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    last = rows.agg(F.max("epoch")).first()[0]
    if last is None:
        return None
    sets: dict[str, Weights] = {"weights": {}, "first": {}, "second": {}, "best": {}}
    head: dict = {}
    for r in rows.where(F.col("epoch") == last).collect():
        if r["shape"] is None:
            head = json.loads(r["name"])
        else:
            of, name = r["name"].split("/")
            sets[of][name] = np.array(r["values"]).reshape(r["shape"])
    rating = float("-inf") if head["rating"] is None else head["rating"]
    return Run(sets["weights"], (sets["first"], sets["second"]), sets["best"], last, rating, [tuple(h) for h in head["history"]])


def descend(net: Network, start: Weights, epochs: int, rate: float, decay: float = 0.0, check: int = 10, path: str | None = None) -> Run:
    """A run of ``epochs`` steps that keeps the last weights; ``history`` holds every epoch's loss.

    With ``path`` the state is stored after every ``check`` epochs and after the last, and a
    later call with the same path goes on from it.
    """
    run = stored_run(net.spark, path) if path else None
    if run is None:
        run = Run(dict(start), (_zeros(start), _zeros(start)), dict(start))
    while run.epoch < epochs:
        out = net.forward(run.weights).persist()
        loss, gradient = net.backward(run.weights, out)
        adam(run, gradient, rate, decay)
        out.unpersist()
        run.best = run.weights
        run.history.append((run.epoch, loss, None))
        if path and (run.epoch % check == 0 or run.epoch == epochs):
            store_run(net.spark, run, path)
    return run


def train(
    name: str, nodes: DataFrame, edges: DataFrame, hidden: int = 64, epochs: int = 100, rate: float = 0.01, decay: float = 0.0,
    hold: float = 0.2, check: int = 10, seed: int = 42, degree: int = 2, path: str | None = None,
) -> tuple[Detector, Run]:
    """A detector (``wavelet`` or ``convolution``) with the best rated weights, and the run's record.

    Weights are rated after every ``check`` epochs and after the last. With ``path`` the state
    is stored then, and a later call with the same path goes on from it.
    """
    spark = nodes.sparkSession
    kinds = {"wavelet": lambda: WaveletNetwork(nodes, edges, hold, seed, degree), "convolution": lambda: ConvolutionNetwork(nodes, edges, hold, seed)}
    if name not in kinds:
        raise KeyError(f"no network {name!r}; known: {sorted(kinds)}")
    net = kinds[name]()
    run = stored_run(spark, path) if path else None
    if run is None:
        w = net.first(hidden, seed)
        run = Run(w, (_zeros(w), _zeros(w)), dict(w))
    order = sorted(net.first(len(run.weights["b1"]), seed))
    run.weights = {k: run.weights[k] for k in order}
    has_rows = net.rows.where("t > 0").limit(1).count() > 0
    while has_rows and run.epoch < epochs:
        out = net.forward(run.weights).persist()
        loss, gradient = net.backward(run.weights, out)
        adam(run, gradient, rate, decay)
        out.unpersist()
        if run.epoch % check == 0 or run.epoch == epochs:
            rated = net.forward(run.weights).where("fold").select(F.col("z").alias("s"), "y")
            row = ranking_metrics(rated).first()
            auroc = row["auroc"] if row else None
            rating = -loss if auroc is None else auroc
            run.history.append((run.epoch, loss, auroc))
            if rating > run.rating:
                run.rating, run.best = rating, dict(run.weights)
            if path:
                store_run(spark, run, path)
    return build(net.name, weights=run.best, **net.parameters), run
