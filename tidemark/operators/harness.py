"""One call from nodes to error rates, and sweeps of many such calls whose failures stay apart.

A cell of a sweep is a dictionary of parameters. Cells run one after the other on the
driver, each as Spark jobs; what they return is small and goes to the results table. A cell
that raises becomes a row with its reason, so that a sweep can be resumed and counted.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import durable
from ..functions.metrics import confusion, prediction_set, prediction_set_metrics, ranking_metrics
from .calibrate import Calibration, adaptive_threshold, cal_rows, dual_threshold, one_row, soft_threshold, split_threshold, weighted_threshold
from .detectors import Detector
from .graph import consistency, contrastive_consistency, propagate, structure_score
from .neighbours import knn_graph, undirected

METHODS = ("split", "propagated", "weighted", "adaptive", "soft", "dual")


def prepared(nodes: DataFrame, detector: Detector, edges: DataFrame | None = None, k: int = 10, weights: str = "contrastive", layers: int = 2, alpha: float = 0.5, smooth_first: bool = False) -> DataFrame:
    """Stored rows ``(node_id, y, split, is_novel, s, c)``: scores of the fitted detector and consistency by ``weights``.

    ``weights`` is contrastive, hyperedge or walk; ``smooth_first`` takes consistency from
    propagated vectors instead of raw ones.
    """
    from ..functions.vectors import long_form, wide_form

    knn = durable(knn_graph(nodes, k))
    graph = edges if edges is not None else durable(undirected(knn, "i", "j"))
    scores = durable(detector.fit(nodes, graph).score(nodes, graph))
    seen = nodes
    if smooth_first:
        smooth = wide_form(propagate(long_form(nodes), knn, layers, alpha))
        seen = durable(nodes.drop("x").join(smooth, "node_id"))
    if weights == "contrastive":
        c = contrastive_consistency(seen, knn)
    elif weights == "hyperedge":
        c = consistency(seen, knn, scores)
    elif weights == "walk":
        c = structure_score(graph, nodes, nodes.where("split = 'cal' AND y = 0").select("node_id"))
    else:
        raise ValueError(f"weights must be contrastive, hyperedge or walk, not {weights!r}")
    return durable(nodes.drop("x").join(scores, "node_id").join(c, "node_id"))


def evaluate(rows: DataFrame, method: str = "adaptive", p: Calibration = Calibration(weight_mode="contrastive", score_quantile=0.75), beta: float = 0.05) -> DataFrame:
    """One row: threshold, error rates on test rows, AUROC and average precision, and the false alarms on novel normals."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    test = rows.where("split = 'test'")
    rank = ranking_metrics(test.select("s", "y"))
    if method == "dual":
        both = one_row(test, dual_threshold(rows, p, beta)).withColumn("pred", prediction_set(F.col("s"), F.col("lambda_normal"), F.col("lambda_anomaly")))
        return prediction_set_metrics(both).crossJoin(F.broadcast(rank))
    if method in ("split", "propagated"):
        limit = split_threshold(cal_rows(rows), p.alpha)
    else:
        limit = {"weighted": weighted_threshold, "adaptive": adaptive_threshold, "soft": soft_threshold}[method](rows, p)
    alarms = one_row(test, limit.select("threshold"))
    alarm = F.col("s") > F.col("threshold")
    novel = alarms.where("is_novel AND y = 0").agg(F.avg(alarm.cast("double")).alias("novel_fpr"))
    return confusion(alarms, alarm, by=("threshold",)).crossJoin(F.broadcast(rank)).crossJoin(F.broadcast(novel))


def recalibrate(nodes: DataFrame, detector: Detector, method: str = "adaptive", edges: DataFrame | None = None, p: Calibration = Calibration(weight_mode="contrastive", score_quantile=0.75), **how) -> DataFrame:
    """Fit, score, weigh, threshold and evaluate in one call; ``propagated`` smooths vectors before they are scored."""
    if method == "propagated":
        from ..functions.vectors import long_form, wide_form

        knn = durable(knn_graph(nodes, how.get("k", 10)))
        nodes = durable(nodes.drop("x").join(wide_form(propagate(long_form(nodes), knn)), "node_id"))
    return evaluate(prepared(nodes, detector, edges, **how), method, p)


def grid(**values: Iterable) -> list[dict]:
    """All combinations of parameter values."""
    return [dict(zip(values, x)) for x in itertools.product(*values.values())]


def sweep(cells: list[dict], run: Callable[..., DataFrame], spark, metrics: tuple[str, ...] = ("fpr", "tpr", "auroc")) -> DataFrame:
    """``(cell, metric, value, reason)``: the wanted metrics of each cell; a cell that fails has one row with its reason."""
    out = []
    for cell in cells:
        name = ",".join(f"{k}={cell[k]}" for k in sorted(cell))
        try:
            row = run(**cell).first().asDict()
            out += [(name, m, None if row.get(m) is None else float(row[m]), None) for m in metrics if m in row]
        except Exception as error:  # noqa: BLE001  one cell's failure must not end the sweep
            out.append((name, None, None, f"{type(error).__name__}: {str(error).splitlines()[0][:200] if str(error) else ''}"))
    return spark.createDataFrame(out, "cell string, metric string, value double, reason string")


def reason_counts(results: DataFrame) -> DataFrame:
    """Failed cells by kind of reason."""
    return results.where("reason IS NOT NULL").groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def agreement_by_cut(rows: DataFrame, value: str, truth: str, cuts: list[float]) -> DataFrame:
    """For each cut the share of rows where ``value`` at or above it says what ``truth`` (0 or 1) says."""
    at = rows.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    return at.groupBy("cut").agg(F.avg(((F.col(value) >= F.col("cut")).cast("int") == F.col(truth)).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))
