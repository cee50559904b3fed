"""Binary decision and ranking metrics as single aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distribution import running


def confusion(rows: DataFrame, alarm: Column, label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Counts and FPR, TPR, precision, F1; denominators are 1 at least."""
    y = F.col(label)
    counted = rows.groupBy(*by).agg(
        F.count_if(alarm & (y == 1)).alias("tp"), F.count_if(alarm & (y == 0)).alias("fp"),
        F.count_if(~alarm & (y == 1)).alias("fn"), F.count_if(~alarm & (y == 0)).alias("tn"),
    )
    one = lambda c: F.greatest(c, F.lit(1))
    precision, tpr = F.col("tp") / one(F.col("tp") + F.col("fp")), F.col("tp") / one(F.col("tp") + F.col("fn"))
    return counted.select(
        *by, "tp", "fp", "fn", "tn",
        (F.col("fp") / one(F.col("fp") + F.col("tn"))).alias("fpr"), tpr.alias("tpr"), precision.alias("precision"),
        (2 * precision * tpr / F.greatest(precision + tpr, F.lit(1e-12))).alias("f1"),
    )


def prediction_set(score: Column, low: Column, high: Column) -> Column:
    """1 anomaly, 0 normal, 2 both (abstain)."""
    return F.when((score >= high) & (score > low), 1).when((score <= low) & (score < high), 0).otherwise(2)


def prediction_set_metrics(rows: DataFrame, pred: str = "pred", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Error rates, abstention, and rates among the decided; null where nothing was decided."""
    p, y = F.col(pred), F.col(label)
    n = {k: F.count_if(y == k) for k in (0, 1)}
    kept = {k: F.count_if((p != 2) & (y == k)) for k in (0, 1)}
    one = lambda c: F.greatest(c, F.lit(1))
    return rows.groupBy(*by).agg(
        (F.count_if((y == 0) & (p == 1)) / one(n[0])).alias("fpr"), (F.count_if((y == 1) & (p == 0)) / one(n[1])).alias("fnr"),
        (F.count_if((y == 1) & (p == 1)) / one(n[1])).alias("tpr"), F.avg((p == 2).cast("double")).alias("abstain_rate"),
        F.try_divide(F.count_if((y == 0) & (p == 1)), kept[0]).alias("fpr_decided"), F.try_divide(F.count_if((y == 1) & (p == 1)), kept[1]).alias("tpr_decided"),
        F.count(F.lit(1)).alias("n"),
    )


def ranking_metrics(rows: DataFrame, score: str = "s", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """``(auroc, ap)`` by ties-averaged ranks and by precision over distinct thresholds, in one pass over distinct scores."""
    per_score = rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    seen = running(per_score, "v", ["n", "pos"], by)
    mid_rank = F.col("cum_n") - (F.col("n") - 1) / 2
    above = F.col("all_n") - F.col("cum_n") + F.col("n")
    pos_above = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    found = seen.groupBy(*by).agg(
        F.sum(F.col("pos") * mid_rank).alias("ranks"), F.max("all_n").alias("n"), F.max("all_pos").alias("n1"),
        F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * pos_above / above).alias("ap"),
    )
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return found.select(*by, F.try_divide(F.col("ranks") - n1 * (n1 + 1) / 2, n1 * n0).alias("auroc"), F.when(n1 > 0, F.col("ap")).alias("ap"))


def effective_size(weight: str | Column) -> Column:
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.pow(F.sum(w), 2) / F.sum(w * w)
