"""State that streams keep between batches: drift by key, pooled error counts, and batches judged by calibration rows alone.

``window_drift`` holds sums of open windows and of all closed ones for each key. Rows only
add to sums, so neither their order nor their batches matter. An event-time timer closes a
window once the watermark has passed its end: the window is compared with what was closed
before it, then joins that. State is a row for a key and one for each open window.

``inductive_rows`` gives streamed nodes a consistency from their neighbours among the
calibration rows, so nothing of the batch or of later ones is seen; ``alarms_by_batch`` takes the
thresholds of all batches in one plan, each from the calibration rows and its own.

Defined cases: rows behind the watermark are dropped; null values are not counted; the first
window of a key and one behind constant values have no deviation (null); a key without rows
for a while keeps its closed sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.metrics import confusion
from ..operators.calibrate import Calibration
from ..operators.graph import contrastive_consistency
from ..operators.neighbours import nearest
from ..operators.sweeps import thresholds

#: Streams with timers need this store of state.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = ["window_start", "n", "mean", "deviation"]


class WindowDrift(StatefulProcessor):
    """Closes windows of ``length`` seconds and compares each with all before it."""

    def __init__(self, key: str, length: int):
        self.key, self.length = key, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "n long, total double, squares double")
        self.open = handle.getMapState("open", "start long", "n long, total double, squares double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for part in rows:
            part = part[part["value"].notna()]
            for second, v in zip(part["second"].tolist(), part["value"].tolist()):
                start = second // self.length * self.length
                s = sums.setdefault(start, [0, 0.0, 0.0])
                s[0], s[1], s[2] = s[0] + 1, s[1] + v, s[2] + v * v
        for start, s in sums.items():
            if self.open.containsKey((start,)):
                s = [a + b for a, b in zip(s, self.open.getValue((start,)))]
            else:
                self.handle.registerTimer((start + self.length) * 1000)
            self.open.updateValue((start,), (int(s[0]), float(s[1]), float(s[2])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() // 1000
        due = sorted((k[0], tuple(v)) for k, v in self.open.iterator() if k[0] + self.length <= end)
        out = []
        for start, (n, total, squares) in due:
            before = self.closed.get() if self.closed.exists() else (0, 0.0, 0.0)
            out.append((key[0], start, n, total / n, deviation(n, total, *before)))
            self.closed.update(tuple(a + b for a, b in zip(before, (n, total, squares))))
            self.open.removeKey((start,))
        if out:
            yield pd.DataFrame(out, columns=[self.key, *_OUT])

    def close(self) -> None:
        pass


def deviation(n: int, total: float, before_n: int, before: float, squares: float) -> float | None:
    """A window's mean against the earlier mean, in standard errors."""
    if before_n < 2:
        return None
    spread = (squares - before * before / before_n) / (before_n - 1)
    return (total / n - before / before_n) / math.sqrt(spread / n) if spread > 1e-12 else None


def window_drift(events: DataFrame, key: str = "user_id", length: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """``(key, window_start, n, mean, deviation)`` of closed windows of a stream with ``ts`` and ``value``; needs ``STATE_STORE``."""
    kind = events.schema[key].dataType.simpleString()
    timed = events.select(key, "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), F.col("value").cast("double").alias("value")).withWatermark("ts", delay)
    schema = f"{key} {kind}, window_start long, n long, mean double, deviation double"
    closed = timed.groupBy(key).transformWithStateInPandas(WindowDrift(key, length), outputStructType=schema, outputMode="append", timeMode="EventTime")
    return closed.withColumn("window_start", F.timestamp_seconds("window_start"))


def window_drift_batch(events: DataFrame, key: str = "user_id", length: int = 86_400) -> DataFrame:
    """The same of a whole table, all windows closed."""
    start = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (length * 1_000_000)) * length)
    value = F.col("value").cast("double")
    sums = events.where("value IS NOT NULL").groupBy(key, start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.sum(value * value).alias("squares"))
    before = Window.partitionBy(key).orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    seen = sums.select("*", *[F.sum(c).over(before).alias(f"b_{c}") for c in ("n", "total", "squares")])
    spread = (F.col("b_squares") - F.col("b_total") * F.col("b_total") / F.col("b_n")) / (F.col("b_n") - 1)
    seen = seen.withColumn("spread", F.when(F.col("b_n") >= 2, spread))
    gap = (F.col("total") / F.col("n") - F.col("b_total") / F.col("b_n")) / F.sqrt(F.col("spread") / F.col("n"))
    return seen.select(key, "window_start", "n", (F.col("total") / F.col("n")).alias("mean"), F.when(F.col("spread") > 1e-12, gap).alias("deviation"))


def pooled_confusion_stream(judged: DataFrame) -> DataFrame:
    """Counts and rates over all rows of a stream with ``alarm`` and ``y`` so far; for update or complete mode."""
    return confusion(judged.withColumn("all", F.lit("all")), F.col("alarm"), by=("all",))


def inductive_rows(cal: DataFrame, batch: DataFrame, k: int = 10) -> DataFrame:
    """``(node_id, c)`` of batch rows by their ``k`` nearest calibration rows; both have node_id, x, y and split."""
    near = nearest(batch, cal, k).select("i", "j").unionByName(batch.select(F.col("node_id").alias("i"), F.col("node_id").alias("j")))
    cols = ["node_id", "x", "y", "split"]
    both = cal.select(*cols).unionByName(batch.select(*cols))
    return contrastive_consistency(both, near)


def alarms_by_batch(cal: DataFrame, batches: DataFrame, p: Calibration = Calibration(weight_mode="contrastive")) -> DataFrame:
    """Rows of ``batches`` with their batch's ``threshold`` and ``alarm``; a batch sees the calibration rows and itself, all in one plan.

    Both have node_id, s, c and y; ``batches`` also have ``batch``.
    """
    cols = ["batch", "node_id", "s", "c", "y", "split"]
    # A calibration row for every batch: the table of batches is small, the rows are what each threshold needs.
    numbers = batches.select("batch").distinct()
    every = cal.withColumn("split", F.lit("cal")).crossJoin(F.broadcast(numbers)).select(*cols)
    limits = thresholds(every.unionByName(batches.withColumn("split", F.lit("test")).select(*cols)), {"batch": ("weighted", p)}, ("batch",))
    return batches.join(limits.select("batch", "threshold"), "batch").withColumn("alarm", F.col("s") > F.col("threshold"))
