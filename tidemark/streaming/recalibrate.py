"""Thresholds over micro-batches, and drift of event streams.

Each batch is calibrated by the stored calibration rows and its own rows only; nothing of
later batches is seen. Results go to the sink under the batch's number, so a batch that is
replayed after a failure overwrites its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.metrics import confusion
from ..operators.calibrate import Calibration, weighted_threshold


def recalibrate_batch(cal: DataFrame, batch: DataFrame, p: Calibration) -> DataFrame:
    """The batch's rows with threshold and alarm."""
    cols = ["node_id", "s", "c", "y", "split"]
    rows = cal.select(*cols).unionByName(batch.withColumn("split", F.lit("test")).select(*cols))
    t = weighted_threshold(rows, p).select("threshold")
    return batch.crossJoin(F.broadcast(t)).withColumn("alarm", F.col("s") > F.col("threshold"))


def recalibrated(stream: DataFrame, cal: DataFrame, path: str, p: Calibration = Calibration(weight_mode="contrastive")) -> DataStreamWriter:
    """A stream writer that stores every batch with its threshold below ``path``."""

    def store(batch: DataFrame, number: int) -> None:
        recalibrate_batch(cal, batch, p).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return stream.writeStream.foreachBatch(store)


def start(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pooled_confusion(stored: DataFrame) -> DataFrame:
    """One confusion over all batches."""
    return confusion(stored, F.col("alarm"))


def windowed_rates(events: DataFrame, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts, errors and mean value per tumbling window of event time; late rows count until the watermark passes."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy(F.window("ts", length)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_value"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
