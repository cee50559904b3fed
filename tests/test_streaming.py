"""Streams that are run: batches, a restart, and late rows."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators.calibrate import Calibration
from tidemark.streaming import recalibrate as R


def test_batches_restart_and_pooled_confusion(spark, tmp_path):
    cal = spark.createDataFrame([(i, 0.01 * i, 0.5, 0, "cal") for i in range(100)], "node_id long, s double, c double, y int, split string")
    part = lambda k: spark.createDataFrame([(1000 * k + i, 0.02 * i, 0.4, int(i > 45)) for i in range(50)], "node_id long, s double, c double, y int")
    p = Calibration(weight_mode="contrastive")

    def run():
        stream = R.event_stream(spark, f"{tmp_path}/in", "node_id long, s double, c double, y int")
        R.start(R.recalibrated(stream, cal, f"{tmp_path}/out", p), f"{tmp_path}/state").awaitTermination()

    for k in (1, 2):
        part(k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    first = spark.read.parquet(f"{tmp_path}/out")
    assert first.count() == 100 and first.select("batch").distinct().count() == 2
    part(3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # a second start reads only what is new
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 150 and out.select("node_id").distinct().count() == 150
    alone = R.recalibrate_batch(cal, part(3), p).select("threshold").first()[0]
    assert {round(r.threshold, 9) for r in out.where("node_id >= 3000").select("threshold").distinct().collect()} == {round(alone, 9)}
    c = R.pooled_confusion(out).first()
    assert c.tp + c.fp + c.fn + c.tn == 150


def test_late_rows_are_left_out_behind_the_watermark(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = lambda *hours: spark.createDataFrame([(i, datetime(2024, 1, d, h), 1, "error" if h == 1 else "view", 1.0) for i, (d, h) in enumerate(hours)], schema)
    import time

    for batch in (rows((1, 1), (1, 2)), rows((3, 5)), rows((3, 6)), rows((1, 3), (5, 1))):  # the first of the last batch is two days late
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = R.windowed_rates(R.event_stream(spark, f"{tmp_path}/in", schema))
    stream.select(F.col("window.start").alias("day"), "n", "errors").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.day.day, r.n, r.errors) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert (1, 2, 1) in got and not any(d == 1 and n != 2 for d, n, _ in got)
