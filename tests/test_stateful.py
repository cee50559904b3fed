"""Streams with state that are run: timers, restarts, late rows, and equality with the batch form."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.calibrate import Calibration
from tidemark.streaming import recalibrate as R
from tidemark.streaming import stateful as S

SCHEMA = "event_id long, ts timestamp, user_id long, value double"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(S.STATE_STORE[0])
    spark.conf.set(*S.STATE_STORE)
    yield spark
    spark.conf.set(S.STATE_STORE[0], old)


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # files are read in the order of their times


def run(spark, tmp_path):
    stream = S.window_drift(R.event_stream(spark, f"{tmp_path}/in", SCHEMA))
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()


def test_drift_equals_the_batch_form_across_a_restart(rocks, tmp_path):
    rnd = random.Random(1)
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=rnd.uniform(0, 200)), i % 3, None if i % 50 == 0 else rnd.gauss(i % 3, 1)) for i in range(600)]
    rows.sort(key=lambda r: r[1])
    for k in (0, 200):
        put(rocks, rows[k : k + 200], f"{tmp_path}/in")
    run(rocks, tmp_path)
    first = rocks.read.parquet(f"{tmp_path}/out").count()
    assert first > 0
    put(rocks, rows[400:], f"{tmp_path}/in")
    put(rocks, [(9999, datetime(2024, 1, 1), 1, 1e9), (10_000, datetime(2024, 2, 1), 77, 0.0)], f"{tmp_path}/in")  # long behind the watermark, and far ahead
    run(rocks, tmp_path)
    got = {(r.user_id, r.window_start): r for r in rocks.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.user_id, r.window_start): r for r in S.window_drift_batch(rocks.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(want) and len(got) > first  # the last row's own window stays open
    for k, r in want.items():
        assert got[k].n == r.n and got[k].mean == pytest.approx(r.mean)
        assert (got[k].deviation is None) == (r.deviation is None) and (r.deviation is None or got[k].deviation == pytest.approx(r.deviation))


def test_pooled_confusion_in_update_mode(spark, tmp_path):
    schema = "node_id long, y int, alarm boolean"
    for k in range(3):
        spark.createDataFrame([(10 * k + i, i % 2, i < 4) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    stream = S.pooled_confusion_stream(R.event_stream(spark, f"{tmp_path}/in", schema))
    stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [r.tp + r.fp + r.fn + r.tn for r in seen] == [10, 20, 30]
    assert (seen[-1].tp, seen[-1].fp, seen[-1].fn, seen[-1].tn) == (6, 6, 9, 9)


def test_batches_in_one_plan_equal_single_batches(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal()), float(rng.uniform()), int(i % 11 == 0), i % 3 if i >= 100 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "node_id long, s double, c double, y int, batch int").checkpoint()
    cal, batches = df.where("node_id < 100").drop("batch"), df.where("node_id >= 100")
    p = Calibration(weight_mode="contrastive")
    got = {r.node_id: r for r in S.alarms_by_batch(cal, batches, p).collect()}
    assert len(got) == 300
    for b in range(3):
        for r in R.recalibrate_batch(cal.withColumn("split", F.lit("cal")), batches.where(F.col("batch") == b), p).collect():
            assert got[r.node_id].threshold == pytest.approx(r.threshold) and got[r.node_id].alarm == r.alarm


def test_inductive_consistency_sees_calibration_rows_only(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist(), int(i % 7 == 0), "cal" if i < 60 else "test") for i in range(200)]
    df = spark.createDataFrame(rows, "node_id long, x array<double>, y int, split string").checkpoint()
    cal = df.where("split = 'cal'")
    one = {r.node_id: r.c for r in S.inductive_rows(cal, df.where("node_id BETWEEN 60 AND 79"), 5).where("node_id >= 60").collect()}
    all_ = {r.node_id: r.c for r in S.inductive_rows(cal, df.where("node_id >= 60"), 5).where("node_id >= 60").collect()}
    assert len(one) == 20 and all(all_[k] == pytest.approx(v) for k, v in one.items())
