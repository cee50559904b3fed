"""Sweeps against one call a cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.metrics import confusion
from tidemark.operators import calibrate as C
from tidemark.operators import sweeps as W

CELLS = {
    "split": ("split", C.Calibration()),
    "split at a tenth": ("split", C.Calibration(alpha=0.1)),
    "plain": ("weighted", C.Calibration()),
    "few": ("weighted", C.Calibration(max_pseudo_ratio=0.3, weight_mode="contrastive", tau_quantile=0.2)),
    "none": ("weighted", C.Calibration(max_pseudo_ratio=0.0, weight_mode="uniform")),
    "clipped": ("weighted", C.Calibration(clip_ratio=0.5, use_calib_stat=True)),
    "free": ("adaptive", C.Calibration(clip_range=None, score_quantile=0.9)),
    "adaptive": ("adaptive", C.Calibration(score_quantile=0.75, weight_mode="contrastive", pseudo_discount=0.2)),
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = [(i, float(np.round(rng.normal(i % 9 == 0), 2)), float(np.round(rng.uniform(), 1)), int(i % 9 == 0), ("cal", "test", "test", "train")[i % 4], i % 7 == 0, "ab"[i % 5 == 0]) for i in range(900)]
    return spark.createDataFrame(out, "node_id long, s double, c double, y int, split string, is_novel boolean, site string").checkpoint()


def alone(rows, method, p):
    if method == "split":
        return C.split_threshold(C.cal_rows(rows), p.alpha).first()["threshold"]
    return {"weighted": C.weighted_threshold, "adaptive": C.adaptive_threshold}[method](rows, p).first()["threshold"]


@pytest.mark.parametrize("by", [(), ("site",)])
def test_equals_one_call_a_cell(rows, by):
    got = {(r["site"] if by else None, r.cell): r for r in W.sweep(rows, CELLS, by).collect()}
    for site in ("a", "b") if by else (None,):
        part = rows.where(F.col("site") == site) if by else rows
        for name, (method, p) in CELLS.items():
            t = alone(part, method, p)
            r = got[site, name]
            assert r.threshold == pytest.approx(t), name
            want = confusion(part.where("split = 'test'"), F.col("s") > F.lit(t)).first()
            assert (r.tp, r.fp, r.fn, r.tn) == (want.tp, want.fp, want.fn, want.tn)
    assert len(got) == len(CELLS) * (2 if by else 1)


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_cells(spark, rows):
    many = {f"{n} {i}": (m, p) for i in range(5) for n, (m, p) in CELLS.items()}
    few = jobs(spark, "few cells", lambda: W.sweep(rows, CELLS).collect())
    assert few > 0 and abs(jobs(spark, "many cells", lambda: W.sweep(rows, many).collect()) - few) <= 2


def test_transfer_uses_the_source_threshold(rows):
    got = {(r.source, r.site, r.cell): r for r in W.transfer(rows, CELLS, "site").collect()}
    assert len(got) == 4 * len(CELLS)
    t = alone(rows.where("site = 'a'"), *CELLS["plain"])
    want = confusion(rows.where("split = 'test' AND site = 'b'"), F.col("s") > F.lit(t)).first()
    r = got["a", "b", "plain"]
    assert r.threshold == pytest.approx(t) and (r.tp, r.fp, r.fn, r.tn) == (want.tp, want.fp, want.fn, want.tn)


def test_no_calibration_rows_and_refused_options(spark, rows):
    some = rows.where("NOT (site = 'b' AND split = 'cal')")
    got = {(r["site"], r.cell): r for r in W.sweep(some, CELLS, ("site",)).collect()}
    assert got["b", "plain"].threshold is None and got["b", "plain"].reason == "no calibration rows" and got["b", "plain"].fp == 0
    assert got["a", "plain"].threshold is not None
    assert W.sweep(rows.limit(0), CELLS, ("site",)).count() == 0
    with pytest.raises(ValueError):
        W.cells_of(spark, {"x": ("weighted", C.Calibration(robust=True))})
    with pytest.raises(ValueError):
        W.cells_of(spark, {"x": ("dual", C.Calibration())})
