"""Fitted detectors as tables: named arrays of numbers, one row each, beside the detector's name and parameters."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.detectors import Convolution, Detector, Direction, Subspace, Wavelet, build

SCHEMA = "name string, shape array<int>, values array<double>"


def _state(detector: Detector) -> tuple[str, dict, dict[str, np.ndarray]]:
    if isinstance(detector, Direction):
        return "direction", {}, {"mu": np.array(detector.mu.first()["mu"])}
    if isinstance(detector, Subspace):
        return "subspace", {"alpha": detector.mix.first()["alpha"], "variance": detector.variance}, {"mu": np.array(detector.mu), "components": np.array(detector.components), "shares": np.array(detector.shares)}
    if isinstance(detector, (Wavelet, Convolution)):
        name = "wavelet" if isinstance(detector, Wavelet) else "convolution"
        return name, {"degree": detector.degree} if name == "wavelet" else {}, {k: np.asarray(v) for k, v in detector.w.items()}
    raise TypeError(f"{type(detector).__name__} cannot be stored")


def save(detector: Detector, spark: SparkSession, path: str) -> str:
    """Store a fitted detector; what is there already stays and raises an error."""
    name, parameters, arrays = _state(detector)
    rows = [(json.dumps({"detector": name, "parameters": parameters}), [], []), *((k, list(a.shape), a.ravel().tolist()) for k, a in arrays.items())]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return path


def load(spark: SparkSession, *paths: str) -> Detector:
    """The first stored detector among the paths; hidden sizes follow from the stored shapes."""
    for path in paths:
        try:
            rows = spark.read.schema(SCHEMA).parquet(path).collect()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        break
    else:
        raise FileNotFoundError(f"no stored detector at {', '.join(paths)}")
    arrays = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows if r["shape"]}
    head = json.loads(next(r["name"] for r in rows if not r["shape"]))
    name, parameters = head["detector"], head["parameters"]
    if name == "direction":
        out = build(name)
        out.mu = _one(spark, mu=arrays["mu"].tolist())
        return out
    if name == "subspace":
        out = build(name, **parameters)
        out.mu, out.components, out.shares = arrays["mu"].tolist(), arrays["components"].tolist(), arrays["shares"].tolist()
        out.mix = spark.createDataFrame([(float(parameters["alpha"]),)], "alpha double")
        return out
    return build(name, weights=arrays, **parameters)


def _one(spark: SparkSession, mu: list[float]) -> DataFrame:
    return spark.createDataFrame([(mu,)], "mu array<double>")
