"""Spark-first score calibration, graph analytics and corpus preparation."""
