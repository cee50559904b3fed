"""Queries by name and their SQL twins."""

from . import basic, graphs, more, sweeps
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "basic", "graphs", "more", "sweeps"]
