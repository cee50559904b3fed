"""Operators that SQL can express give the same rows, columns and types as DuckDB does."""

import os

import pytest
from twins import connect, difference

from tidemark.llm.entry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == ""
