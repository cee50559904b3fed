"""Queries over neighbours where vectors fill several blocks, dealt over several tasks, against their SQL."""

import pytest
from twins import connect, difference

import __spark_entry__ as entry
from tidemark.operators import neighbours

QUERIES = [
    "a1_hypergraph_degrees",
    "a21_weighted_ks",
    "a38_incident_error",
    "a3_smooth",
    "a5_neighbour_scores",
    "c14_adjacency_consistency",
    "c16_cosine_deviation",
    "c1_consistency",
    "c2_contrastive_consistency",
    "c4_consistency_weights",
    "a26_class_homophily",
    "a28_dirichlet_energy",
    "a29_graph_energy",
    "a2_neighbour_degrees",
    "t14_walk_threshold",
    "c10_pull_kernel",
    "j3_knn_edges",
    "t6_dual_threshold",
    "t8_external_weights",
    "c8_pagerank_3",
    "j11_negative_edges",
]


@pytest.fixture()
def several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("name", QUERIES)
def test_several_blocks(spark, sf_dir, several_blocks, name):
    assert not difference(entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name])
