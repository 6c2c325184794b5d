"""Registered queries against their SQL. All of them with DENDRO_ALL=1, a spread of them otherwise."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = os.environ.get("DENDRO_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SPREAD = [
    "flagship_edge_classes_per_neuron", "j1_split_sites", "j3_nearest_label", "j4_nearest_distance", "j14_mutual_nearest_tips",
    "a1_edge_class_either", "a1_edge_class_both", "a2_edge_class_counts", "a6_merge_targets", "a10_erl", "a16_score_merge_candidates",
    "a16_score_split_candidate", "a23_edge_agreement", "e2_suffix_collisions", "e5_split_fragments", "e8_fill_background_runs",
    "g1_connected_components", "g3_reach", "g5_suppress_necks", "g7_merge_sites_branch", "g9_merge_sites_component", "r2_resample",
    "r5_dilate_labels", "d3_policy_tangent", "d7_policy_small_gap", "d9_gate", "w3_rank_surprise", "w8_gate_lineage", "s2_read_swc",
    "s7_read_connections", "s9_read_hypotheses", "x3_mann_whitney", "x8_bh_fdr", "a32_merge_cut_evidence",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("DENDRO_ALL") else SPREAD)
def test_query(spark, con, name):
    message, _, good = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert good, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_golden_counts(spark):
    from pyspark.sql import functions as F

    from dendrospark.plans.derived import tables

    t = tables(spark, "/root/testdata/sf0.001")
    assert (t.gt_node.count(), t.gt_edge.count(), t.frag_node.count(), t.frag_edge.count()) == (1000, 985, 785, 597)
    omit = t.gt_labelled_edge
    either = omit.filter((F.col("label_src") == "0") | (F.col("label_dst") == "0")).count()
    both = omit.filter((F.col("label_src") == "0") & (F.col("label_dst") == "0")).count()
    assert (either, both) == (363, 59)
