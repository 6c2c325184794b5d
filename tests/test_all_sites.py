"""The stream of sites holds the sites of all three detectors."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from dendrospark.plans.derived import tables
from dendrospark.plans.policy_queries import stream

SF = "/root/testdata/sf0.001"


def test_policies_are_fed_all_detectors(spark):
    found = {r["detector"] for r in stream(tables(spark, SF)).select("detector").distinct().collect()}
    assert found == {None, "branch", "component", "bridge"}


@pytest.mark.parametrize("name", ["a34_site_counts", "u1_site_stream", "w2_cap_sites", "d4_policy_merge_cut", "merge_sites_by_brain", "d8_budget_by_brain"])
def test_query(spark, name):
    message, _, good = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert good, message
