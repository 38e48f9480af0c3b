"""What the physical plans of the catalogue look like."""

import os
import re

import pytest

from tessera.plans import catalog

catalog.load_all()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ONE_ROW_SIDES = {"directory_paged"}  # a total of one row joins the page
PYTHON = {"name_keys", "identity_resolve", "career_tiers", "two_corner_matches", "ranking_changes", "ranking_chain", "document_digests"}  # Unicode folding
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plan_of(spark, name):
    return catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_product_and_no_python(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan
    assert name in ONE_ROW_SIDES or "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON or not re.search("Python|Pandas|Arrow", plan)
    assert not re.search(r"Exchange SinglePartition, ENSURE_REQUIREMENTS.*\n.*Window", plan)


def test_latest_per_key_is_one_combined_aggregation(spark):
    plan = plan_of(spark, "latest_per_key")
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1 and "partial_max_by" in plan


def test_scans_are_pruned_and_filtered(spark):
    plan = plan_of(spark, "as_of_revision")
    assert "l_comment" not in plan and re.search(r"PushedFilters: \[[^\]]*l_shipdate", plan)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan_of(spark, "revision_chain_counts"))[1]
    assert [c.split(":")[0] for c in schema.split(",")] == ["l_orderkey", "l_linenumber"]


def test_buckets_add_no_exchange_of_the_rows(spark):
    plan = plan_of(spark, "change_dedupe")
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning(user_id") <= 4


def test_corners_meet_by_day_before_names_are_compared(spark):
    plan = plan_of(spark, "two_corner_matches")
    assert re.search(r"Join \[last#\d+L?, day#\d+\], \[last#\d+L?, day#\d+\]", plan)
