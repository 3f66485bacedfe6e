"""What the plans must not contain, whatever the size of the input."""

from __future__ import annotations

import re

import pytest

from ledgerlens.catalog import all_queries

SF_DIR = "/root/testdata/sf0.001"
# Fits and what they are applied to run Spark ML jobs and vector functions of their own.
FITTED = ("m4_", "m10_", "m12_", "f7_", "ml1_lasso", "ml2_", "ml3_", "ml4_", "ml5_", "ml6_", "s4_", "s6_", "snk2_")
LAZY = [k for k in sorted(all_queries()) if not k.startswith(FITTED)]


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", LAZY)
def test_no_cross_join_and_no_window_in_one_task(spark, key):
    plan = plan_of(all_queries()[key](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Python", plan)
    unpartitioned = re.search(r"windowspecdefinition\((specifiedwindowframe|[\w#]+ (ASC|DESC))", plan)
    # Only bucket totals, at most 4096 rows, may meet in one task.
    assert not unpartitioned or key == "m7_roc_auc"


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(all_queries()["p3_value_list_filter"](spark, SF_DIR))
    scans = re.findall(r"ReadSchema: (struct<.*?>)", plan)
    assert all("l_comment" not in s and "o_totalprice" not in s and "l_tax" not in s for s in scans)


def test_one_window_for_all_changes(spark):
    plan = plan_of(all_queries()["f2_change_features"](spark, SF_DIR))
    assert len(re.findall(r"\+- Window|^Window", plan, re.M)) == 1
    assert plan.count("Exchange hashpartitioning(symbol") <= 1


def test_items_take_one_hash_aggregate(spark):
    plan = plan_of(all_queries()["c3_resolve_items"](spark, SF_DIR))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan and "SortAggregate" not in plan


def test_the_two_year_window_derives_its_facts_once(spark):
    plan = plan_of(all_queries()["s1_two_year_window"](spark, SF_DIR))
    assert "l_orderkey" not in plan and "Scan ExistingRDD" in plan
