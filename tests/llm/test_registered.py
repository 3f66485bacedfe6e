"""Registered queries of the subpackage: against SQL, and what their plans hold."""

from __future__ import annotations

import pytest
from compare import compare, oracle_connection

from ledgerlens.llm.queries import ORACLES, QUERIES

#: Python nodes that a query's last plan may have; the native operators have none anywhere.
PYTHON = {
    "op1_packing": {"FlatMapGroupsInArrow"}, "op2_benchmark_decontamination": {"MapInArrow"}, "op5_substring_dedup": {"MapInArrow"},
    "op7_quality_classifier": {"ArrowEvalPython"}, "op10_binary_output": {"MapInArrow"}, "op11_config_packing": {"MapInArrow"},
    "op12_embedding_whitening": {"MapInArrow"},
}
NODES = ("MapInArrow", "FlatMapGroupsInArrow", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, key):
    connection = oracle_connection("/root/testdata/sf0.01")
    assert compare(QUERIES[key](spark, "/root/testdata/sf0.01"), connection, ORACLES[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - {"op6_line_dedup"}))
def test_plan(spark, key):
    plan = QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {n for n in NODES if n in plan} <= PYTHON.get(key, set())


def test_small_shards_split(spark):
    depths = {r["depth"] for r in QUERIES["shards_of_256_kib"](spark, "/root/testdata/sf0.01").select("depth").distinct().collect()}
    assert min(depths) >= 2
