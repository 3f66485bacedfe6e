"""Every registered query: against its SQL in DuckDB, or for rows where no SQL exists."""

from __future__ import annotations

import pytest
from compare import compare, oracle_connection

from __spark_entry__ import entry
from ledgerlens.catalog import all_oracles, all_queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("key", sorted(all_oracles()))
def test_query_equals_sql(spark, connection, key):
    assert compare(all_queries()[key](spark, SF_DIR), connection, all_oracles()[key]) is None


@pytest.mark.parametrize("key", sorted(set(all_queries()) - set(all_oracles())))
def test_query_has_rows(spark, key):
    assert all_queries()[key](spark, SF_DIR).count() > 0


def test_entry_runs(spark):
    frame = entry(spark)
    assert "Revenues" in frame.columns
    frame.count()
