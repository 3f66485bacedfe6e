"""Compare registered queries with their SQL in DuckDB: `python tests/compare.py [sf_dir] [key prefix ...]`."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark_df, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if columns and rows agree, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(set(names) ^ set(spark_df.columns))}"
    expected, actual = _bag(names, result.fetchall()), _bag(spark_df.columns, spark_df.collect())
    if expected == actual:
        return None
    missing, extra = expected - actual, actual - expected
    show = lambda bag: sorted(bag, key=repr)[:2]
    return f"rows {sum(expected.values())} vs {sum(actual.values())}; missing {sum(missing.values())} {show(missing)}; extra {sum(extra.values())} {show(extra)}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from ledgerlens.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failed = oracle_connection(sf_dir), oracle_sql(), 0
    for key, build in queries().items():
        if prefixes and not key.startswith(prefixes):
            continue
        began = time.time()
        try:
            if key in oracles:
                problem = compare(build(spark, sf_dir), connection, oracles[key])
            else:
                problem = None if build(spark, sf_dir).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {key} {time.time() - began:.1f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
