from __future__ import annotations

from pyspark.sql import Row

from ledgerlens.operators.changes import change, drop_first_year, previous
from ledgerlens.operators.dedup import annual_facts, keep_last, last_per_year

SCHEMA = "symbol string, ns string, tag string, fy int, end string, form string, val double, pos int"


def facts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("symbol", "ns", "tag", "fy", "date(end) AS end", "form", "val", "pos")


def test_earlier_quarterly_fact_hides_the_annual_one(spark):
    rows = facts(spark, [("A", "g", "Cash", 2020, "2020-12-31", "10-Q", 1.0, 0), ("A", "g", "Cash", 2020, "2020-12-31", "10-K", 2.0, 1)])
    assert annual_facts(rows).count() == 0
    assert [r.val for r in annual_facts(rows, dedupe="after_filter").collect()] == [2.0]


def test_missing_end_counts_as_last(spark):
    rows = facts(spark, [
        ("A", "g", "Cash", 2020, "2020-03-31", "10-K", 1.0, 0),
        ("A", "g", "Cash", 2020, None, "10-K", 2.0, 1),
        ("A", "g", "Cash", 2020, "2020-12-31", "10-K", 3.0, 2),
    ])
    assert [r.val for r in keep_last(rows).collect()] == [2.0]


def test_equal_ends_are_decided_by_position(spark):
    rows = facts(spark, [("A", "g", "Cash", 2020, "2020-12-31", "10-K", float(i), i) for i in range(5)])
    assert [r.val for r in keep_last(rows).collect()] == [4.0]


def test_a_key_with_most_rows_is_reduced_before_the_shuffle(spark):
    rows = spark.range(30_000).selectExpr(
        "IF(id % 3 > 0, 'HOT', concat('S', id)) AS symbol", "2020 AS fy", "'Cash' AS tag", "date'2020-12-31' AS end", "id AS pos", "double(id) AS val"
    )
    kept = keep_last(rows)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert kept.count() == 10_001
    assert kept.filter("symbol = 'HOT'").first().val == 29_999.0


def test_both_choices_of_a_kept_fact_take_one_shuffle(spark):
    rows = facts(spark, [
        ("A", "g", "Cash", 2020, "2020-12-31", "10-Q", 1.0, 0), ("A", "g", "Cash", 2020, "2020-12-31", "10-K", 2.0, 1),
        ("A", "d", "Cash", 2020, "2020-06-30", "10-K", 3.0, 2), ("A", "g", "Cash", 2020, "2020-06-30", "10-K", 4.0, 3),
        ("A", "g", "Cash", 2021, "2020-06-30", "10-K", 5.0, 4), ("A", "g", "Cash", 2020, None, "10-K", 6.0, 5),
        (None, "g", "Cash", 2020, "2020-06-30", "10-K", 7.0, 6),
    ])
    kept = keep_last(annual_facts(rows))
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.symbol, r.val) for r in kept.collect()} == {("A", 4.0), (None, 7.0)}
    after = keep_last(annual_facts(rows, dedupe="after_filter"))
    assert {(r.symbol, r.val) for r in after.collect()} == {("A", 2.0), (None, 7.0)}


def test_last_snapshot_keeps_nulls(spark):
    rows = spark.createDataFrame([Row(d="2020-01-01", s="A"), Row(d="2020-06-01", s=None)]).selectExpr(
        "date(d) AS date", "year(date(d)) AS year", "s"
    )
    assert [(r.year, r.s) for r in last_per_year(rows).collect()] == [(2020, None)]


def test_lag_and_change(spark):
    rows = spark.createDataFrame([("A", 2018, 5), ("A", 2019, None), ("A", 2021, 9), ("B", 2020, 4)], "symbol string, fy int, x int")
    got = {
        (r.symbol, r.fy): (r.p, r.c, r.s)
        for r in rows.select("symbol", "fy", previous("x").alias("p"), change("x").alias("c"), change("x", True).alias("s")).collect()
    }
    assert got[("A", 2018)] == (5, 0, 0)
    assert got[("A", 2019)] == (5, None, None)
    assert got[("A", 2021)] == (None, None, None)
    assert got[("B", 2020)] == (4, 0, 0)
    assert {(r.symbol, r.fy) for r in drop_first_year(rows).collect()} == {("A", 2019), ("A", 2021)}


def test_gap_years(spark):
    rows = spark.createDataFrame([("A", 2018, 5), ("A", 2020, 9)], "symbol string, fy int, x int")
    assert [r.c for r in rows.select("fy", change("x").alias("c")).orderBy("fy").collect()] == [0, 4]
    assert [r.c for r in rows.select("fy", change("x", strict_year=True).alias("c")).orderBy("fy").collect()] == [0, None]
