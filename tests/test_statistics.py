from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import zero_fill
from ledgerlens.operators import features as X
from ledgerlens.operators import stats as S
from ledgerlens.operators.ordering import _value_buckets, hash_row_number, running_totals
from ledgerlens.plans.panel import complete_panel, derive_items


def values(spark, n=5000, seed=0):
    generator = np.random.default_rng(seed)
    heavy = np.where(generator.random(n) < 0.4, 0.0, generator.standard_cauchy(n))
    return heavy, spark.createDataFrame(
        [(float(a), float(b) if i % 9 else None) for i, (a, b) in enumerate(zip(heavy, generator.normal(size=n)))], "a double, b double"
    )


@pytest.mark.parametrize("probs", [[0.0001, 0.9999], [0.5], [0.0, 0.25, 1.0]])
def test_exact_quantiles(spark, probs):
    _, frame = values(spark)
    row = S.quantile_row(frame, ["a", "b"], probs).first()["_q"]
    for c in ("a", "b"):
        expected = np.quantile([r[0] for r in frame.select(c).na.drop().collect()], probs)
        assert np.allclose(row[c], expected, rtol=1e-12, atol=1e-12)


def test_quantiles_of_constant_empty_and_single(spark):
    frame = spark.createDataFrame([(1.0, None)] * 10, "a double, b double")
    row = S.quantile_row(frame, ["a", "b"], [0.1, 0.9]).first()["_q"]
    assert row.a == [1.0, 1.0] and row.b is None
    clipped = S.winsorize_quantile(frame, ["a", "b"]).first()
    assert (clipped.a, clipped.b) == (1.0, None)


def test_mad_winsorizing(spark):
    heavy, frame = values(spark)
    median = np.median(heavy)
    reach = 2 * 1.4826 * np.median(np.abs(heavy - median))
    got = sorted(r.a for r in S.winsorize_mad(frame.select("a"), ["a"]).collect())
    assert np.allclose(got, np.sort(np.clip(heavy, median - reach, median + reach)))


def test_z_score_moments(spark):
    _, frame = values(spark)
    scaled = S.z_score(frame.withColumn("k", F.lit(3.0)), ["b", "k"])
    mean, sd, constant = scaled.agg(F.avg("b"), F.stddev_samp("b"), F.max("k")).first()
    assert abs(mean) < 1e-9 and abs(sd - 1) < 1e-9 and constant == 0.0


def test_histogram_counts_every_value(spark):
    heavy, frame = values(spark)
    rows = S.histogram(frame, ["a"]).collect()
    assert sum(r.n for r in rows) == len(heavy)
    assert max(r.bin for r in rows) <= int(np.ceil(np.log2(len(heavy)) + 1))


def test_hash_row_number_is_a_permutation_per_group(spark):
    frame = spark.range(3000).selectExpr("id", "IF(id % 10 = 0, 'b', 'a') AS g")
    rows = hash_row_number(frame, ["g"], "id", 5, "rn").collect()
    for g in ("a", "b"):
        mine = sorted(r.rn for r in rows if r.g == g)
        assert mine == list(range(1, len(mine) + 1))
    again = hash_row_number(frame.repartition(7), ["g"], "id", 5, "rn").collect()
    assert {(r.id, r.rn) for r in rows} == {(r.id, r.rn) for r in again}


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_totals(spark, groups):
    frame = spark.range(2000).selectExpr("double(pmod(hash(id), 777)) AS v", "id % 2 AS g").groupBy("v", "g").agg(F.count("*").alias("n"))
    frame = frame.groupBy("v", *groups).agg(F.sum("n").alias("n"))
    rows = running_totals(frame, groups, "v", ["n"]).collect()
    for r in rows:
        peers = [q for q in rows if all(q[k] == r[k] for k in groups)]
        assert r.before_n == sum(q.n for q in peers if q.v < r.v)


def test_running_totals_split_large_buckets(spark):
    """One group holds nearly all rows, one is null, values lie far apart and close together."""
    rows = spark.range(12000).selectExpr(
        "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN 1 ELSE 0 END AS g",
        "CASE WHEN id < 6000 THEN 5 + id * 1e-9 ELSE pow(1.001, id) * (id % 2 * 2 - 1) END AS v", "id % 5 + 1 AS n",
    )
    plain = "coalesce(sum(n) OVER (PARTITION BY g ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
    assert not rows.groupBy("g", "v").count().filter("count > 1").count()
    for limit in (30, 500):
        found = running_totals(rows, ["g"], "v", ["n"], bucket_rows=limit)
        both = found.selectExpr("*", f"{plain} AS plain")
        assert both.count() == 12000 and both.filter("before_n <> plain").count() == 0
        buckets = _value_buckets(rows, ["g"], "v", None, limit)
        assert buckets.groupBy("g", "_b").count().agg(F.max("count")).first()[0] <= limit
    assert rows.filter("g IS NULL").count() > 0


def test_ratios_and_fill(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 1.0), (float("inf"), 1.0), (float("nan"), 1.0)], "a double, b double")
    filled = zero_fill(rows.selectExpr("try_divide(a, b) AS x"), ["x"])
    assert [r.x for r in filled.collect()] == [0.0] * 5


def panel(spark, **changes):
    base = {i: 10.0 for i in (
        "Assets CurrentAssets FixedAssets CurrentLiabilities Equity Revenues AccountsReceivable Cash DepreciationAmortization "
        "PropertyPlantAndEquipment Interest NetIncomeLoss PreTaxIncome CashFlowOperations"
    ).split()}
    rows = [{"symbol": "A", "fy": 2019 + i, **base, **c} for i, c in enumerate(changes["years"])]
    types = ", ".join(["symbol string", "fy int", *[f"{c} double" for c in base]])
    return spark.createDataFrame([tuple(r[c] for c in ("symbol", "fy", *base)) for r in rows], types)


def test_conditional_fill_order(spark):
    rows = derive_items(panel(spark, years=[{"FixedAssets": None, "CurrentAssets": 4.0}, {"CurrentAssets": None, "FixedAssets": 3.0}, {"FixedAssets": None, "CurrentAssets": None}])).orderBy("fy").collect()
    assert [(r.FixedAssets, r.CurrentAssets) for r in rows] == [(6.0, 4.0), (3.0, 7.0), (None, None)]


def test_no_receivables_means_zero_days_and_a_real_change(spark):
    years = [{"Revenues": 20.0, "AccountsReceivable": 10.0}, {"Revenues": 20.0, "AccountsReceivable": 0.0}, {"Revenues": 0.0, "AccountsReceivable": 5.0}]
    rows = X.change_features(complete_panel(panel(spark, years=years))).orderBy("fy").collect()
    assert [r.DaysSalesinAccountingReceivable for r in rows] == [180.0, 0.0, 0.0]
    assert [r.ChangeInDaysSalesinAccountingReceivable for r in rows] == [0.0, -180.0, 0.0]


def test_residuals_are_orthogonal(spark):
    generator = np.random.default_rng(3)
    x = generator.normal(size=(400, 3)) * [1e-9, 1.0, 50.0]
    y = 2 + x @ [3e8, -1.0, 0.1] + generator.normal(size=400)
    frame = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], "y double, p double, q double, r double")
    out = X.ols_residuals(frame, "y", ["p", "q", "r"]).toPandas()
    scaled = np.column_stack([np.ones(400), x / [1e-9, 1.0, 50.0]])
    expected = y - scaled @ np.linalg.lstsq(scaled, y, rcond=None)[0]
    assert np.allclose(np.sort(out.residual), np.sort(expected), atol=1e-8)
    assert abs(out.residual.sum()) < 1e-6
    assert np.all(np.abs(out[["p", "q", "r"]].to_numpy().T @ out.residual.to_numpy()) < 1e-6)


def test_band_is_inclusive(spark):
    frame = spark.createDataFrame([(-1.0,), (1.0,), (0.0,)], "x double")
    assert [r.label for r in X.band_label(frame, "x").orderBy("x").collect()] == [0, 0, 0]


def test_column_filter(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert X.column_filter(frame, {"a": 0.0004, "b": 0.2}).columns == ["b", "c"]
