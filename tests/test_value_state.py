from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import stats as S
from ledgerlens.operators import value_state as V

COLUMNS = ["a", "b", "c"]


def frame(spark, n=3000, seed=0, shift=0.0):
    generator = np.random.default_rng(seed)
    heavy = np.where(generator.random(n) < 0.3, 0.0, generator.standard_cauchy(n))
    rows = []
    for i, x in enumerate(heavy):
        b = None if i % 7 == 0 else float("nan") if i % 11 == 0 else float("inf") if i % 13 == 0 else float(generator.normal(1e6 + shift, 2.0))
        rows.append((float(x), b, float(round(x))))
    return spark.createDataFrame(rows, "a double, b double, c double")


def finite(df, column):
    return np.array([r[0] for r in df.select(column).collect() if r[0] is not None and math.isfinite(r[0])])


def test_brackets_never_fall(spark):
    generator = np.random.default_rng(3)
    powers = [2.0**e for e in (-1074, -1022, -3, 0, 1, 2, 10, 52, 1023)]
    edges = [f(p) for p in powers for f in (lambda p: p, lambda p: np.nextafter(p, 0), lambda p: np.nextafter(p, np.inf))]
    some = np.concatenate([edges, generator.standard_cauchy(500), 10.0 ** generator.uniform(-300, 300, 500), [1.7976931348623157e308, 0.0]])
    values = sorted({float(s * x) for x in some for s in (1, -1) if math.isfinite(x)})
    found = V.with_bracket(spark.createDataFrame([(v,) for v in values], "value double")).orderBy("value").collect()
    brackets = [r["bracket"] for r in found]
    assert brackets == sorted(brackets) and len(set(brackets)) > 1000
    by_value = {r["value"]: r["bracket"] for r in found}
    for p in (0.125, 1.0, 2.0, 1024.0):
        assert by_value[float(np.nextafter(p, 0))] == by_value[p] - 1
    assert by_value[0.0] == 0 and all(by_value[-v] == -by_value[v] for v in values if -v in by_value)


def test_batches_equal_one_fit(spark, tmp_path):
    path = str(tmp_path / "state")
    batches = [frame(spark, 3000, 1), frame(spark, 500, 2, shift=40.0), frame(spark, 1500, 3)]
    for i, batch in enumerate(batches):
        V.store_batch(batch, path, i, COLUMNS)
    together = batches[0].unionByName(batches[1]).unionByName(batches[2])
    probs = [0.0, 0.0001, 0.25, 0.5, 0.9999, 1.0]
    quantiles = V.stored_quantiles(spark, path, COLUMNS, probs).first()["_q"]
    for c in COLUMNS:
        assert np.allclose(quantiles[c], np.quantile(finite(together, c), probs), rtol=1e-12, atol=1e-12)
    for bounds in ((0.0001, 0.9999), (0.1, 0.6)):
        fitted = V.stored_normalisation(spark, path, COLUMNS, bounds).first()["_n"]
        for c in COLUMNS:
            values = finite(together, c)
            low, high = np.quantile(values, bounds)
            clipped = np.clip(values, low, high)
            assert np.allclose([fitted[c].low, fitted[c].high], [low, high], rtol=1e-12)
            assert np.isclose(fitted[c].mean, clipped.mean(), rtol=1e-12) and np.isclose(fitted[c].sd, clipped.std(ddof=1), rtol=1e-9)


def test_state_replaces_a_repeated_batch_and_applies(spark, tmp_path):
    path, clean = str(tmp_path / "state"), frame(spark, 800, 5).select("a", "c")
    V.store_batch(clean.withColumn("a", F.col("a") + 9), path, 0, ["a", "c"])
    V.store_batch(clean, path, 0, ["a", "c"])
    V.store_batch(clean.limit(0), path, 1, ["a", "c"])
    fitted = V.stored_normalisation(spark, path, ["a", "c"])
    expected = S.fit_normalisation(clean, ["a", "c"])
    got, want = (S.apply_normalisation(clean.orderBy("a", "c"), ["a", "c"], f).orderBy("a", "c").collect() for f in (fitted, expected))
    assert np.allclose(got, want, rtol=1e-10, atol=1e-12)


def test_column_without_values_and_constant_column(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = spark.createDataFrame([(None, 4.0)] * 5, "a double, b double")
    V.store_batch(rows, path, 0, ["a", "b"])
    fitted = V.stored_normalisation(spark, path, ["a", "b"])
    row = fitted.first()["_n"]
    assert row["a"] is None and (row["b"].low, row["b"].high, row["b"].mean, row["b"].sd) == (4.0, 4.0, 4.0, 0.0)
    assert S.apply_normalisation(rows, ["a", "b"], fitted).distinct().collect() == [(None, 0.0)]


def test_fit_reads_few_brackets(spark, tmp_path):
    path, rows = str(tmp_path / "state"), frame(spark, 4000, 8)
    V.store_batch(rows, path, 0, COLUMNS)
    wanted = {"a": [0, 1], "b": [5]}
    plan = V.read_brackets(spark, path, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(feature,a)" in plan and "In(bracket" in plan
    brackets, ranked = V._located(spark, path, [0.5])
    assert ranked.filter("feature = 'a'").count() < 0.05 * rows.select("a").distinct().count()
    assert brackets.filter("needed").count() <= 2 * len(COLUMNS)
