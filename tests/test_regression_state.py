"""Regression state of batches against one fit over all rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerlens.operators.features import ols_coefficients, ols_residuals
from ledgerlens.operators.regression_state import merged_state, product_state, read_states, state_coefficients, store_batch

XS = ["a", "b", "c"]
SCHEMA = "k int, a double, b double, c double, y double"


def rows_of(seed: int, n: int = 400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = rng.randrange(4)
        a, b, c = rng.gauss(1e6 + k, 1), rng.gauss(0, 1e-5), rng.gauss(k * 50, 9)
        out.append((k, a, b, c, 3 + 2 * a - 4e4 * b + 0.5 * c + rng.gauss(0, 1)))
    return out


def test_batches_equal_one_fit(spark, tmp_path):
    rows = [*rows_of(1), (1, None, 1.0, 1.0, 1.0), (2, 1.0, float("nan"), 1.0, 1.0), (3, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "state")
    for k in (0, 1, 2, 3, 1):
        store_batch(df.filter(f"k = {k}"), path, k, "y", XS)
    states = read_states(spark, path)
    assert states.count() == 4 and states.columns == ["n", "means", "products", "batch"]
    x = np.array([r[1:4] for r in rows[:400]])
    y = np.array([r[4] for r in rows[:400]])
    centred = x - x.mean(0)
    slopes = np.linalg.lstsq(centred / centred.std(0), y - y.mean(), rcond=None)[0] / centred.std(0)
    got = state_coefficients(states)
    assert got[1:] == pytest.approx(slopes.tolist(), rel=1e-7)
    assert got[0] == pytest.approx(y.mean() - slopes @ x.mean(0), rel=1e-6)
    # Spark's solver does not centre: so far from zero its slopes are off by 3e-4, so it is compared nearer to zero.
    near = df.withColumn("a", df["a"] - 1e6)
    assert state_coefficients(product_state(near, "y", XS))[1:] == pytest.approx(ols_coefficients(near, "y", XS)[1:], rel=1e-5)
    state = merged_state(states).first()
    assert state.n == 400 and state.means == pytest.approx([*x.mean(0), y.mean()])
    both = np.column_stack([centred, y - y.mean()])
    assert state.products == pytest.approx((both.T @ both)[np.triu_indices(4)].tolist(), rel=1e-7, abs=1e-6)


def test_columns_that_do_not_vary_and_empty_batches(spark):
    rows = [(0, 5.0, float(i), 2.0 * i, 1.0 + 3.0 * i) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    states = product_state(df, "y", XS).unionByName(product_state(df.filter("k > 0"), "y", XS))
    fitted = ols_residuals(df, "y", XS, coefficients=state_coefficients(states)).collect()
    assert max(abs(r.residual) for r in fitted) < 1e-9
    assert merged_state(product_state(df.filter("k > 0"), "y", XS)).first().n == 0
    with pytest.raises(ValueError):
        state_coefficients(product_state(df.filter("k > 0"), "y", XS, by=("k",)))
