"""The penalty path against single fits, and where it starts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import models as ML
from ledgerlens.operators import tuning as T
from ledgerlens.operators.metrics import class_metrics, fold_metrics, roc_auc
from ledgerlens.operators.penalty_path import entry_penalties, fold_members, path_scores, penalty_path
from ledgerlens.operators.resample import downsample, downsample_folds, grid_points

FEATURES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1.0, 20.0, 0.1]
    y = (x[:, 0] + x[:, 1] / 30 + rng.normal(size=400) > 0).astype(int)
    data = [(f"k{i}", int(y[i]), i % 3, *map(float, x[i]), 1.0) for i in range(400)]
    return spark.createDataFrame(data, "key string, label int, fold int, a double, b double, c double, flat double").cache()


def test_path_equals_single_fits(rows):
    penalties = [0.001, 0.3, 0.02, 0.1]
    path = penalty_path(rows, FEATURES, "label", "key", penalties, "fold")
    assert path.folds == [0, 1, 2] and path.passes < 40
    for f in path.folds:
        analysis = downsample(rows.filter(F.col("fold") != f), "label", "key")
        for k, penalty in enumerate(penalties):
            single = ML.fit_lasso(analysis, FEATURES, "label", penalty=penalty).stages[-1]
            assert np.allclose(path.coefficients[f, k] * [1, 20, 0.1, 1], single.coefficients.toArray() * [1, 20, 0.1, 1], atol=2e-3)
            assert abs(path.intercepts[f, k] - single.intercept) < 2e-3


def test_first_feature_enters_where_the_statistics_say(rows):
    balanced = downsample(rows, "label", "key").cache()
    entry = {r.feature: r.entry for r in entry_penalties(balanced, FEATURES, "label").collect()}
    assert entry["flat"] is None
    first = max(x for x in entry.values() if x is not None)
    path = penalty_path(rows, FEATURES, "label", "key", [first * 1.001, first * 0.999], None)
    assert not path.coefficients[0, 0].any()
    assert [FEATURES[j] for j in np.flatnonzero(path.coefficients[0, 1])] == [max(entry, key=lambda f: entry[f] or 0)]


def test_grid_metrics_equal_fits_one_by_one(rows):
    grid = grid_points(penalty=[0.2, 0.01])
    got = {(r.config, r.fold, r.metric): r.value for r in T.tune_grid("lasso", rows, FEATURES, "label", "key", grid).collect()}
    assert len(got) == 2 * 3 * 4
    for point in grid:
        model = ML.fit_balanced("lasso", rows.filter("fold <> 1"), FEATURES, "label", "key", penalty=point["penalty"])
        tested = ML.predict(model, rows.filter("fold = 1")).collect()
        hits = sum(r.pred == r.label for r in tested) / len(tested)
        assert abs(got[point["config"], 1, "accuracy"] - hits) < 0.02
    path = penalty_path(rows, FEATURES, "label", "key", [0.01], "fold")
    scored = path_scores(path, rows, "label", "fold", [7])
    assert scored.count() == 400 and {r[0] for r in scored.select("config").distinct().collect()} == {7}


def test_rows_are_stored_once_with_the_folds_that_learn_from_them(rows):
    odd = rows.withColumn("label", F.expr("IF(key = 'k7', NULL, label)")).withColumn("fold", F.expr("IF(key = 'k9', NULL, fold)"))
    for table in (rows, rows.filter("label = 1 OR c > 0.05"), odd):
        marked = downsample_folds(table, "label", "key", "fold", [0, 1, 2]).select("key", F.explode("models").alias("model")).collect()
        for k in range(3):
            wanted = downsample(table.filter(F.col("fold") != k), "label", "key")
            assert sorted(r.key for r in marked if r.model == k) == sorted(r.key for r in wanted.collect())
    assert fold_members(rows, FEATURES, "label", "key", "fold").count() <= 400


def test_fold_metrics_are_those_of_rows(spark):
    scored = spark.range(200).selectExpr(
        "int(id % 3) AS g", "IF(id % 11 = 0, NULL, int(id % 2)) AS truth", "IF(id % 13 = 0, NULL, int(id % 5 > 2)) AS pred", "(id * 37 % 50) / 50D AS score"
    )
    got = {(r.g, r.metric): r.value for r in fold_metrics(scored, ["g"], group_bound=3).collect()}
    rates = class_metrics(scored, ["g"]).join(roc_auc(scored, ["g"]), "g")
    assert got == {(r.g, m): r[m] for r in rates.collect() for m in ("accuracy", "sensitivity", "specificity", "roc_auc")}


def test_folds_of_other_models_are_downsampled_by_one_pass(rows, monkeypatch):
    grid = grid_points(trees=[2], learn_rate=[0.1], depth=[2])
    model = ML.fit_balanced("boosting", rows.filter("fold <> 1"), FEATURES, "label", "key", trees=2, learn_rate=0.1, depth=2)
    tested = ML.predict(model, rows.filter("fold = 1")).collect()
    monkeypatch.setattr(ML, "downsample", lambda *_, **__: pytest.fail("a fold was down-sampled by itself"))
    got = {(r.fold, r.metric): r.value for r in T.tune_grid("boosting", rows, FEATURES, "label", "key", grid).collect()}
    assert len(got) == 3 * 4
    assert abs(got[1, "accuracy"] - sum(r.pred == r.label for r in tested) / len(tested)) < 1e-9


def test_scores_of_some_penalties_are_stored_at_a_time(spark, monkeypatch):
    """What was stored for some penalties is deleted before the next ones are scored; the metrics are those of all at once."""
    from ledgerlens.operators import resample as R
    from ledgerlens.operators import tuning as T

    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 2))
    rows = spark.createDataFrame([(f"k{i}", int(v[0] + rng.normal() > 0), i % 3, float(v[0]), float(v[1])) for i, v in enumerate(x)], "key string, label int, fold int, a double, b double").coalesce(2)
    grid = R.grid_points(penalty=[0.2, 0.05, 0.01, 0.002, 0.0005])
    tune = lambda: {(r.config, r.fold, r.metric): r.value for r in T.tune_grid("lasso", rows, ["a", "b"], "label", "key", grid).collect()}
    together, stored, scored = tune(), [], []
    drop, scores = T.parts_dropped, T.path_scores
    monkeypatch.setattr(T, "parts_dropped", lambda: stored.append(1) or drop())
    monkeypatch.setattr(T, "path_scores", lambda *args: scored.append(args[-1]) or scores(*args))
    monkeypatch.setattr(T, "SCORES_AT_ONCE", 480)
    apart = tune()
    assert len(stored) == 3 and scored == [slice(0, 2), slice(2, 4), slice(4, 6)]
    assert set(apart) == set(together) and all(abs(apart[k] - v) < 1e-12 for k, v in together.items())


def test_parts_of_a_stored_result_are_deleted(spark):
    import os

    from ledgerlens.session import cut_lineage, parts_dropped

    path = lambda df: df._jdf.logicalPlan().rdd().getCheckpointFile().get().removeprefix("file:")
    with parts_dropped():
        part = cut_lineage(spark.range(10).repartition(2))
        assert os.path.exists(path(part))
        whole = cut_lineage(part.selectExpr("id + 1 AS id"))
    assert not os.path.exists(path(part)) and os.path.exists(path(whole)) and whole.count() == 10
