"""Boosting whose rounds run in one task."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from ledgerlens.operators import boosting as B
from ledgerlens.operators import models as ML

FEATURES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def few_values(spark):
    """So few values that Spark's thresholds part the rows as ours do."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(3000, 3))
    y = (x[:, 0] * x[:, 1] + 9 * x[:, 2] + 25 * rng.normal(size=3000) > 80).astype(int)
    rows = [(int(t), *map(float, r), 1.0) for t, r in zip(y, x)]
    return spark.createDataFrame(rows, "label int, a double, b double, c double, flat double").repartition(3).cache()


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_rounds_are_those_of_spark(few_values, depth):
    ours = ML.fit_boosting(few_values, FEATURES, "label", trees=15, depth=depth, learn_rate=0.3)
    vectors = ML._assembled(FEATURES).transform(few_values)
    theirs = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=15, maxDepth=depth, stepSize=0.3).fit(vectors)
    assert ours.stages[-1].treeWeights == theirs.treeWeights and len(ours.stages[-1].trees) == 15
    both = [[r[0] for r in m.transform(vectors).select(*FEATURES, "label", "probability").distinct().orderBy(*FEATURES, "label").select(F.col("probability")).collect()]
            for m in (ours.stages[-1], theirs)]
    assert np.abs(np.array([v.toArray() for v in both[0]]) - np.array([v.toArray() for v in both[1]])).max() < 1e-9
    assert np.allclose(ours.stages[-1].featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)


def test_jobs_do_not_grow_with_the_rounds(spark, few_values):
    """Spark's own fit runs some jobs a round."""
    context, few = spark.sparkContext, {}
    for trees in (2, 200):
        context.setJobGroup(f"rounds-{trees}", "boosting")
        assert len(ML.fit_boosting(few_values, FEATURES, "label", trees=trees).stages[-1].trees) == trees
        few[trees] = len(context.statusTracker().getJobIdsForGroup(f"rounds-{trees}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert abs(few[200] - few[2]) <= 2


def test_a_fit_does_not_depend_on_partitions(few_values):
    one, other = (ML.fit_boosting(few_values.repartition(k), FEATURES, "label", trees=20) for k in (1, 7))
    assert [t.toDebugString.split("\n", 1)[1] for t in one.stages[-1].trees] == [t.toDebugString.split("\n", 1)[1] for t in other.stages[-1].trees]


def test_more_rows_than_a_task_holds_are_left_to_spark(few_values, monkeypatch):
    monkeypatch.setattr(B, "LOCAL_ROWS", 100)
    monkeypatch.setattr(B, "fit_rounds", None)
    assert len(ML.fit_boosting(few_values, FEATURES, "label", trees=2).stages[-1].trees) == 2


def test_joint_histograms_are_plain_counts():
    rng = np.random.default_rng(2)
    x, node, w = rng.integers(0, 32, (500, 7)).astype(np.uint8), rng.integers(0, 3, 500), rng.normal(size=500)
    codes = B._Codes(x)
    for together in (1, 2, 3):
        codes._together = lambda nodes, rows, together=together: together
        counts, sums = codes.histograms(node, 3, w)
        for n in range(3):
            for j in range(7):
                mine = x[node == n, j]
                assert np.array_equal(counts[n, j], np.bincount(mine, None, 32)) and np.allclose(sums[n, j], np.bincount(mine, w[node == n], 32))


def test_a_longer_fit_goes_on_from_a_shorter_one(few_values, monkeypatch):
    progress, fitted = B.Progress(), []
    ML.fit_boosting(few_values, FEATURES, "label", trees=6, progress=progress)
    assert len(progress.known) == 6
    longer = ML.fit_boosting(few_values, FEATURES, "label", trees=14, progress=progress)
    alone = ML.fit_boosting(few_values, FEATURES, "label", trees=14)
    assert [t.toDebugString.split("\n", 1)[1] for t in longer.stages[-1].trees] == [t.toDebugString.split("\n", 1)[1] for t in alone.stages[-1].trees]
    x, y = np.random.default_rng(1).integers(0, 9, (400, 3)).astype(np.uint8), np.random.default_rng(2).integers(0, 2, 400)
    short, whole = B.boost(x, y, 5, 2, 0.3), B.boost(x, y, 9, 2, 0.3)
    grow = B._tree
    monkeypatch.setattr(B, "_tree", lambda *args: fitted.append(1) or grow(*args))
    went_on = B.boost(x, y, 9, 2, 0.3, short)
    assert len(fitted) == 4 and all(np.array_equal(a[k], b[k]) for a, b in zip(whole, went_on, strict=True) for k in a)
