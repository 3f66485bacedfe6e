"""Boosting round by round, early stopping, and tuned forests in blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import models as ML
from ledgerlens.operators import staged
from ledgerlens.operators import tuning as T
from ledgerlens.operators.resample import grid_points
from ledgerlens.operators.staged import fit_boosting_stopped, staged_losses, staged_scores, stopping_round
from ledgerlens.sources.writers import load_model, save_model

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] * x[:, 1] + 0.8 * rng.normal(size=300) > 0).astype(int)
    data = [(f"k{i}", int(y[i]), i % 2, float(x[i, 0]), float(x[i, 1])) for i in range(300)]
    return spark.createDataFrame(data, "key string, label int, fold int, a double, b double").coalesce(1).cache()


def test_staged_scores_equal_fits_of_that_size(rows):
    train, test = rows.filter("fold = 0"), rows.filter("fold = 1")
    model = ML.fit_boosting(train, FEATURES, "label", trees=12, depth=2, learn_rate=0.3)
    got = staged_scores(model, test, FEATURES, "label", [3, 12, 7]).groupBy("size").agg(F.sort_array(F.collect_list("score")).alias("s"))
    for r in got.collect():
        single = ML.fit_boosting(train, FEATURES, "label", trees=r["size"], depth=2, learn_rate=0.3)
        want = sorted(x.score for x in ML.predict(single, test).collect())
        assert np.allclose(r["s"], want, atol=1e-12)
    losses = staged_losses(model, test, FEATURES, "label")
    scored = ML.predict(model, test).collect()
    plain = -np.mean([np.log(r.score if r.label else 1 - r.score) for r in scored])
    assert len(losses) == 12 and abs(losses[-1] - plain) < 1e-9


def test_stopping_round():
    assert stopping_round([5, 4, 3, 3, 3.5, 2], 2) == (3, True)
    assert stopping_round([5, 4, 3, 3, 3.5, 2], 4) == (6, False)
    assert stopping_round([1.0], 1) == (1, False)


def test_stopped_fit_equals_stopping_one_long_fit(rows):
    train, test = rows.filter("fold = 0"), rows.filter("fold = 1")
    long = ML.fit_boosting(train, FEATURES, "label", trees=40, depth=3, learn_rate=0.5)
    want, final = stopping_round(staged_losses(long, test, FEATURES, "label"), 6)
    model, best, size = fit_boosting_stopped(train, test, FEATURES, "label", trees=40, learn_rate=0.5, patience=6, first=4)
    assert final and best == want == len(model.stages[-1].trees) and size < 40


def test_stopping_fits_no_round_twice_at_the_end(rows, monkeypatch, tmp_path):
    train, test, sizes = rows.filter("fold = 0"), rows.filter("fold = 1"), []

    def fit(*args, trees, **more):
        sizes.append(trees)
        return ML.fit_boosting(*args, trees=trees, **more)

    monkeypatch.setattr(staged, "fit_boosting", fit)
    model, best, size = fit_boosting_stopped(train, test, FEATURES, "label", trees=40, learn_rate=0.1, patience=4, first=4)
    assert 1 < best < size and sizes == [4 * 2**k for k in range(len(sizes))] and sizes[-1] == size
    refit = ML.fit_boosting(train, FEATURES, "label", trees=best, depth=3, learn_rate=0.1)
    scores = lambda m: [(r.key, r.pred, r.score) for r in ML.predict(m, test).orderBy("key").collect()]
    assert scores(model) == scores(refit)
    save_model(model, str(tmp_path / "model"))
    assert scores(load_model(str(tmp_path / "model"))) == scores(refit)


def test_forest_sizes_are_blocks(rows):
    grid = grid_points(mtry=[1], trees=[50, 100])
    got = {(r.config, r.fold, r.metric): r.value for r in T.tune_grid("forest", rows, FEATURES, "label", "key", grid).collect()}
    assert len(got) == 2 * 2 * 4
    alone = {(r.config, r.fold, r.metric): r.value for r in T.tune_grid("forest", rows, FEATURES, "label", "key", grid[:1]).collect()}
    assert all(got[k] == v for k, v in alone.items())
    train, test = rows.filter("fold <> 1"), rows.filter("fold = 1")
    fits = [ML.fit_balanced("forest", train, FEATURES, "label", "key", 1000 + b, mtry=1, trees=50) for b in range(2)]
    scores = [{r.key: (r.label, r.score) for r in ML.predict(m, test).collect()} for m in fits]
    hits = np.mean([(scores[0][k][1] + scores[1][k][1] > 1) == (y == 1) for k, (y, _) in scores[0].items()])
    assert abs(got[2, 1, "accuracy"] - hits) < 0.02
