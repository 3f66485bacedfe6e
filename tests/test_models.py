from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens.operators import metrics as M
from ledgerlens.operators import models as ML
from ledgerlens.operators import resample as R
from ledgerlens.operators import tuning as T
from ledgerlens.operators.kernel import RandomFourierFeatures
from ledgerlens.plans.training import chosen_params, tuned_fit, tuned_models
from ledgerlens.sources.writers import load_model, save_model

FEATURES = ["x0", "x1", "x2", "x3"]


@pytest.fixture(scope="module")
def planted(spark):
    """x0 drives the label (three quarters zeros), x2 and x3 are noise."""
    generator = np.random.default_rng(11)
    x = generator.normal(size=(1200, 4))
    label = (x[:, 0] + 0.3 * x[:, 1] + 0.3 * generator.normal(size=1200) > 0.7).astype(int)
    rows = [(f"k{i}", int(y), *map(float, r)) for i, (y, r) in enumerate(zip(label, x))]
    return spark.createDataFrame(rows, "id string, label int, x0 double, x1 double, x2 double, x3 double").cache()


def test_split_folds_and_downsampling(planted):
    split = R.stratified_split(planted, "label", "id")
    sizes = {r.label: r.n for r in planted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    train = {r.label: r.n for r in split.filter("is_train").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert split.count() == 1200 and all(train[k] == int(0.7 * n) for k, n in sizes.items())
    folds = R.stratified_folds(planted, "label", "id", folds=7).groupBy("label", "fold").agg(F.count("*").alias("n")).collect()
    for label, n in sizes.items():
        counts = [r.n for r in folds if r.label == label]
        assert sum(counts) == n and max(counts) - min(counts) <= 1
    small = R.downsample(planted, "label", "id").groupBy("label").count().collect()
    assert {r["count"] for r in small} == {min(sizes.values())}
    assert R.downsample(planted.repartition(9), "label", "id").exceptAll(R.downsample(planted, "label", "id")).count() == 0


def test_auc_agrees_with_spark(planted):
    scored = planted.selectExpr("label AS truth", "x0 AS score", "double(label) AS l")
    expected = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="l").evaluate(scored)
    assert abs(M.roc_auc(scored, []).first().roc_auc - expected) < 1e-9


def test_auc_with_ties_and_one_class(spark):
    rows = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3)]
    scored = spark.createDataFrame(rows, "g string, truth int, score double")
    got = {r.g: r.roc_auc for r in M.roc_auc(scored, ["g"]).collect()}
    assert got == {"a": 0.875, "b": None}


def test_grids():
    assert {k: len(v) for k, v in R.FULL_GRIDS.items()} == {"lasso": 100, "forest": 600, "boosting": 120, "kernel": 40}
    assert R.grid_points(a=[1, 2], b=[3])[1] == {"config": 2, "a": 2, "b": 3}


@pytest.mark.parametrize("kind, params", [
    ("lasso", {"penalty": 0.01}), ("forest", {"mtry": 2, "trees": 20}),
    ("boosting", {"trees": 10, "depth": 2, "learn_rate": 0.1}), ("kernel", {"cost": 10.0, "sigma": 0.1, "dims": 128}),
])
def test_models_find_the_signal_and_survive_saving(spark, planted, tmp_path, kind, params):
    split = R.stratified_split(planted, "label", "id").cache()
    model, metrics, confusion = T.last_fit(kind, split, FEATURES, "label", "id", **params)
    assert {r.metric: r.value for r in metrics.collect()}["roc_auc"] > 0.9
    assert sum(r.pred_1 + r.pred_0 for r in confusion.collect()) == split.filter("NOT is_train").count()
    save_model(model, str(tmp_path / kind))
    before, after = (ML.predict(m, planted).select("id", "pred", "score") for m in (model, load_model(str(tmp_path / kind))))
    assert before.exceptAll(after).count() == 0


def test_lasso_drops_noise_as_the_penalty_grows(planted):
    def zeros(penalty):
        model = ML.fit_balanced("lasso", planted, FEATURES, "label", "id", penalty=penalty)
        return [t for t, b in ML.coefficients(model, FEATURES).items() if b == 0]

    weak, strong = zeros(1e-4), zeros(0.1)
    assert len(weak) <= len(strong) and {"x2", "x3"} <= set(strong) and "x0" not in strong


def test_fourier_features_approximate_the_kernel(spark):
    x = np.random.default_rng(2).normal(size=(40, 4))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    frame = VectorAssembler(inputCols=list("abcd"), outputCol="v").transform(frame)
    lifted = RandomFourierFeatures(inputCol="v", outputCol="z", sigma=0.1, dims=4096).transform(frame)
    pairs = lifted.select(vector_to_array("v").alias("v"), vector_to_array("z").alias("z")).toPandas()
    v, z = np.stack(pairs.v), np.stack(pairs.z)
    exact = np.exp(-0.1 * ((v[:, None] - v[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.08


def test_prefixes_of_a_boosted_model_equal_their_own_fits(planted):
    long = ML.fit_boosting(planted, FEATURES, "label", trees=6, depth=2, learn_rate=0.1)
    short = ML.fit_boosting(planted, FEATURES, "label", trees=3, depth=2, learn_rate=0.1)
    prefix = T.prefix_scores(long, planted, [3, 6]).select("id", "score_3", "score_6")
    own = ML.predict(short, planted).select("id", F.col("score").alias("own"))
    full = ML.predict(long, planted).select("id", F.col("score").alias("full"))
    gap = prefix.join(own, "id").join(full, "id").agg(F.max(F.abs(F.expr("score_3 - own"))), F.max(F.abs(F.expr("score_6 - full")))).first()
    assert max(gap) < 1e-9


def test_a_forest_configuration_does_not_depend_on_the_rest_of_the_grid(planted):
    folded = R.stratified_folds(planted, "label", "id", folds=2)
    metrics = {}
    for trees in ([4], [4, 8]):
        grid = R.grid_points(mtry=[2], trees=trees)
        rows = T.tune_grid("forest", folded, FEATURES, "label", "id", grid).filter("config = 1").collect()
        metrics[len(trees)] = {(r.fold, r.metric): round(r.value, 9) for r in rows}
    assert metrics[1] == metrics[2]


def test_depth_of_a_forest_is_a_parameter(planted):
    depth = lambda **p: max(t.depth for t in ML.fit_forest(planted, FEATURES, "label", trees=3, **p).stages[-1].trees)
    assert depth(depth=2) == 2 and depth() > 8 and depth(least_rows=200) < depth()


def test_tuning_scores_every_configuration_on_every_fold(planted):
    folded = R.stratified_folds(planted, "label", "id", folds=3)
    grid = R.grid_points(mtry=[1, 2], trees=[3, 6])
    metrics = T.tune_grid("forest", folded, FEATURES, "label", "id", grid).cache()
    assert metrics.count() == 4 * 3 * 4
    table = T.tuning_table(metrics, grid)
    assert {r.n for r in table.collect()} == {3}
    best = M.select_best(table, "roc_auc").first()
    assert best.mean > 0.85 and {"mtry", "trees"} <= set(table.columns)


def test_tuned_fit(planted):
    table = planted.select(F.lit("s").alias("symbol"), F.lit(2020).alias("fy"), F.col("id").alias("FY_symbol"), *FEATURES, F.col("label").alias("DiscretionaryAccrualsBinary"))
    model, tuning, tested, _ = tuned_fit("lasso", table, R.SMALL_GRIDS["lasso"], folds=2)
    assert tuning.count() == 12 and {r.metric: r.value for r in tested.collect()}["roc_auc"] > 0.9
    assert list(model.stages[0].getInputCols()) == FEATURES


def as_table(planted):
    return planted.select(F.lit("s").alias("symbol"), F.lit(2020).alias("fy"), F.col("id").alias("FY_symbol"), *FEATURES, F.col("label").alias("DiscretionaryAccrualsBinary"))


def test_a_configuration_is_chosen_by_metric_or_number(planted):
    grid = R.grid_points(penalty=[1e-3, 0.2, 0.9])
    model, tuning, _, confusion = tuned_fit("lasso", as_table(planted), grid, folds=2, config=2)
    alone = ML.fit_balanced("lasso", R.stratified_split(as_table(planted), "DiscretionaryAccrualsBinary", "FY_symbol").filter("is_train"), FEATURES, "DiscretionaryAccrualsBinary", "FY_symbol", penalty=0.2)
    assert np.allclose(list(ML.coefficients(model, FEATURES).values()), list(ML.coefficients(alone, FEATURES).values()))
    assert sum(r.pred_1 + r.pred_0 for r in confusion.collect()) == R.stratified_split(as_table(planted), "DiscretionaryAccrualsBinary", "FY_symbol").filter("NOT is_train").count()
    for metric in M.METRICS:
        means = {r.config: r["mean"] for r in tuning.filter(F.col("metric") == metric).collect()}
        best = min(c for c, m in means.items() if m == max(means.values()))
        assert chosen_params(tuning, grid, metric) == {"penalty": grid[best - 1]["penalty"]}
    assert chosen_params(tuning, grid, "accuracy", 3) == {"penalty": 0.9}
    for wrong in ({"config": 4}, {"metric": "precision"}):
        with pytest.raises(ValueError):
            tuned_fit("lasso", as_table(planted), grid, folds=2, **wrong)


def test_lasso_leaves_the_table_on_which_models_are_tuned(planted):
    grids = {"lasso": R.grid_points(penalty=[0.05, 0.06]), "forest": R.grid_points(mtry=[1, 2], trees=[8]), "kernel": R.grid_points(sigma=[0.05], cost=[10.0])}
    kept, models = tuned_models(as_table(planted), grids, folds=2, choices={"forest": {"metric": "roc_auc"}, "lasso": {"config": 2}})
    inputs = [c for c in kept.columns if c in FEATURES]
    assert "x0" in inputs and not {"x2", "x3"} & set(inputs)
    assert set(models) == {"forest", "kernel"}
    for model, tuning, tested, confusion in models.values():
        assert list(model.stages[0].getInputCols()) == inputs and tuning.count() % 4 == 0
        assert {r.metric: r.value for r in tested.collect()}["roc_auc"] > 0.85 and confusion.count() == 2
    with pytest.raises(ValueError):
        tuned_models(as_table(planted), {"lasso": R.grid_points(penalty=[5.0])}, folds=2)


def test_importance_ranks_the_driver_first(planted):
    model = ML.fit_balanced("forest", planted, FEATURES, "label", "id", mtry=2, trees=15)
    rows = {r.feature: r.importance for r in T.permutation_importance(model, planted, FEATURES, "label", "id").collect()}
    assert set(rows) == set(FEATURES) and max(rows, key=rows.get) == "x0" and rows["x0"] > 0.2 and abs(rows["x3"]) < 0.05


def test_vote_and_texts(spark):
    votes = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "a int, b int, c int")
    assert [r.overall for r in ML.vote(votes, ["a", "b", "c"]).orderBy("b").collect()] == ["Moderately", "Extremely"]


def test_rows_without_a_label_are_split_too(planted):
    rows = planted.withColumn("label", F.when(F.col("id").endswith("7"), None).otherwise(F.col("label")))
    split = R.stratified_split(rows, "label", "id")
    assert split.count() == rows.count() == R.stratified_folds(rows, "label", "id").count()
    shares = {r.label: (r.train, r.n) for r in split.groupBy("label").agg(F.count_if("is_train").alias("train"), F.count(F.lit(1)).alias("n")).collect()}
    assert set(shares) == {None, 0, 1} and all(train == int(n * 0.7) for train, n in shares.values())
