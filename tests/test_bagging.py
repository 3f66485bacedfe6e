from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import bagging as B

FEATURES = ["x0", "x1", "x2", "flat"]


def rows(spark, n, label, seed=4):
    """`label` is a function of the generator and x; `flat` never varies."""
    generator = np.random.default_rng(seed)
    x = generator.normal(size=(n, 3))
    y = label(generator, x).astype(int)
    return spark.createDataFrame(
        [(f"k{i}", int(t), *map(float, r), 2.0) for i, (t, r) in enumerate(zip(y, x))], "id string, label int, x0 double, x1 double, x2 double, flat double",
    ).coalesce(1)


@pytest.fixture(scope="module")
def planted(spark):
    return rows(spark, 500, lambda g, x: x[:, 0] + 0.4 * g.normal(size=len(x)) > 0).cache()


@pytest.fixture(scope="module")
def forest(planted):
    return B.fit_bagged_trees(planted, FEATURES, "label", "id", mtry=2, trees=24, seed=2)


def test_draws_are_poisson_and_repeatable(spark):
    keys = spark.range(40_000).selectExpr("concat('k', id) AS id")
    counts = {r["n"]: r["count"] for r in keys.select(B.draws("id", 3, 1).alias("n")).groupBy("n").count().collect()}
    for k, expected in enumerate((0.36788, 0.36788, 0.18394, 0.06131)):
        assert abs(counts[k] / 40_000 - expected) < 0.012
    both = keys.select(B.draws("id", 3, 1).alias("a"), B.draws("id", 4, 1).alias("b"), B.draws("id", 3, 2).alias("c"))
    apart = both.agg(F.corr("a", "b"), F.corr("a", "c")).first()
    assert max(abs(v) for v in apart) < 0.02
    spread = keys.repartition(7).select("id", B.draws("id", 3, 1).alias("n")).orderBy("id").limit(200).collect()
    assert spread == keys.select("id", B.draws("id", 3, 1).alias("n")).orderBy("id").limit(200).collect()


def test_rows_are_scored_by_trees_that_have_not_seen_them(planted, forest):
    scored = {r["id"]: r for r in B.out_of_bag_scores(forest, planted, FEATURES, "label", "id", seed=2).collect()}
    unseen = planted.select("id", *[(B.draws("id", t, 2) == 0).cast("int").alias(f"t{t}") for t in range(24)]).collect()
    for r in unseen:
        trees = sum(r[f"t{t}"] for t in range(24))
        assert (scored[r["id"]].trees if r["id"] in scored else 0) == trees
    right = np.mean([(r.score > 0.5) == (r.truth == 1) for r in scored.values()])
    assert right > 0.8 and len(scored) == 500


def test_labels_at_random_are_not_learnt_by_heart(spark):
    """Trees grown to the end repeat every label they have seen; out of bag, nothing is left of it."""
    noise = rows(spark, 400, lambda g, x: g.random(len(x)) < 0.5, seed=9)
    trees = B.fit_bagged_trees(noise, FEATURES, "label", "id", mtry=2, trees=12, seed=5)
    scored = B.out_of_bag_scores(trees, noise, FEATURES, "label", "id", seed=5)
    assert 0.4 < scored.agg(F.avg(((F.col("score") > 0.5) == (F.col("truth") == 1)).cast("int"))).first()[0] < 0.6
    foreign = B.out_of_bag_scores(trees, noise, FEATURES, "label", "id", seed=6)  # another bootstrap: mostly seen rows
    assert foreign.agg(F.avg(((F.col("score") > 0.5) == (F.col("truth") == 1)).cast("int"))).first()[0] > 0.65


def test_importance(planted, forest):
    found = {r.feature: r.importance for r in B.out_of_bag_importance(forest, planted, FEATURES, "label", "id", seed=2).collect()}
    assert found["flat"] == 0.0
    assert found["x0"] > 0.2 and found["x0"] > 5 * max(abs(found["x1"]), abs(found["x2"]))


def test_rows_that_share_a_key_go_together(spark, planted):
    twice = planted.limit(60).unionByName(planted.limit(60)).coalesce(1)
    trees = B.fit_bagged_trees(twice, FEATURES, "label", "id", trees=3)
    unseen = planted.limit(60).filter(B.draws("id", 0, 1) == 0).count()
    one = B.out_of_bag_scores(trees[:1], twice, FEATURES, "label", "id")
    assert one.count() == unseen


def test_jobs_do_not_grow_with_the_trees(spark, planted, forest):
    """Votes and importance were a job for each tree."""
    context, few = spark.sparkContext, {}
    for trees in (2, 24):
        context.setJobGroup(f"bag-{trees}", "bagging")
        assert B.out_of_bag_scores(forest[:trees], planted, FEATURES, "label", "id", seed=2).count() > 0
        assert B.out_of_bag_importance(forest[:trees], planted, FEATURES, "label", "id", seed=2).count() == 4
        few[trees] = len(context.statusTracker().getJobIdsForGroup(f"bag-{trees}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert abs(few[24] - few[2]) <= 2
