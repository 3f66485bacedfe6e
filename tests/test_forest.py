"""Forests whose small nodes are grown in groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from ledgerlens.operators import forest as G
from ledgerlens.operators import models as ML

FEATURES = ["x0", "x1", "flat"]


@pytest.fixture(scope="module")
def noisy(spark):
    generator = np.random.default_rng(3)
    x = generator.normal(size=(3000, 2))
    y = (x[:, 0] + 0.7 * generator.normal(size=3000) > 0).astype(int)
    rows = [(int(t), *map(float, r), 1.0) for t, r in zip(y, x)]
    return spark.createDataFrame(rows, "label int, x0 double, x1 double, flat double").repartition(3).cache()


def _fit(df, local_rows, trees=6, seed=1):
    rows = df.select(F.col("label").alias("y"), F.array(*FEATURES).alias("x"), F.xxhash64(*FEATURES).alias("k"))
    draws = G.value_draws("k")
    return G.fit_trees(rows, draws, 3, "label", 2, trees, 30, 1, seed, local_rows), rows, draws


@pytest.mark.parametrize("local_rows", [100_000, 150])
def test_nodes_hold_the_rows_that_were_drawn(spark, noisy, local_rows, tmp_path):
    """Counts of the root are the draws, those of two sisters add up to their parent, and rows arrive where they are counted."""
    model, rows, draws = _fit(noisy, local_rows)
    model.save(str(tmp_path / "model"))
    nodes = {}
    for r in spark.read.parquet(str(tmp_path / "model" / "data")).collect():
        nodes[r.treeID, r.nodeData.id] = r.nodeData
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("w", draws).groupBy("tree").pivot("y", [0, 1]).agg(F.sum("w"))
    for r in drawn.collect():
        assert list(nodes[r.tree, 0].impurityStats) == [r["0"], r["1"]]
    inner = [(t, n) for (t, _), n in nodes.items() if n.leftChild >= 0]
    assert len(inner) > 600 and all(n.split.featureIndex in (0, 1) for _, n in inner)
    for t, n in inner:
        sides = [nodes[t, n.leftChild], nodes[t, n.rightChild]]
        assert [a + b for a, b in zip(sides[0].impurityStats, sides[1].impurityStats)] == list(n.impurityStats)
        assert min(s.rawCount for s in sides) > 0 and n.gain > 0
    vectors = ML._assembled(FEATURES).transform(noisy).cache()
    spark_own = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=6, maxDepth=30, featureSubsetStrategy="2", seed=1).fit(vectors)
    right = [m.transform(vectors).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] for m in (model, spark_own)]
    assert abs(right[0] - right[1]) < 0.03


def test_a_fit_is_few_jobs_however_deep(spark, noisy):
    """Spark's own forest runs jobs for each level, some 25 here."""
    context, few = spark.sparkContext, {}
    for depth in (2, 30):
        context.setJobGroup(f"depth-{depth}", "forest")
        model = ML.fit_forest(noisy, FEATURES, "label", mtry=2, trees=5, depth=depth)
        few[depth] = len(context.statusTracker().getJobIdsForGroup(f"depth-{depth}"))
        assert max(t.depth for t in model.stages[-1].trees) <= depth
    context.setLocalProperty("spark.jobGroup.id", None)
    assert max(t.depth for t in model.stages[-1].trees) > 10 and abs(few[30] - few[2]) <= 2


def test_a_fit_does_not_depend_on_partitions(noisy):
    one, other = (ML.fit_forest(noisy.repartition(k), FEATURES, "label", mtry=2, trees=3) for k in (1, 7))
    assert [t.toDebugString.split("\n", 1)[1] for t in one.stages[-1].trees] == [t.toDebugString.split("\n", 1)[1] for t in other.stages[-1].trees]


def test_few_values_are_all_thresholds(spark):
    rows = spark.range(3000).select(F.array((F.col("id") % 5).cast("double"), F.lit(2.0), F.col("id").cast("double")).alias("x"))
    found = G._candidates(rows, 3)
    assert list(found[0]) == [0.0, 1.0, 2.0, 3.0] and len(found[1]) == 0 and len(found[2]) == 31


def test_bins_are_enough_to_score(spark, noisy, monkeypatch):
    """A forest of more nodes than the driver should hold is scored from its folder, and says what Spark's model of it says."""
    forest = ML.fit_forest(noisy, FEATURES, "label", mtry=2, trees=60)
    stage = forest.stages[-1]
    plain = sorted((r.x0, *r.probability, *r.rawPrediction, r.prediction) for r in stage.model.transform(ML._assembled(FEATURES).transform(noisy)).collect())
    stage._model = None
    monkeypatch.setattr(G, "DRIVER_NODES", 0)
    monkeypatch.setattr(G, "_SCORED_ROWS", 700)
    stored = forest.transform(noisy)
    assert stored.columns == [*noisy.columns, "_features", "rawPrediction", "probability", "prediction"]
    found = sorted((r.x0, *r.probability, *r.rawPrediction, r.prediction) for r in stored.collect())
    assert np.abs(np.array(found) - np.array(plain)).max() < 1e-9
    assert ML.predict(forest, noisy).count() == 3000 and stage._model is None


@pytest.mark.parametrize("local_rows", [100_000, 200])
def test_whole_and_split_trees(noisy, local_rows):
    """Without a place for all rows nodes are split over the tasks; small nodes are grown to the same trees."""
    rows = noisy.select(F.col("label").alias("y"), F.array(*FEATURES).alias("x"), F.xxhash64(*FEATURES).alias("k"))
    fit = lambda draws, at: G.fit_trees(rows, draws, 3, "label", 2, 4, 30, 1, 1, at)
    whole, split = fit(G.draws_by_value("k"), None), fit(G.value_draws("k"), local_rows)
    both = [{r.tree: (r.feature, r.bin, r.c0, r.c1) for r in f.stored.collect()} for f in (whole, split)]
    roots = [[(np.frombuffer(t[2], np.int32)[0], np.frombuffer(t[3], np.int32)[0]) for _, t in sorted(b.items())] for b in both]
    assert roots[0] == roots[1] and (local_rows < 3000 or both[0] == both[1])


def test_tasks_draw_as_expressions_do(spark):
    from ledgerlens.operators import bagging

    rows = spark.range(500).select(F.xxhash64("id").alias("k"), F.concat(F.lit("1996 Ö"), "id").alias("name"), F.explode(F.array(F.lit(0), F.lit(7), F.lit(199))).alias("tree"))
    found = rows.select("k", "name", "tree", G.value_draws("k").alias("a"), bagging.draws("name", F.col("tree"), 3).alias("b")).toPandas()
    for tree, mine in found.groupby("tree"):
        assert mine.a.tolist() == G.hashed_draws(mine.k.to_numpy(), tree).tolist()
        assert mine.b.tolist() == G.named_draws([n.encode() for n in mine.name], tree, 3).tolist()


def test_a_row_goes_another_way_with_a_donors_bin():
    rng = np.random.default_rng(8)
    x, donor, y = rng.integers(0, 6, (600, 4)).astype(np.uint8), rng.integers(0, 6, (600, 4)).astype(np.uint8), rng.integers(0, 2, 600)
    grown = G.grow(x, y, np.ones(600), 2, 30, 1, rng)
    nodes = G._unpacked(G._packed(0, grown), 0)[1]
    plain, row, feature, leaf = G.swapped_leaves(nodes, x, donor)
    assert np.array_equal(plain, G._leaves(nodes, x)) and np.array_equal(nodes["left"], grown["left"])
    for j in range(4):
        mixed, want = x.copy(), plain.copy()
        mixed[:, j] = donor[:, j]
        mine = feature == j
        want[row[mine]] = leaf[mine]
        assert np.array_equal(want, G._leaves(nodes, mixed))
