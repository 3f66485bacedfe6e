"""The four classifiers, prediction, and the vote. Class 1 is the event.

Every `fit_*` takes training rows as they are (down-sample them first, see `fit_balanced`) and returns a
`PipelineModel` that starts from plain feature columns, so key columns can never become predictors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import majority, prediction_text
from ledgerlens.operators import boosting
from ledgerlens.operators.forest import draws_by_value, fit_trees
from ledgerlens.operators.kernel import RandomFourierFeatures
from ledgerlens.operators.resample import downsample
from ledgerlens.session import shared_dir

# Trees of a forest are not pruned: Spark's greatest depth.
FOREST_DEPTH = 30

ROWS_PER_FIT_TASK = 20_000

# Parameters the scoring job uses.
SCORING_PARAMS = {
    "forest": {"mtry": 7, "trees": 200},
    "boosting": {"trees": 1500, "depth": 3, "learn_rate": 0.01},
    "kernel": {"cost": 10.0, "sigma": 0.01},
}


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="_features")


def _checkpointing(df: DataFrame) -> None:
    """Long boosting runs cut their lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))


def fit_lasso(df: DataFrame, features: list[str], label: str, penalty: float = 0.01, seed: int = 1) -> PipelineModel:
    estimator = LogisticRegression(
        featuresCol="_features", labelCol=label, elasticNetParam=1.0, regParam=penalty, standardization=True
    )
    return Pipeline(stages=[_assembled(features), estimator]).fit(df)


def fit_forest(
    df: DataFrame, features: list[str], label: str, mtry: int = 7, trees: int = 200, depth: int = FOREST_DEPTH,
    least_rows: int = 1, seed: int = 1,
) -> PipelineModel:
    """Trees on bootstrap draws. How often a row is drawn follows from its values, so a fit does not depend on partitions."""
    assembler = _assembled(features)
    rows = assembler.transform(df).select(F.col(label).cast("int").alias("y"), vector_to_array("_features").alias("x"))
    model = fit_trees(rows.withColumn("k", F.xxhash64("x", "y", F.lit(seed))), draws_by_value("k"), len(features), label, mtry, trees, depth, least_rows, seed)
    return PipelineModel([assembler, model])


def fit_boosting(
    df: DataFrame, features: list[str], label: str, trees: int = 1500, depth: int = 3, learn_rate: float = 0.01,
    seed: int = 1, progress: boosting.Progress | None = None,
) -> PipelineModel:
    """All rounds in one task where the rows fit there (`boosting`), else Spark's own fit with its jobs for each round.

    A `progress` that goes from fit to fit of the same rows and parameters saves the rounds that are known.
    """
    assembler = _assembled(features)
    if df.count() <= boosting.LOCAL_ROWS:
        rows = assembler.transform(df).select(F.col(label).cast("int").alias("y"), vector_to_array("_features").alias("x"))
        return PipelineModel([assembler, boosting.fit_rounds(rows, len(features), label, trees, depth, learn_rate, seed, progress)])
    _checkpointing(df)
    estimator = GBTClassifier(
        featuresCol="_features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=learn_rate, seed=seed
    )
    return Pipeline(stages=[assembler, estimator]).fit(df)


def fit_kernel(
    df: DataFrame, features: list[str], label: str, cost: float = 10.0, sigma: float = 0.01, dims: int = 256,
    seed: int = 1,
) -> PipelineModel:
    """RBF support-vector machine as a linear one on random Fourier features: regParam = 1 / (C n)."""
    n = df.count()
    lifted = RandomFourierFeatures(inputCol="_features", outputCol="_lifted", seed=seed, sigma=sigma, dims=dims)
    estimator = LinearSVC(
        featuresCol="_lifted", labelCol=label, regParam=1.0 / (cost * max(n, 1)), standardization=False
    )
    return Pipeline(stages=[_assembled(features), lifted, estimator]).fit(df)


FITTERS: dict[str, Callable[..., PipelineModel]] = {
    "lasso": fit_lasso,
    "forest": fit_forest,
    "boosting": fit_boosting,
    "kernel": fit_kernel,
}


@contextmanager
def balanced_rows(df: DataFrame, label: str, key: str, seed: int = 1) -> Iterator[DataFrame]:
    """Down-sampled rows, kept in memory (or on disk) for the many passes of a fit.

    Iterative fits run one short job per pass: tasks hold at least `ROWS_PER_FIT_TASK` rows, so small data does
    not pay for empty tasks and large data keeps all its partitions.
    """
    with fit_rows(downsample(df, label, key, seed)) as kept:
        yield kept


@contextmanager
def fit_rows(df: DataFrame) -> Iterator[DataFrame]:
    """Rows as `balanced_rows` keeps them, already down-sampled."""
    kept = df.persist()
    try:
        yield kept.coalesce(max(1, -(-kept.count() // ROWS_PER_FIT_TASK)))
    finally:
        kept.unpersist()


def fit_balanced(
    kind: str, df: DataFrame, features: list[str], label: str, key: str, seed: int = 1, **params
) -> PipelineModel:
    """Down-sample, then fit."""
    with balanced_rows(df.select(key, label, *features), label, key, seed) as balanced:
        return FITTERS[kind](balanced, features, label, seed=seed, **params)


def predict(model: PipelineModel, df: DataFrame, pred: str = "pred", score: str = "score") -> DataFrame:
    """Add the predicted class and a score that grows with the event's likelihood."""
    output = model.transform(df)
    evidence = "probability" if "probability" in output.columns else "rawPrediction"
    return output.select(
        *df.columns,
        F.col("prediction").cast("int").alias(pred),
        F.element_at(vector_to_array(evidence), 2).alias(score),
    )


def predict_text(model: PipelineModel, df: DataFrame, name: str = "text") -> DataFrame:
    return predict(model, df).withColumn(name, prediction_text("pred"))


def coefficient_table(model: PipelineModel, features: list[str], df: DataFrame) -> DataFrame:
    """(term, estimate) of a LASSO model, largest absolute estimates first. One row per feature."""
    rows = [
        F.struct(F.lit(t).alias("term"), F.lit(float(b)).alias("estimate"))
        for t, b in zip(features, model.stages[-1].coefficients)
    ]
    table = df.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return table.orderBy(F.abs("estimate").desc(), "term")


def coefficients(model: PipelineModel, features: list[str]) -> dict[str, float]:
    return dict(zip(features, (float(b) for b in model.stages[-1].coefficients)))


def vote(df: DataFrame, predictions: list[str], name: str = "overall") -> DataFrame:
    return df.withColumn(name, majority(*predictions))
