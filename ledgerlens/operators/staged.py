"""Boosted ensembles round by round: scores of every size from one fit, and where validation loss stops falling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.boosting import Progress
from ledgerlens.operators.models import fit_boosting

_LINE = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)|Predict: (\S+)")
_ROWS = 4096


@dataclass(frozen=True)
class Tree:
    """Nodes in order: the feature tested (-1 for a leaf), its threshold, where each side goes on, the leaf's value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (self.feature[at] >= 0).any():
            inner = self.feature[at] >= 0
            low = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
        return self.value[at]


def _tree(text: str) -> Tree:
    """A tree from the description that Spark gives of it; all its tests are of the form feature <= threshold."""
    tokens = _LINE.findall(text)
    nodes: list[list] = []

    def read(k: int) -> tuple[int, int]:
        kind, feature, _, threshold, value = tokens[k]
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, 0.0])
        if not kind:
            nodes[at][4] = float(value)
            return at, k + 1
        left, k = read(k + 1)
        right, k = read(k + 1)  # passes over the line of the other side
        nodes[at] = [int(feature), float(threshold), left, right, 0.0]
        return at, k

    read(0)
    columns = list(zip(*nodes, strict=True))
    return Tree(*(np.array(c) for c in columns))


def rounds_of(model: PipelineModel) -> list[tuple[float, Tree]]:
    """(weight, tree) of each round. As large as the ensemble, whatever the data: it travels with the tasks."""
    ensemble = model.stages[-1]
    trees = re.split(r"\n *Tree \d+ \(weight [^)]*\):", ensemble.toDebugString)[1:]
    return [(w, _tree(text)) for text, w in zip(trees, ensemble.treeWeights, strict=True)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch[at:at + _ROWS]
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)


def _inputs(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.select(F.col(label).cast("int").alias("truth"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))


def staged_scores(model: PipelineModel, df: DataFrame, features: list[str], label: str, sizes: list[int]) -> DataFrame:
    """(truth, size, score): what the ensembles of the first `size` rounds say, for every row and size."""
    rounds, wanted = rounds_of(model), sorted(set(sizes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for truth, x in _rows(batches):
            margin, done = np.zeros(len(x)), 0
            for size in wanted:
                for weight, tree in rounds[done:size]:
                    margin += weight * tree.predict(x)
                done = size
                yield pa.RecordBatch.from_arrays(
                    [truth, pa.array(np.full(len(x), size, np.int32)), pa.array(1 / (1 + np.exp(-2 * margin)))], ["truth", "size", "score"],
                )

    return _inputs(df, features, label).mapInArrow(score, "truth int, size int, score double")


def staged_losses(model: PipelineModel, df: DataFrame, features: list[str], label: str) -> list[float]:
    """Mean log loss of the rows of `df` after each round: one aggregate, as many sums as rounds from each task."""
    rounds = rounds_of(model)

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(rounds)), 0
        for truth, x in _rows(batches):
            side, margin = np.where(truth.to_numpy() == 1, 1.0, -1.0), np.zeros(len(x))
            for k, (weight, tree) in enumerate(rounds):
                margin += weight * tree.predict(x)
                total[k] += np.logaddexp(0, -2 * side * margin).sum()
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rounds))), pa.array(total), pa.array(np.full(len(rounds), n))], ["round", "loss", "n"])

    parts = _inputs(df, features, label).mapInArrow(lose, "round long, loss double, n long")
    found = parts.groupBy("round").agg((F.sum("loss") / F.sum("n")).alias("loss")).orderBy("round").collect()
    return [r["loss"] for r in found]


def stopping_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """(best round, whether it is final): the first round of least loss, once `patience` rounds have brought none lower."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def first_rounds(model: PipelineModel, rounds: int) -> PipelineModel:
    """The ensemble of the first rounds of a fit, which is the fit of so many rounds."""
    long = model.stages[-1]
    jvm = SparkSession.active()._jvm
    trees = long._new_java_array(list(long._java_obj.trees())[:rounds], jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel)
    weights = long._new_java_array(long.treeWeights[:rounds], jvm.double)
    short = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(long.uid, trees, weights, long.numFeatures, long.numClasses))
    long._copyValues(short)
    short._transfer_params_to_java()
    return PipelineModel([*model.stages[:-1], short])


def fit_boosting_stopped(
    df: DataFrame, validation: DataFrame, features: list[str], label: str, trees: int = 10_000, depth: int = 3,
    learn_rate: float = 0.01, patience: int = 500, seed: int = 1, first: int = 32,
) -> tuple[PipelineModel, int, int]:
    """Boosting that ends where validation loss stops falling: (model, its rounds, rounds of the longest fit).

    The first k rounds of a longer fit are the fit of k rounds, so rounds are doubled from `first` until `stopping_round` is
    final or all `trees` are there: about twice the rounds that are looked at, in place of all of them. Each fit goes on from the one
    before it. The result is that of stopping one long fit: its first trees, which are not fitted again.
    """
    size, progress = min(first, trees), Progress()
    while True:
        model = fit_boosting(df, features, label, trees=size, depth=depth, learn_rate=learn_rate, seed=seed, progress=progress)
        best, final = stopping_round(staged_losses(model, validation, features, label), patience)
        if final or size == trees:
            break
        size = min(2 * size, trees)
    return first_rounds(model, best) if best < size else model, best, size
