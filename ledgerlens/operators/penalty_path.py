"""LASSO for a whole grid of penalties and all folds at once.

A model of 36 features is told from the data by few numbers: sums over rows, weighted by the model's own probabilities.
One pass over the rows yields them for every fold and several penalties, the driver takes a step for each model, and the
next pass follows. The passes depend on the convergence, not on the number of models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.resample import downsample, downsample_folds
from ledgerlens.session import cut_lineage, drop_stored, shuffles_dropped

#: Penalties that are fitted in the same passes; the next ones start from where the last of them ended.
TOGETHER = 25
_ROWS = 2048


@dataclass(frozen=True)
class PenaltyPath:
    """Coefficients (folds, penalties, features) of the features as they are, and intercepts (folds, penalties)."""

    folds: list
    penalties: list[float]
    features: list[str]
    coefficients: np.ndarray
    intercepts: np.ndarray
    passes: int


def fold_members(df: DataFrame, features: list[str], label: str, key: str, fold: str | None, seed: int = 1) -> DataFrame:
    """(models, y, x): each row once, with the folds whose model learns from it. A fold's model learns from the other folds'
    rows, down-sampled. Without `fold` one model."""
    values = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    if fold is None:
        rows = downsample(df, label, key, seed).withColumn("models", F.array(F.lit(0)))
    else:
        folds = sorted(r[0] for r in df.select(fold).distinct().collect())
        rows = downsample_folds(df, label, key, fold, folds, seed).filter(F.size("models") > 0)
    return cut_lineage(rows.select("models", F.col(label).cast("double").alias("y"), values))


def _spread(value: Column) -> Column:
    """Standard deviation; null for a constant, whatever rounding leaves of it."""
    return F.when(F.min(value) < F.max(value), F.stddev_samp(value))


def _products(x: np.ndarray) -> np.ndarray:
    """Products of every two columns, in the order of `triu_indices`."""
    n, width = x.shape
    out, at = np.empty((n, width * (width + 1) // 2)), 0
    for j in range(width):
        np.multiply(x[:, j:], x[:, j:j + 1], out=out[:, at:at + width - j])
        at += width - j
    return out


def _sums(members: DataFrame, width: int, beta: np.ndarray) -> np.ndarray:
    """For each model and penalty: weighted products of (1, x), then sums of (1, x) times (y - p); `beta` is (models, penalties, 1 + features).

    The products of a row are formed once and weighted for all its models in one matrix product.
    """
    pairs = width * (width + 1) // 2
    size = pairs + width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, penalties = beta.shape[:2]
        slopes = beta.reshape(-1, width).T
        total = np.zeros((models * penalties, size))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch[at:at + _ROWS]
                n, y = part.num_rows, part.column(1).to_numpy()
                x = np.column_stack((np.ones(n), part.column(2).flatten().to_numpy().reshape(n, -1)))
                member = np.zeros((n, models, 1))
                member[np.repeat(np.arange(n), part.column(0).value_lengths().to_numpy()), part.column(0).flatten().to_numpy()] = 1.0
                p = 1 / (1 + np.exp(-np.clip(x @ slopes, -30, 30)))
                weights = (np.maximum(p * (1 - p), 1e-5).reshape(n, models, penalties) * member).reshape(n, -1)
                errors = ((y[:, None] - p).reshape(n, models, penalties) * member).reshape(n, -1)
                total[:, :pairs] += weights.T @ _products(x)
                total[:, pairs:] += errors.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "value"])

    # A task sends sums for every model, whatever its rows; their files go before the next pass.
    with shuffles_dropped(members.sparkSession):
        added = members.mapInArrow(partial, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(beta.shape[0] * beta.shape[1] * size)
    out[added.column("place").to_numpy()] = added.column("value").to_numpy()
    return out.reshape(*beta.shape[:2], size)


def _step(hessian: np.ndarray, gradient: np.ndarray, beta: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Coordinate descent on the quadratic model of every fit at once; the intercept, first, is not penalised."""
    found, slope = beta.copy(), gradient + np.einsum("...ij,...j->...i", hessian, beta)
    diagonal = np.maximum(np.einsum("...ii->...i", hessian), 1e-12)
    for _ in range(500):
        largest = 0.0
        for j in range(beta.shape[-1]):
            rest = slope[..., j] - np.einsum("...i,...i->...", hessian[..., j, :], found) + diagonal[..., j] * found[..., j]
            new = rest / diagonal[..., j] if j == 0 else np.sign(rest) * np.maximum(np.abs(rest) - penalty, 0.0) / diagonal[..., j]
            largest = max(largest, float(np.abs(new - found[..., j]).max()))
            found[..., j] = new
        if largest < 1e-9:
            break
    return found


def penalty_path(
    df: DataFrame, features: list[str], label: str, key: str, penalties: list[float], fold: str | None = "fold",
    seed: int = 1, tolerance: float = 1e-6, most_passes: int = 60,
) -> PenaltyPath:
    """Fit logistic models with an L1 penalty on standardised coefficients: every penalty, for every fold's analysis rows.

    The rows that any fold learns from are stored once, with the folds that do. Penalties go from large to small, `TOGETHER` at a time, starting
    from the last of the penalties before; one aggregate a pass gives the weighted sums of all of them.
    """
    members = fold_members(df, features, label, key, fold, seed)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect()) if fold else [None]
    width, order = len(features) + 1, np.argsort(penalties)[::-1]
    moments = members.select(F.explode("models").alias("model"), "y", "x").groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"),
        *[_spread(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(len(features))],
    ).collect()
    n, scale, start = np.zeros(len(folds)), np.ones((len(folds), width)), np.zeros((len(folds), width))
    for r in moments:
        n[r["model"]] = r["n"]
        spread = [r[f"s{j}"] or 0.0 for j in range(len(features))]
        scale[r["model"], 1:] = [s if s > 0 else np.inf for s in spread]  # a constant feature has no coefficient
        rate = min(max(r["rate"], 1e-9), 1 - 1e-9)
        start[r["model"], 0] = np.log(rate / (1 - rate))
    upper, passes = np.triu_indices(width), 0
    found = np.zeros((len(folds), len(penalties), width))
    for at in range(0, len(order), TOGETHER):
        some = order[at:at + TOGETHER]
        beta = np.repeat(start[:, None, :], len(some), axis=1)  # standardised
        lambdas = np.array(penalties)[some][None, :]
        for _ in range(most_passes):
            sums = _sums(members, width, beta / scale[:, None, :]) / n[:, None, None]
            passes += 1
            hessian = np.zeros((*beta.shape, width))
            hessian[..., upper[0], upper[1]] = hessian[..., upper[1], upper[0]] = sums[..., :len(upper[0])]
            hessian /= scale[:, None, :, None] * scale[:, None, None, :]
            new = _step(hessian, sums[..., len(upper[0]):] / scale[:, None, :], beta, lambdas)
            moved = float(np.abs(new - beta).max())
            beta = new
            if moved < tolerance:
                break
        found[:, some] = beta / scale[:, None, :]
        start = beta[:, -1]
    drop_stored(members)
    return PenaltyPath(folds, list(penalties), list(features), found[..., 1:], found[..., 0], passes)


def path_scores(path: PenaltyPath, df: DataFrame, label: str, fold: str, configs: list[int], some: slice = slice(None)) -> DataFrame:
    """(config, fold, truth, pred, score) of every row by all penalties' models of its own fold, which have not seen it, or by `some` of them."""
    coefficients, intercepts, configs = path.coefficients[:, some], path.intercepts[:, some], configs[some]
    place = {f: k for k, f in enumerate(path.folds)}
    values = F.array(*[F.col(f).cast("double") for f in path.features])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch[at:at + _ROWS]
                own = np.array([place[f] for f in part.column(0).to_pylist()], np.int64)
                x = part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)
                margin = np.empty((part.num_rows, len(configs)))
                for f in np.unique(own).tolist():
                    margin[own == f] = x[own == f] @ coefficients[f].T + intercepts[f]
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(configs)))
                chance = 1 / (1 + np.exp(-margin.ravel()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.array(configs, np.int32), part.num_rows)), part.column(0).take(rows), part.column(1).take(rows),
                    pa.array((chance > 0.5).astype(np.int32)), pa.array(chance),
                ], ["config", "fold", "truth", "pred", "score"])

    rows = df.select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("int").alias("truth"), values.alias("x"))
    return rows.mapInArrow(score, "config int, fold int, truth int, pred int, score double")


def entry_penalties(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, entry): the penalty below which a feature would be the first to enter; the greatest one starts the path."""
    pairs = [
        F.struct(F.lit(f).alias("feature"), (F.abs(F.covar_pop(F.col(f).cast("double"), F.col(label).cast("double"))) / _spread(F.col(f).cast("double"))).alias("entry"))
        for f in features
    ]
    return df.agg(F.array(*pairs).alias("pairs")).select(F.inline("pairs"))
