"""Feature table -> selected features and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ledgerlens.operators.features import column_filter
from ledgerlens.operators.metrics import METRICS, select_best
from ledgerlens.operators.models import SCORING_PARAMS, coefficients, fit_balanced
from ledgerlens.operators.resample import FULL_GRIDS, stratified_folds, stratified_split
from ledgerlens.operators.tuning import last_fit, tune_grid, tuning_table
from ledgerlens.plans.feature_table import KEYS, LABEL
from ledgerlens.session import cut_lineage

# Which metric picks the configuration.
SELECTION_METRIC = {"lasso": "accuracy", "forest": "sensitivity", "boosting": "sensitivity", "kernel": "sensitivity"}


def feature_names(table: DataFrame, label: str = LABEL) -> list[str]:
    return [c for c in table.columns if c not in (*KEYS, label, "is_train", "fold")]


def chosen_params(tuning: DataFrame, grid: list[dict], metric: str, config: int | None = None) -> dict:
    """Parameters of configuration `config`, or of the best one by mean `metric`. Unknown names are errors, not guesses."""
    if config is None:
        if metric not in METRICS:
            raise ValueError(f"metric is one of {', '.join(METRICS)}, not {metric}")
        best = select_best(tuning, metric).first()
        if best is None or best["mean"] is None:
            raise ValueError(f"no configuration has a value of {metric}")
        config = best["config"]
    found = [p for p in grid if p["config"] == config]
    if not found:
        raise ValueError(f"the grid has no configuration {config}")
    return {k: v for k, v in found[0].items() if k != "config"}


def tuned_fit(
    kind: str, table: DataFrame, grid: list[dict] | None = None, folds: int = 10, label: str = LABEL,
    key: str = "FY_symbol", seed: int = 1, threads: int = 4, metric: str | None = None, config: int | None = None,
) -> tuple[PipelineModel, DataFrame, DataFrame, DataFrame]:
    """Split, tune on the training part, fit one configuration: (model, tuning, metrics, confusion).

    Without a `grid` the full one is searched. The configuration is the best by `metric`, by default that of
    `SELECTION_METRIC`, or the one named by its number in the grid, `config`.
    """
    grid = FULL_GRIDS[kind] if grid is None else grid
    metric = SELECTION_METRIC[kind] if metric is None else metric
    if config is not None or metric not in METRICS:
        chosen_params(table, grid, metric, config)  # wrong names fail before the search
    features = feature_names(table, label)
    split = stratified_split(table, label, key, seed=seed)
    train = stratified_folds(split.filter("is_train").drop("is_train"), label, key, folds, seed)
    metrics = tune_grid(kind, train, features, label, key, grid, seed=seed, threads=threads)
    tuning = cut_lineage(tuning_table(metrics, grid))
    params = chosen_params(tuning, grid, metric, config)
    model, tested, confusion = last_fit(kind, split, features, label, key, seed, **params)
    return model, tuning, tested, confusion


def filtered_table(table: DataFrame, grid: list[dict] | None = None, folds: int = 10, label: str = LABEL, **choice) -> DataFrame:
    """The feature table without the features whose LASSO coefficient rounds to 0."""
    model, _, _, _ = tuned_fit("lasso", table, grid, folds, label, **choice)
    return column_filter(table, coefficients(model, feature_names(table, label)))


def tuned_models(
    table: DataFrame, grids: dict[str, list[dict]] | None = None, folds: int = 10, label: str = LABEL,
    choices: dict[str, dict] | None = None,
) -> tuple[DataFrame, dict[str, tuple[PipelineModel, DataFrame, DataFrame, DataFrame]]]:
    """The whole training: LASSO leaves a filtered table, on which the other kinds are tuned: (table, kind -> `tuned_fit`).

    `grids` and `choices` (`metric` or `config`) are by kind; the kinds are those of `grids`, by default all. A table of
    which LASSO keeps no feature is an error.
    """
    grids, choices = FULL_GRIDS if grids is None else grids, choices or {}
    kept = cut_lineage(filtered_table(table, grids.get("lasso"), folds, label, **choices.get("lasso", {})))
    if not feature_names(kept, label):
        raise ValueError("LASSO keeps no feature")
    kinds = [k for k in grids if k != "lasso"]
    return kept, {k: tuned_fit(k, kept, grids[k], folds, label, **choices.get(k, {})) for k in kinds}


def scoring_models(
    table: DataFrame, params: dict[str, dict] | None = None, label: str = LABEL, key: str = "FY_symbol", seed: int = 1
) -> dict[str, PipelineModel]:
    """The three models whose votes score new filings."""
    features = feature_names(table, label)
    params = SCORING_PARAMS if params is None else params
    return {kind: fit_balanced(kind, table, features, label, key, seed, **p) for kind, p in params.items()}
