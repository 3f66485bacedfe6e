"""Panel -> features, label and their normalised form."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.operators.features import (
    ACCRUAL_TERMS, FEATURES, accrual_inputs, band_label, change_features, ols_residuals,
)
from ledgerlens.operators.resample import stratified_split
from ledgerlens.operators.stats import apply_normalisation, fit_normalisation
from ledgerlens.session import cut_lineage

KEYS = ["symbol", "fy", "FY_symbol"]
LABEL = "DiscretionaryAccrualsBinary"


def labelled_features(panel: DataFrame) -> DataFrame:
    """Features, regression inputs, discretionary accruals and label, before winsorizing.

    The inputs are checkpointed: the regression, the band and every later statistic pass over them again.
    """
    inputs = cut_lineage(accrual_inputs(change_features(panel)))
    residuals = ols_residuals(inputs, "DV", ACCRUAL_TERMS, "DiscretionaryAccruals")
    return band_label(residuals, "DiscretionaryAccruals", name=LABEL)


def normalise(
    df: DataFrame, columns: list[str] = FEATURES, winsor: str = "quantile", fit: DataFrame | None = None,
    method: str = "exact",
) -> DataFrame:
    """Winsorize, then z-score. `fit` restricts what both are fitted on (default: all rows of `df`)."""
    return apply_normalisation(df, columns, fit_normalisation(df if fit is None else fit, columns, winsor, method))


def feature_table(panel: DataFrame, winsor: str = "quantile", method: str = "exact", fit_scope: str = "all", seed: int = 1) -> DataFrame:
    """(symbol, fy, FY_symbol, 36 normalised features, label).

    With `fit_scope="train"` limits, means and deviations are those of the training rows of `stratified_split` (same
    `seed`), so nothing of the test rows is in the features that a model learns from; all rows are normalised by them.
    """
    if fit_scope not in ("all", "train"):
        raise ValueError(f"fit_scope is all or train, not {fit_scope}")
    labelled = labelled_features(panel)
    fit = None
    if fit_scope == "train":
        labelled = cut_lineage(labelled)
        fit = stratified_split(labelled, LABEL, "FY_symbol", seed=seed).filter("is_train")
    return normalise(labelled, FEATURES, winsor, fit, method).select(*KEYS, *FEATURES, LABEL)
