"""Ratios, changes, accrual regression inputs and the outlier label."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import zero_fill
from ledgerlens.operators.changes import change, change_sql, drop_first_year, lagged

WORKING_CAPITAL = "(CurrentAssets - CurrentLiabilities)"

# Ratio name, numerator, denominator.
RATIO_PARTS = (
    ("AccountsReceivableTurnover", "Revenues", "AccountsReceivable"),
    ("CurrentRatio", "CurrentAssets", "CurrentLiabilities"),
    ("DebtToEquity", "debt", "Equity"),
    ("ROA", "NetIncomeLoss", "Assets"),
    ("ROE", "NetIncomeLoss", "Equity"),
    ("DaysSalesinAccountingReceivable", None, None),
    ("DepreciationOverPlant", "DepreciationAmortization", "PropertyPlantAndEquipment"),
    ("EquityOverFixedAssets", "Equity", "FixedAssets"),
    ("TimesInterestEarned", "EBITDA", "Interest"),
    ("SalesToTotalAssets", "Revenues", "Assets"),
    ("PreTaxIncomeToSales", "PreTaxIncome", "Revenues"),
    ("NetIncomeLossToSales", "NetIncomeLoss", "Revenues"),
    ("SalestoCash", "Revenues", "Cash"),
    ("SalestoWorkingCapital", "Revenues", WORKING_CAPITAL),
    ("SalesToFixedAssets", "Revenues", "FixedAssets"),
    ("WorkingCaitalToAssets", WORKING_CAPITAL, "Assets"),
    ("EBITDAMarginRatio", "EBITDA", "Revenues"),
    ("CashFlowOperationsToDebt", "CashFlowOperations", "debt"),
    ("NetIncomeLossToCashflow", "NetIncomeLoss", "CashFlowOperations"),
)

# Change name and what it is the change of, in column order.
CHANGE_OF = (
    ("ChangeInDepreciation", "DepreciationAmortization"),
    ("ChangeInAssets", "Assets"),
    ("ChangeInRevenues", "Revenues"),
    ("ChangeInCurrentRatio", "CurrentRatio"),
    ("ChangeInDebtToEquity", "DebtToEquity"),
    ("ChangeInWorkingCapital", WORKING_CAPITAL),
    ("ChangeInDaysSalesinAccountingReceivable", "DaysSalesinAccountingReceivable"),
    ("ChangeInDepreciationOverPlant", "DepreciationOverPlant"),
    ("ChangeInEquityOverFixedAssets", "EquityOverFixedAssets"),
    ("ChangeInTimesInterestEarned", "TimesInterestEarned"),
    ("ChangeInSalesToTotalAssets", "SalesToTotalAssets"),
    ("ChangeInPreTaxIncomeToSales", "PreTaxIncomeToSales"),
    ("ChangeInNetIncomeLossToSales", "NetIncomeLossToSales"),
    ("ChangeInSalestoWorkingCapital", "SalestoWorkingCapital"),
    ("ChangeInWorkingCaitalToAssets", "WorkingCaitalToAssets"),
    ("ChangeInEBITDAMarginRatio", "EBITDAMarginRatio"),
    ("ChangeInDebt", "debt"),
)

RATIO_NAMES = [name for name, _, _ in RATIO_PARTS]
CHANGE_NAMES = [name for name, _ in CHANGE_OF]
FEATURES = RATIO_NAMES + CHANGE_NAMES

ACCRUAL_TERMS = ["IV1", "IV2", "IV3", "IV4"]


# 360 / turnover. No receivables on real sales means infinite turnover, hence a genuine 0 days.
DAYS_OF_SALES = (
    "CASE WHEN AccountsReceivable = 0 AND Revenues <> 0 THEN 0D "
    "ELSE try_divide(360D, try_divide(double(Revenues), double(AccountsReceivable))) END"
)


def ratio_columns() -> dict[str, Column]:
    return {
        name: F.expr(DAYS_OF_SALES if over is None else f"try_divide(double({over}), double({under}))")
        for name, over, under in RATIO_PARTS
    }


def ratio_features(panel: DataFrame, fill: bool = True) -> DataFrame:
    """19 ratios. Unfilled ratios stay null where they are not finite; changes are taken on those."""
    with_ratios = panel.withColumns(ratio_columns())
    return zero_fill(with_ratios, RATIO_NAMES) if fill else with_ratios


def change_features(panel: DataFrame, strict_year: bool = False) -> DataFrame:
    """19 ratios and 17 changes of the unfilled values, then zero fill: one window for all changes."""
    base = ratio_features(panel, fill=False)
    changed = base.withColumns({name: change(of, strict_year) for name, of in CHANGE_OF})
    return zero_fill(changed, FEATURES)


def accrual_inputs(features: DataFrame) -> DataFrame:
    """Regression inputs, scaled by the previous year's assets; each firm's first year is dropped."""
    moved = {c: change_sql(c) for c in ("CurrentAssets", "CurrentLiabilities", "Cash", "Revenues", "AccountsReceivable")}
    accrued = (
        f"({moved['CurrentAssets']}) - ({moved['CurrentLiabilities']}) - ({moved['Cash']}) - DepreciationAmortization"
    )
    terms = {
        "DV": accrued,
        "IV1": "1",
        "IV2": f"({moved['Revenues']}) - ({moved['AccountsReceivable']})",
        "IV3": "PropertyPlantAndEquipment",
    }
    scaled = {n: F.expr(f"try_divide(double({t}), double({lagged('Assets')}))") for n, t in terms.items()}
    return drop_first_year(features.withColumns({**scaled, "IV4": F.col("ROA")}))


def ols_coefficients(df: DataFrame, y: str, xs: list[str]) -> list[float]:
    """Intercept and slopes from one pass of normal equations (columns are standardised inside)."""
    complete = df.select(F.col(y).cast("double").alias(y), *[F.col(x).cast("double").alias(x) for x in xs]).na.drop()
    rows = VectorAssembler(inputCols=xs, outputCol="_x").transform(complete)
    model = LinearRegression(featuresCol="_x", labelCol=y, solver="normal", regParam=0.0).fit(rows)
    return [float(model.intercept), *[float(b) for b in model.coefficients]]


def ols_residuals(df: DataFrame, y: str, xs: list[str], name: str = "residual", coefficients: list[float] | None = None) -> DataFrame:
    """Residuals of a pooled least-squares regression with intercept; null where an input is null.

    Coefficients that are given, such as those of a stored state, are used instead of a fit on `df`.
    """
    intercept, *slopes = ols_coefficients(df, y, xs) if coefficients is None else coefficients
    fitted = F.lit(intercept)
    for slope, x in zip(slopes, xs):
        fitted = fitted + F.lit(slope) * F.col(x)
    return df.withColumn(name, F.col(y) - fitted)


def band_label(df: DataFrame, value: str, k: float = 1.0, name: str = "label") -> DataFrame:
    """0 inside mean -/+ k standard deviations (bounds included), else 1."""
    row = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).alias("_m"))
    low, high = F.col("_m.mean") - k * F.col("_m.sd"), F.col("_m.mean") + k * F.col("_m.sd")
    inside = F.col(value).between(low, high)
    return df.withColumn("_m", row.scalar()).withColumn(name, F.when(inside, 0).when(~inside, 1)).drop("_m")


def column_filter(df: DataFrame, coefficients: dict[str, float], digits: int = 3) -> DataFrame:
    """Drop the features whose coefficient rounds to 0."""
    return df.drop(*[term for term, value in coefficients.items() if round(value, digits) == 0])
