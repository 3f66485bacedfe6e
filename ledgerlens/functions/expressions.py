"""Scalar expressions shared by the operators. All of them are built-in, code-generated functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts shown to the user.
MODERATE_TEXT = "Moderate Proxy for Earnings Management"
EXTREME_TEXT = "Extreme Proxy for Earnings Management"
# Overall class and whether the firm engaged; title, year and whether it engaged.
ANONYMOUS_SENTENCE = (
    "Based on the Machine Learning models, the overall prediction is that the company had a %s Upwards/Downwards Proxy for Earnings "
    "Management. This means that the firm likely %s in Earnings Management, based on the Machine Learning models."
)
NAMED_SENTENCE = (
    "Based on the aforementioned predictions, the overall prediction for %s in the year %d is that it %s in Earnings Management"
)

# Metric names and how reports spell them.
METRIC_TITLES = {
    "accuracy": "Accuracy",
    "sensitivity": "Sensitivity",
    "specificity": "Specificity",
    "roc_auc": "ROC-AUC",
}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def annual_filing(form: str = "form", end: str = "end", fy: str = "fy") -> Column:
    """A 10-K fact whose period ends in its own fiscal year."""
    return (F.col(form) == "10-K") & (F.year(F.col(end)) == F.col(fy))


def pad_identifier(cik: Column | str) -> Column:
    """Ten-character company identifier."""
    return F.lpad(_col(cik).cast("string"), 10, "0")


def firm_year_key(fy: Column | str = "fy", symbol: Column | str = "symbol") -> Column:
    return F.concat_ws(" ", _col(fy).cast("string"), _col(symbol))


def non_financial(sic: Column | str = "sic") -> Column:
    """Industry codes that start with 6 are financials. Codes are padded to four digits first."""
    return ~F.lpad(_col(sic), 4, "0").startswith("6")


def tag_search(tag: Column | str, pattern: str) -> Column:
    return _col(tag).rlike(f"(?i){pattern}")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, null where it is not a finite number. Fill with `zero_fill` once changes are derived."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def zero_fill(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Replace null, NaN and infinite values of the given columns by 0."""
    kept = "CASE WHEN {c} IS NULL OR isnan({c}) OR abs({c}) = double('Infinity') THEN 0D ELSE double({c}) END"
    return df.withColumns({c: F.expr(kept.format(c=c)) for c in columns})


def metric_title(metric: Column | str = "metric") -> Column:
    metric = _col(metric)
    title = F.lit(None).cast("string")
    for name, text in METRIC_TITLES.items():
        title = F.when(metric == name, text).otherwise(title)
    return title


def prediction_text(prediction: Column | str) -> Column:
    return F.when(_col(prediction) == 0, MODERATE_TEXT).otherwise(EXTREME_TEXT)


def majority(*votes: Column | str) -> Column:
    """Two of three moderate (0) votes decide."""
    moderate = sum((F.when(_col(v) == 0, 1).otherwise(0) for v in votes), F.lit(0))
    return F.when(moderate >= 2, "Moderately").otherwise("Extremely")


def two_decimals(value: Column | str) -> Column:
    number = _col(value).cast("double")
    return F.when(number.isNotNull(), F.format_string("%.2f", number))
