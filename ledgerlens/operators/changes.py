"""Row-based lags and changes within a firm.

The window group is one firm's panel rows. (symbol, fy) is the panel's key, so a group has at most one row
per fiscal year, however many facts the firm reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRM_YEARS = "(PARTITION BY symbol ORDER BY fy)"


def lagged(value: str) -> str:
    """SQL for the firm's previous value; the first row refers to itself.

    The SQL function takes a column as its default, `functions.lag` a literal only.
    """
    return f"lag({value}, 1, {value}) OVER {FIRM_YEARS}"


def change_sql(value: str, strict_year: bool = False) -> str:
    """SQL for the difference to the previous row. With `strict_year` a gap between fiscal years gives null."""
    difference = f"{value} - {lagged(value)}"
    if strict_year:
        return f"CASE WHEN fy - lag(fy, 1, fy - 1) OVER {FIRM_YEARS} = 1 THEN {difference} END"
    return difference


def previous(value: str) -> Column:
    return F.expr(lagged(value))


def change(value: str, strict_year: bool = False) -> Column:
    return F.expr(change_sql(value, strict_year))


def drop_first_year(panel: DataFrame) -> DataFrame:
    """Remove every firm's first row; firms with one year vanish."""
    numbered = panel.withColumn("_rn", F.expr(f"row_number() OVER {FIRM_YEARS}"))
    return numbered.filter(F.col("_rn") > 1).drop("_rn")
