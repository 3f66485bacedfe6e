"""Index snapshots -> the work list of non-financial (ticker, year) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import non_financial
from ledgerlens.operators.dedup import last_per_year
from ledgerlens.operators.reshape import slots_to_long
from ledgerlens.rules import CONSTITUENT_YEARS


def constituent_tickers(snapshots: DataFrame, slots: list[str], years: tuple[int, ...] = CONSTITUENT_YEARS) -> DataFrame:
    """(year, id, ticker): the last snapshot of every year, one row per slot."""
    last = last_per_year(snapshots.filter(F.col("year").isin(*years)))
    return slots_to_long(last.drop("date"), slots)


def worklist(tickers: DataFrame, industry_codes: DataFrame) -> DataFrame:
    """(ticker, year) of members with a known, non-financial industry code."""
    coded = tickers.join(industry_codes, "ticker").na.drop()
    return coded.filter(non_financial("sic")).select("ticker", "year")
