"""First / last row per key.

Each of these filters on `row_number() = 1`, which Spark plans as a group limit before the shuffle: a map
task forwards at most one row per key, so a key that holds a third of the input costs no more than another.
`annual_facts` is the exception: nearly all its rows are the first of their key, so it shuffles them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions.expressions import annual_filing


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key under an explicit order."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def first_per_end(facts: DataFrame, keys: tuple[str, ...] = ("symbol", "ns", "tag")) -> DataFrame:
    """First fact per period end, in document order; facts in different units are different facts."""
    keys = (*keys, "unit") if "unit" in facts.columns else keys
    return first_per_key(facts, [*keys, "end"], [F.col("pos").asc()])


def annual_facts(facts: DataFrame, dedupe: str = "before_filter") -> DataFrame:
    """Facts of annual filings, one per period end.

    By default the first fact per `end` is chosen before the filing filter, so an earlier 10-Q that reports
    the same `end` hides the 10-K. `after_filter` chooses among the annual facts only. Facts are shuffled by firm and
    tag, which is part of this key and of the one of `keep_last`: a following `keep_last` finds its rows together.
    """
    if dedupe == "before_filter":
        return first_per_end(facts.repartition("symbol", "tag")).filter(annual_filing())
    return first_per_end(facts.filter(annual_filing()).repartition("symbol", "tag"))


def keep_last(facts: DataFrame) -> DataFrame:
    """Last fact per (symbol, fy, tag) by period end; a missing end counts as last."""
    return first_per_key(facts, ["symbol", "fy", "tag"], [F.col("end").desc_nulls_first(), F.col("pos").desc()])


def last_per_year(snapshots: DataFrame, date: str = "date", year: str = "year") -> DataFrame:
    """Latest snapshot of each year (nulls included); of two with one date the greater by its other columns."""
    rest = [c for c in snapshots.columns if c not in (date, year)]
    latest = F.max(F.struct(date, *rest)).alias("_last")
    return snapshots.groupBy(year).agg(latest).select(year, "_last.*")
