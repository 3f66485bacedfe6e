"""Long to wide and wide to long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import two_decimals


def pivot_items(facts: DataFrame, items: tuple[str, ...], keys: tuple[str, ...] = ("symbol", "fy")) -> DataFrame:
    """tag -> column for the listed items; missing ones are null.

    Conditional aggregates over a known list take one shuffle of pre-combined rows, `pivot` would take two.
    (keys, tag) is unique, so `max` only picks the value.
    """
    return facts.filter(F.col("tag").isin(*items)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("tag") == i, F.col("val"))).alias(i) for i in items]
    )


def slots_to_long(wide: DataFrame, slots: list[str], key: str = "year") -> DataFrame:
    """One row per (key, slot) with the slot's ticker; slots count from 1."""
    numbered = wide.select(key, *slots).unpivot([key], slots, "slot", "ticker")
    number = F.array_position(F.array(*[F.lit(s) for s in slots]), F.col("slot")).cast("int")
    return numbered.select(key, number.alias("id"), "ticker")


def pivot_metrics(metrics: DataFrame, keys: list[str], names: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """metric -> columns `<measure>_<metric>`."""
    def cell(measure: str, name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col(measure))).alias(f"{measure}_{name}")

    return metrics.groupBy(*keys).agg(*[cell(m, n) for m in measures for n in names])


def report_rows(df: DataFrame, keys: list[str], texts: dict[str, str], numbers: list[str]) -> DataFrame:
    """Name/Value rows of a wide row. `texts` maps columns to display names; numbers get two decimals."""
    shown = df.select(
        *keys, *[F.col(c).cast("string").alias(t) for c, t in texts.items()], *[two_decimals(c).alias(c) for c in numbers]
    )
    return shown.unpivot(keys, [*texts.values(), *numbers], "Name", "Value")
