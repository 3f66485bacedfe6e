"""Identifier resolution and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import pad_identifier
from ledgerlens.operators.dedup import first_per_key
from ledgerlens.rules import MANUAL_IDENTIFIERS


def manual_identifiers(spark: SparkSession) -> DataFrame:
    """Hand-made last layer of the directory."""
    rows = [F.struct(F.lit(c).cast("bigint").alias("cik_str"), F.lit(t).alias("ticker")) for c, t in MANUAL_IDENTIFIERS]
    return spark.range(1).select(F.inline(F.array(*rows))).withColumn("title", F.lit(None).cast("string"))


def layered_directory(*layers: DataFrame) -> DataFrame:
    """One row per ticker from directories in order of precedence: first layer, then first position.

    Layers have (cik_str, ticker, title) and optionally `position`.
    """
    stacked = None
    for place, layer in enumerate(layers, start=1):
        position = F.col("position") if "position" in layer.columns else F.col("cik_str")
        rows = layer.select(
            F.lit(place).alias("source"), position.cast("bigint").alias("_pos"), "cik_str", "ticker", "title"
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)
    best = first_per_key(stacked, ["ticker"], [F.col("source"), F.col("_pos"), F.col("cik_str")])
    return best.drop("_pos").withColumn("cik", pad_identifier("cik_str"))


def resolve_identifiers(tickers: DataFrame, directory: DataFrame) -> DataFrame:
    """Tickers with their identifier, title and the layer that resolved them; null where unresolved."""
    return tickers.join(directory, "ticker", "left")


def unresolved(tickers: DataFrame, directory: DataFrame) -> DataFrame:
    """Distinct tickers that no layer resolves. A missing ticker is an empty slot, not a company."""
    return tickers.select("ticker").na.drop().distinct().join(directory, "ticker", "left_anti")


def restrict_to_worklist(facts: DataFrame, worklist: DataFrame) -> DataFrame:
    """Facts of the listed (symbol, fy) pairs: a semi-join in place of a loop over years and tickers."""
    return facts.join(worklist.select("symbol", "fy"), ["symbol", "fy"], "left_semi")
