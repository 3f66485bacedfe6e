"""Table and model writers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Write a stage's output. Partitioned output is rebalanced: few files per value, and AQE splits big values."""
    if partition_by:
        df = df.hint("rebalance", partition_by)
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_tuning(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def load_tuning(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
