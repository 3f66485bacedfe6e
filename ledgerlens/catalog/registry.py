"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage, parts_dropped

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_STAGES: dict[tuple, DataFrame] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator's key, with the SQL that must give the same rows."""
    def register(build: Query) -> Query:
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


def stage(name: str, build: Query) -> Query:
    """A stage output that several queries start from: checkpointed once per session and input, without what was stored on the way."""
    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, name, sf_dir)
        if key not in _STAGES:
            with parts_dropped():
                _STAGES[key] = cut_lineage(build(spark, sf_dir))
        return _STAGES[key]

    return load


def forget() -> None:
    """Let the next query build its stages anew, as a first run would."""
    _STAGES.clear()


def r6(value: Column | str, name: str | None = None) -> Column:
    """Doubles are compared at six decimals; adding 0.0 turns -0.0 into 0.0."""
    column = F.col(value) if isinstance(value, str) else value
    label = name or (value if isinstance(value, str) else None)
    rounded = F.round(column.cast("double"), 6) + F.lit(0.0)
    return rounded.alias(label) if label else rounded
