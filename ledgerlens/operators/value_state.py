"""Exact quantiles and clipped moments from state that grows batch by batch.

A batch leaves two tables below a path. `values` holds its distinct values with their counts, ordered by column and
bracket; `parts` holds count, mean and squared deviations of every bracket. Brackets are fixed (`STEPS` to a power of
two), so tables of several batches simply lie side by side. A fit over the whole history adds up the small `parts`, finds
the few brackets that hold the wanted ranks, and reads only these from `values`: no row of the history is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import running_totals
from ledgerlens.operators.stats import WINSOR_PROBS, to_long
from ledgerlens.session import cut_lineage

#: Brackets to a power of two: a bracket spans at most 1/64 of its values' size.
STEPS = 64
# Places the exponents of all doubles, -1074 to 1023, above zero.
_SHIFT = 1100

VALUES = "feature string, bracket int, value double, n long, batch long"
PARTS = "feature string, bracket int, n long, mean double, m2 double, batch long"


def with_bracket(long: DataFrame) -> DataFrame:
    """Add `bracket` to rows with a finite `value`: an int that never falls as the value rises.

    The exponent is guessed by a logarithm and set right by comparison with powers of two, which are exact; the division
    by such a power is exact as well. So the bracket is the same on every machine.
    """
    guessed = long.selectExpr("*", "abs(value) AS _a").selectExpr("*", "CASE WHEN _a > 0 THEN cast(floor(log2(_a)) AS int) END AS _g")
    exact = guessed.selectExpr("*", "_g + int(pow(2D, _g + 1) <= _a) - int(pow(2D, _g) > _a) AS _e")
    place = f"(_e + {_SHIFT}) * {STEPS} + int(floor((_a / pow(2D, _e) - 1) * {STEPS})) + 1"
    return exact.selectExpr(*long.columns, f"CASE WHEN _a > 0 THEN int(signum(value)) * ({place}) ELSE 0 END AS bracket")


def store_batch(df: DataFrame, path: str, batch: int, columns: list[str]) -> None:
    """Add a batch to the state below `path`; a batch that is run again replaces what it left (for foreachBatch).

    Finite numbers count; null, NaN and infinite values are left out. An empty batch leaves empty tables.
    """
    rows = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    long = with_bracket(to_long(rows, columns).filter("abs(value) < double('Infinity')"))
    counted = long.groupBy("feature", "bracket", "value").agg(F.count(F.lit(1)).alias("n"))
    parts = long.groupBy("feature", "bracket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count(F.lit(1))).alias("m2"),
    )
    counted.sortWithinPartitions("feature", "bracket", "value").write.mode("overwrite").parquet(_folder(path, "values", batch))
    parts.write.mode("overwrite").parquet(_folder(path, "parts", batch))


def _folder(path: str, table: str, batch: int | None = None) -> str:
    whole = f"{path.rstrip('/')}/{table}"
    return whole if batch is None else f"{whole}/batch={batch}"


def _read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    folder = _folder(path, table)
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "parts", PARTS)


def read_brackets(spark: SparkSession, path: str, wanted: dict[str, list[int]]) -> DataFrame:
    """(feature, bracket, value, n) over all batches of the wanted brackets of each column.

    They are named as literals, so the scan skips all other row groups and pages.
    """
    values = _read(spark, path, "values", VALUES)
    chosen = F.lit(False)
    for feature, brackets in wanted.items():
        chosen = chosen | ((F.col("feature") == feature) & F.col("bracket").isin(*brackets))
    return values.filter(chosen).groupBy("feature", "bracket", "value").agg(F.sum("n").alias("n"))


def _ranks(probs: list[float]) -> list[str]:
    return [f"{side}((total - 1) * {float(p)!r}D)" for p in probs for side in ("floor", "ceil")]


def _located(spark: SparkSession, path: str, probs: list[float]) -> tuple[DataFrame, DataFrame]:
    """Stored (feature, bracket, before, total, needed) and the ranked values of the needed brackets.

    Brackets are bounded by the number format, not by the rows, so a window may order those of a column. What the
    driver collects is bounded by columns and probabilities.
    """
    sums = read_parts(spark, path).groupBy("feature", "bracket").agg(F.sum("n").alias("n")).selectExpr(
        "feature", "bracket", "n", "sum(n) OVER (PARTITION BY feature ORDER BY bracket) - n AS before",
        "sum(n) OVER (PARTITION BY feature) AS total",
    )
    holds = " OR ".join(f"(before <= {r} AND {r} < before + n)" for r in _ranks(probs))
    brackets = cut_lineage(sums.selectExpr("feature", "bracket", "before", "total", f"({holds}) AS needed"))
    wanted: dict[str, list[int]] = {}
    for row in brackets.filter("needed").select("feature", "bracket").collect():
        wanted.setdefault(row["feature"], []).append(row["bracket"])
    slices = cut_lineage(read_brackets(spark, path, wanted))
    bound = sum(map(len, wanted.values()))
    ranked = running_totals(slices, ["feature", "bracket"], "value", ["n"], group_bound=bound)
    placed = ranked.join(F.broadcast(brackets.filter("needed")), ["feature", "bracket"])
    return brackets, cut_lineage(placed.selectExpr("feature", "bracket", "value", "n", "before + before_n AS first", "total"))


def _quantiles(ranked: DataFrame, probs: list[float]) -> DataFrame:
    """(feature, q): continuous quantiles, interpolated between two neighbouring ranks."""
    picked = ranked.groupBy("feature").agg(F.max("total").alias("total"), *[
        F.expr(f"max(CASE WHEN first <= {r} AND {r} < first + n THEN value END) AS _r{i}") for i, r in enumerate(_ranks(probs))
    ])
    blended = []
    for i, p in enumerate(probs):
        place = f"(total - 1) * {float(p)!r}D"
        blended.append(f"_r{2 * i} + (_r{2 * i + 1} - _r{2 * i}) * ({place} - floor({place}))")
    return picked.selectExpr("feature", f"array({', '.join(blended)}) AS q")


def _one_row(table: DataFrame, columns: list[str], value: str, name: str) -> DataFrame:
    fields = ", ".join(f"max(CASE WHEN feature = '{c}' THEN {value} END) AS {c}" for c in columns)
    return table.selectExpr(f"struct({fields}) AS {name}")


def stored_quantiles(spark: SparkSession, path: str, columns: list[str], probs: list[float]) -> DataFrame:
    """One row as of `stats.quantile_row`, of all batches below `path`; null for a column without values."""
    _, ranked = _located(spark, path, probs)
    return _one_row(_quantiles(ranked, probs), columns, "q", "_q")


def stored_normalisation(
    spark: SparkSession, path: str, columns: list[str], probs: tuple[float, float] = WINSOR_PROBS
) -> DataFrame:
    """One row as of `stats.fit_normalisation`, of all batches below `path`: limits, mean and deviation after clipping.

    Brackets below the low limit count as that limit, those above the high one as that, those between keep their stored
    mean and deviations, and the values of the brackets that hold a limit are clipped one by one.
    """
    brackets, ranked = _located(spark, path, list(probs))
    limits = _quantiles(ranked, list(probs)).selectExpr("feature", "q[0] AS low", "q[1] AS high")
    ends = ranked.groupBy("feature").agg(F.min("bracket").alias("least"), F.max("bracket").alias("most"))
    # A row for each column name: the bounds of these broadcasts are known.
    limits = cut_lineage(limits.join(F.broadcast(ends), "feature"))
    kept = brackets.filter("NOT needed").select("feature", "bracket")
    whole = read_parts(spark, path).join(F.broadcast(kept), ["feature", "bracket"]).join(F.broadcast(limits), "feature").selectExpr(
        "feature", "n", "CASE WHEN bracket < least THEN low WHEN bracket > most THEN high ELSE mean END AS mean",
        "CASE WHEN bracket BETWEEN least AND most THEN m2 ELSE 0D END AS m2",
    )
    single = ranked.join(F.broadcast(limits), "feature").selectExpr("feature", "n", "greatest(low, least(high, value)) AS mean", "0D AS m2")
    parts = cut_lineage(whole.unionByName(single))
    means = parts.groupBy("feature").agg(F.sum("n").alias("total"), (F.sum(F.expr("n * mean")) / F.sum("n")).alias("centre"))
    spread = parts.join(F.broadcast(means), "feature").groupBy("feature").agg(
        F.max("centre").alias("mean"),
        F.expr("sqrt(try_divide(sum(m2 + n * (mean - centre) * (mean - centre)), max(total) - 1)) AS sd"),
    )
    fitted = limits.join(F.broadcast(spread), "feature")
    return cut_lineage(_one_row(fitted, columns, "struct(low, high, mean, sd)", "_n"))
