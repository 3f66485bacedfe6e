"""Column statistics and the transformations fitted on them.

Fitted values travel as one-row scalar subqueries: a single aggregate over the input, then literals in a
narrow projection. Nothing is joined and no row is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

# Winsorizing probabilities, MAD consistency factor and clipping constant.
WINSOR_PROBS = (0.0001, 0.9999)
MAD_SCALE = 1.4826
MAD_CLIP = 2.0

# Rank error of the sketch is 1 / SKETCH; brackets reach twice as far.
SKETCH = 10_000
BRACKET = 2 / SKETCH


def to_long(df: DataFrame, columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> (name, value) rows of doubles."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, name, value)


def column_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, sd): one aggregate over the input for all columns."""
    row = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(c) for c in columns])
    return row.unpivot([], columns, "feature", "m").select("feature", "m.mean", "m.sd")


def z_score(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / sd with the moments of `fit` (default: `df` itself); a constant column becomes 0."""
    moments = (df if fit is None else fit).selectExpr(
        _struct("struct(avg({c}) AS mean, stddev_samp({c}) AS sd)", columns, "_m")
    )
    scaled = "CASE WHEN coalesce(_m.{c}.sd, 0D) <> 0D THEN ({c} - _m.{c}.mean) / _m.{c}.sd WHEN {c} IS NOT NULL THEN 0D END"
    bounded = df.withColumn("_m", moments.scalar())
    return bounded.withColumns({c: F.expr(scaled.format(c=c)) for c in columns}).drop("_m")


def quantile_row(df: DataFrame, columns: list[str], probs: list[float], method: str = "exact") -> DataFrame:
    """One row: struct column -> array of linear-interpolated quantiles. Nulls are ignored.

    `exact` never orders a whole column. An approximate sketch gives a narrow bracket around every quantile;
    exact counts per bracket tell which ones hold the wanted ranks, and only their values are ordered. A poor
    bracket would make that last step larger, never wrong. `approx` is the sketch alone.
    """
    if method == "approx":
        return df.selectExpr(_struct(f"percentile_approx(double({{c}}), {_array(probs)}, 100000)", columns, "_q"))

    edges = sorted({min(1.0, max(0.0, p + side * BRACKET)) for p in probs for side in (-1, 1)})
    values = to_long(df, columns).filter(F.col("value").isNotNull())
    # One row per column name: the bound of this broadcast is known.
    sketch = values.groupBy("feature").agg(F.percentile_approx("value", edges, SKETCH).alias("e"))
    bracket = " + ".join(f"int(value > e[{i}])" for i in range(len(edges)))
    long = values.join(F.broadcast(sketch), "feature").selectExpr("feature", "value", f"coalesce({bracket}, 0) AS bracket")
    # A few brackets per column name: this window and the broadcast below are bounded by the schema.
    brackets = long.groupBy("feature", "bracket").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "feature", "bracket", "n",
        "sum(n) OVER (PARTITION BY feature ORDER BY bracket) - n AS before",
        "sum(n) OVER (PARTITION BY feature) AS total",
    )
    # R's default and the SQL standard's continuous quantile: interpolate between two neighbouring ranks.
    places = [f"(total - 1) * {float(p)!r}D" for p in probs]
    ranks = [f"{side}({place})" for place in places for side in ("floor", "ceil")]
    needed = brackets.filter(" OR ".join(f"(before <= {r} AND {r} < before + n)" for r in ranks))
    ties = (
        long.join(F.broadcast(needed.drop("n")), ["feature", "bracket"])
        .groupBy("feature", "bracket", "value", "before", "total")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    ordered = ties.selectExpr(
        "feature", "value", "total", "m",
        "before + sum(m) OVER (PARTITION BY feature, bracket ORDER BY value) - m AS first",
    )
    picked = ordered.groupBy("feature").agg(F.expr("max(total) AS total"), *[
        F.expr(f"max(CASE WHEN first <= {r} AND {r} < first + m THEN value END) AS _r{i}") for i, r in enumerate(ranks)
    ])
    blended = [
        f"_r{2 * i} + (_r{2 * i + 1} - _r{2 * i}) * ({place} - floor({place}))" for i, place in enumerate(places)
    ]
    quantiles = picked.selectExpr("feature", f"array({', '.join(blended)}) AS q")
    return quantiles.selectExpr(_struct("max(CASE WHEN feature = '{c}' THEN q END)", columns, "_q"))


def _array(numbers: list[float]) -> str:
    return f"array({', '.join(f'{float(x)!r}D' for x in numbers)})"


def _struct(template: str, columns: list[str], name: str) -> str:
    """A struct with one field per column. Wide plans are written as SQL text: one call, not one per operator."""
    return f"struct({', '.join(f'{template.format(c=c)} AS {c}' for c in columns)}) AS {name}"


def quantile_bounds(
    df: DataFrame, columns: list[str], probs: tuple[float, float] = WINSOR_PROBS, method: str = "exact"
) -> DataFrame:
    """One row: struct column -> (low, high) quantiles."""
    row = quantile_row(df, columns, list(probs), method)
    return row.selectExpr(_struct("struct(_q.{c}[0] AS low, _q.{c}[1] AS high)", columns, "_b"))


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns alone, stored: a sketch, the bracket counts and the values in question are three passes over them."""
    return cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))


def mad_bounds(df: DataFrame, columns: list[str], clip_at: float = MAD_CLIP) -> DataFrame:
    """One row: struct column -> median -/+ `clip_at` scaled median absolute deviations."""
    numbers = _numbers(df, columns)
    medians = cut_lineage(quantile_row(numbers, columns, [0.5]))
    centred = numbers.withColumn("_q", medians.scalar())
    deviations = centred.selectExpr(*[f"abs({c} - _q.{c}[0]) AS {c}" for c in columns])
    reach = f"_d.{{c}}[0] * {MAD_SCALE}D * {float(clip_at)!r}D"
    return medians.withColumn("_d", quantile_row(deviations, columns, [0.5]).scalar()).selectExpr(
        _struct(f"struct(_q.{{c}}[0] - {reach} AS low, _q.{{c}}[0] + {reach} AS high)", columns, "_b")
    )


def clip_to(df: DataFrame, columns: list[str], bounds: DataFrame) -> DataFrame:
    """Clip every column to its bounds. Null stays null, unlike with bare greatest / least."""
    clipped = "CASE WHEN {c} IS NOT NULL THEN greatest(_b.{c}.low, least(_b.{c}.high, double({c}))) END"
    bounded = df.withColumn("_b", bounds.scalar())
    return bounded.withColumns({c: F.expr(clipped.format(c=c)) for c in columns}).drop("_b")


def winsorize_quantile(
    df: DataFrame,
    columns: list[str],
    probs: tuple[float, float] = WINSOR_PROBS,
    fit: DataFrame | None = None,
    method: str = "exact",
) -> DataFrame:
    """Clip every column to its quantiles at `probs`, taken from `fit` (default: `df` itself)."""
    source = df if fit is None else fit
    if method == "exact":
        source = _numbers(source, columns)
    return clip_to(df, columns, quantile_bounds(source, columns, probs, method))


def winsorize_mad(df: DataFrame, columns: list[str], clip_at: float = MAD_CLIP, fit: DataFrame | None = None) -> DataFrame:
    """Clip every column to median -/+ `clip_at` scaled MADs, taken from `fit` (default: `df` itself)."""
    return clip_to(df, columns, mad_bounds(df if fit is None else fit, columns, clip_at))


def fit_normalisation(
    df: DataFrame, columns: list[str], winsor: str = "quantile", method: str = "exact"
) -> DataFrame:
    """One stored row, struct column -> (low, high, mean, sd): winsorizing bounds, moments of the clipped values.

    It can be written next to saved models and applied to later rows without touching the history again.
    """
    bounds = cut_lineage(mad_bounds(df, columns) if winsor == "mad" else quantile_bounds(df, columns, method=method))
    moments = clip_to(df.select(*columns), columns, bounds).selectExpr(
        _struct("struct(avg({c}) AS mean, stddev_samp({c}) AS sd)", columns, "_m")
    )
    both = "struct(_b.{c}.low AS low, _b.{c}.high AS high, _m.{c}.mean AS mean, _m.{c}.sd AS sd)"
    return cut_lineage(bounds.withColumn("_m", moments.scalar()).selectExpr(_struct(both, columns, "_n")))


def apply_normalisation(df: DataFrame, columns: list[str], fitted: DataFrame) -> DataFrame:
    """Winsorize and z-score with a `fit_normalisation` row; a constant column becomes 0."""
    scaled = (
        "CASE WHEN {c} IS NULL THEN NULL WHEN coalesce(_n.{c}.sd, 0D) = 0D THEN 0D "
        "ELSE (greatest(_n.{c}.low, least(_n.{c}.high, double({c}))) - _n.{c}.mean) / _n.{c}.sd END"
    )
    bounded = df.withColumn("_n", fitted.scalar())
    return bounded.withColumns({c: F.expr(scaled.format(c=c)) for c in columns}).drop("_n")


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, bin, n) over equal-width, right-closed bins; their number follows Sturges' rule."""
    ranges = df.agg(*[
        F.struct(
            F.min(F.col(c).cast("double")).alias("lo"),
            F.max(F.col(c).cast("double")).alias("hi"),
            F.ceil(F.log2(F.count(c)) + 1).alias("k"),
        ).alias(c)
        for c in columns
    ]).unpivot([], columns, "feature", "r")
    # One row per column name: the bound of this broadcast is known.
    long = to_long(df, columns).filter(F.col("value").isNotNull()).join(F.broadcast(ranges), "feature")
    width = (F.col("r.hi") - F.col("r.lo")) / F.col("r.k")
    place = F.when(F.col("r.hi") == F.col("r.lo"), F.lit(1)).otherwise(
        F.least(F.col("r.k"), F.greatest(F.lit(1), F.ceil(F.try_divide(F.col("value") - F.col("r.lo"), width))))
    )
    return long.groupBy("feature", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], columns, "column", "nulls")


def share_of_total(counts: DataFrame, count: str = "n", name: str = "prop") -> DataFrame:
    """Each row's part of the table's total."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn("_t", total).withColumn(name, F.col(count) / F.col("_t")).drop("_t")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
