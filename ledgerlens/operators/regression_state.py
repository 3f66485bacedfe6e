"""Least squares from state that grows batch by batch: counts, means and centred cross-products.

A batch leaves one row of fixed size, whatever its rows. Rows of several batches add up to what one pass over all of
them gives, so a regression over the whole history reads the new batch and the state only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "n long, means array<double>, products array<double>"


def product_state(df: DataFrame, y: str, xs: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, means, products) of the rows in which `y` and all `xs` are numbers; one hash aggregate.

    `means` are those of `xs` and `y`, `products` the sums of products of deviations from them, upper triangle by rows.
    A table or group without such rows leaves n = 0 or no row.
    """
    names = [*xs, y]
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)]).na.drop(subset=[f"_v{i}" for i in range(len(names))])
    columns = [f"_v{i}" for i in range(len(names))]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in columns]).alias("means"),
        F.array(*[F.covar_pop(a, b) * F.count(F.lit(1)) for a, b in pairs]).alias("products"),
    )


def merged_state(states: DataFrame) -> DataFrame:
    """One row (n, means, products) for all rows of `states`; products are moved to the common means."""
    some = states.filter("n > 0").select("n", "means", "products")
    places = some.select("n", F.posexplode("means").alias("i", "mean")).groupBy("i").agg((F.sum(F.expr("n * mean")) / F.sum("n")).alias("mean"))
    centre = places.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda p: p["mean"]).alias("means"))
    moved = some.withColumn("_centre", centre.scalar()).withColumn(
        "moved",
        F.expr("""zip_with(products, flatten(transform(means, (a, i) -> transform(slice(means, i + 1, size(means)), (b, j) ->
            n * (a - _centre[i]) * (b - _centre[i + j])))), (p, q) -> p + q)"""),
    )
    sums = moved.select("n", "_centre", F.posexplode("moved").alias("k", "product")).groupBy("k").agg(
        F.sum("n").alias("n"), F.first("_centre").alias("means"), F.sum("product").alias("product"),
    )
    return sums.agg(
        F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), F.max("means").alias("means"),
        F.transform(F.array_sort(F.collect_list(F.struct("k", "product"))), lambda p: p["product"]).alias("products"),
    )


def state_coefficients(states: DataFrame) -> list[float]:
    """Intercept and slopes of the regression over everything in `states`; the driver solves one small system.

    A column that never varies, or that others determine, shares the least-norm solution. Without rows there is no
    regression: ValueError.
    """
    row = merged_state(states).first()
    if not row["n"]:
        raise ValueError("no row in which all columns are numbers")
    means, m = np.array(row["means"]), len(row["means"])
    products = np.zeros((m, m))
    products[np.triu_indices(m)] = row["products"]
    products = products + np.triu(products, 1).T
    scale = np.sqrt(np.diag(products))
    scale[scale == 0] = 1.0
    scaled = products / np.outer(scale, scale)
    slopes = np.linalg.lstsq(scaled[:-1, :-1], scaled[:-1, -1], rcond=1e-12)[0] * scale[-1] / scale[:-1]
    return [float(means[-1] - slopes @ means[:-1]), *slopes.tolist()]


def store_batch(df: DataFrame, path: str, batch: int, y: str, xs: list[str]) -> None:
    """Add a batch to the state below `path`; a batch that is run again replaces what it left (for foreachBatch)."""
    product_state(df, y, xs).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The state rows of all stored batches."""
    return spark.read.schema(f"{STATE}, batch long").option("basePath", path).parquet(path)
