"""Splits, folds, down-sampling and parameter grids.

Row choice depends on md5(key, seed) only: exact counts, repeatable on any cluster, and independent of how the
rows are partitioned. Ranks come from `ordering.hash_row_number`, so no label is ordered in one task.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.operators.ordering import hash_row_number, join_groups, stable_hash
from ledgerlens.session import broadcast_if_small, cut_lineage


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.7, seed: int = 1) -> DataFrame:
    """Add `is_train`: floor(share * n) rows of every label; rows without a label are a class of their own."""
    ranked = hash_row_number(df, [label], key, seed, "_rn")
    sizes = df.groupBy(label).agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("_take"))
    split = join_groups(ranked, broadcast_if_small(sizes), [label])
    return split.withColumn("is_train", F.col("_rn") <= F.col("_take")).select(*df.columns, "is_train")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 10, seed: int = 1) -> DataFrame:
    """Add `fold` in 0..folds-1, balanced within every label."""
    ranked = hash_row_number(df, [label], key, seed, "_rn")
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % folds).cast("int")).select(*df.columns, "fold")


def downsample(df: DataFrame, label: str, key: str, seed: int = 1) -> DataFrame:
    """Reduce every label to the size of the smallest one."""
    ranked = hash_row_number(df, [label], key, seed, "_rn")
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"))
    return ranked.withColumn("_take", smallest.scalar()).filter(F.col("_rn") <= F.col("_take")).select(*df.columns)


def downsample_folds(df: DataFrame, label: str, key: str, fold: str, folds: list, seed: int = 1) -> DataFrame:
    """Add `models`: the places k in `folds` for which `downsample` of the rows outside `folds[k]` keeps this row.

    A fold's rows of a label are the first ones of the same hash order, so one cut for each label and fold tells them. Totals
    of hash prefixes say in which prefix a cut lies, and only the rows of those prefixes are ordered; no row is shuffled whole.
    """
    keys = df.filter(F.col(fold).isNotNull()).select(
        F.col(label).alias("_l"), F.col(key).alias("_k"), F.col(fold).alias("_f"), stable_hash(key, seed).alias("_h")
    ).withColumn("_b", F.substring("_h", 1, 3))
    places = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(f).alias("left_out")) for k, f in enumerate(folds)])
    counts = keys.groupBy("_l", "_b", "_f").agg(F.count(F.lit(1)).alias("_n")).select("*", F.inline(places))
    sizes = cut_lineage(counts.groupBy("_l", "_b", "model", "left_out").agg(
        F.coalesce(F.sum(F.when(F.col("_f") != F.col("left_out"), F.col("_n"))), F.lit(0)).alias("_n")
    ))
    takes = sizes.groupBy("model", "_l").agg(F.sum("_n").alias("n")).filter("n > 0").groupBy("model").agg(F.min("n").alias("_take"))
    before = Window.partitionBy("_l", "model").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(takes), "model")
    cut = placed.filter((F.col("_off") < F.col("_take")) & (F.col("_off") + F.col("_n") >= F.col("_take")))
    inside = join_groups(keys, F.broadcast(cut.select("_l", "_b", "model", "left_out", (F.col("_take") - F.col("_off")).alias("_need"))), ["_l", "_b"])
    ranked = inside.filter(F.col("_f") != F.col("left_out")).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_l", "model").orderBy("_h", "_k"))
    )
    cuts = ranked.filter("_rn = _need").select("_l", "model", F.struct("_h", "_k").alias("last"))
    # One row for each label: the last kept (hash, key) of every model.
    by_label = cuts.groupBy("_l").agg(F.collect_list(F.struct("model", "last")).alias("_cuts"))
    place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold)) - 1
    named = df.filter(F.col(fold).isNotNull()).withColumns({"_l": F.col(label), "_at": F.struct(stable_hash(key, seed).alias("_h"), F.col(key).alias("_k")), "_place": place})
    joined = join_groups(named, F.broadcast(cut_lineage(by_label)), ["_l"])
    models = F.expr("array_sort(transform(filter(_cuts, c -> c.model <> _place AND _at <= c.last), c -> c.model))")
    return joined.select(*df.columns, models.alias("models"))


def grid_points(**values: list) -> list[dict]:
    """Every combination of parameter values, in order; each with its `config` number."""
    names = list(values)
    return [
        {"config": i, **dict(zip(names, combination))}
        for i, combination in enumerate(product(*values.values()), start=1)
    ]


def grid_column(points: list[dict]) -> Column:
    """The grid as an array of structs, to `inline` next to rows."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in points])


# The full tuning grids, and small ones for everyday runs.
FULL_GRIDS = {
    "lasso": grid_points(penalty=[10 ** (-4.5 + 4.0 * i / 99) for i in range(100)]),
    "forest": grid_points(mtry=list(range(1, 16)), trees=list(range(50, 2001, 50))),
    "boosting": grid_points(trees=list(range(500, 10001, 500)), learn_rate=[0.1, 0.01], depth=[1, 2, 3]),
    "kernel": grid_points(sigma=[1e-5, 1e-4, 1e-3, 1e-2], cost=[10.0 * i for i in range(1, 11)]),
}
SMALL_GRIDS = {
    "lasso": grid_points(penalty=[10**-3.0, 10**-2.0, 10**-1.0]),
    "forest": grid_points(mtry=[3, 7], trees=[10, 20]),
    "boosting": grid_points(trees=[5, 10], learn_rate=[0.1], depth=[1, 3]),
    "kernel": grid_points(sigma=[1e-3, 1e-2], cost=[10.0]),
}
