"""Exact global orderings without a single-task sort.

`row_number()` or a running sum over a whole table, or over a label that holds most of it, would run in one
task. Here rows first fall into many ordered buckets; bucket totals (a small table) give every bucket its
offset, and only the rows of one bucket are ordered together. Results equal the plain window exactly.

The join of the offsets and the bucket window share one key, so the rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.session import broadcast_if_small, cut_lineage

# A search among bounds takes 8 x 8 places, hash orderings have 16^3. Longer comparison chains make generated methods too
# large for the JVM to compile (8000 bytes), which costs far more than finer buckets gain.
FAN_OUT = 8

# One row of bounds is about 600 bytes: 6 MB in all.
MAX_BOUND_GROUPS = 10_000

#: Rows of a bucket beyond which it is split again.
BUCKET_ROWS = 50_000


def stable_hash(key: str, seed: int) -> Column:
    """Repeatable pseudo-random order of rows: md5 of the key and a seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")).cast("binary"))


def join_groups(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null is a group like any other; the keys come from `df`."""
    named = table.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = None
    for k in keys:
        equal = df[k].eqNullSafe(named[f"_g_{k}"])
        same = equal if same is None else same & equal
    return df.join(named, same, how).drop(*(f"_g_{k}" for k in keys))


def hash_row_number(df: DataFrame, groups: list[str], key: str, seed: int, name: str) -> DataFrame:
    """1-based rank of each row within its group under `stable_hash(key, seed)`.

    `key` must be unique; null is a group of its own. Hash prefixes are the buckets, so they are even whatever
    the group sizes are.
    """
    hashed = df.withColumn("_h", stable_hash(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # The offsets window sees bucket totals only: at most 4096 rows per group.
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    in_bucket = Window.partitionBy(*groups, "_b").orderBy("_h", key)
    ranked = join_groups(hashed, offsets, [*groups, "_b"]).withColumn(
        name, (F.row_number().over(in_bucket) + F.col("_off")).cast("bigint")
    )
    return ranked.select(*df.columns, name)


def _bounds(value: str) -> Column:
    probs = [i / FAN_OUT**2 for i in range(1, FAN_OUT**2)]
    return F.percentile_approx(value, probs, 2000).alias("_q")


def _with_bounds(df: DataFrame, groups: list[str], value: str, group_bound: int | None) -> DataFrame:
    """Attach approximate quantiles of the group to every row.

    One row of bounds per group: broadcast where the caller knows that groups are few, else after counting.
    """
    if not groups:
        return df.withColumn("_q", df.agg(_bounds(value)).scalar())
    bounds = df.groupBy(*groups).agg(_bounds(value))
    if group_bound is not None and group_bound <= MAX_BOUND_GROUPS:
        return join_groups(df, F.broadcast(cut_lineage(bounds)), groups)
    return join_groups(df, broadcast_if_small(cut_lineage(bounds), MAX_BOUND_GROUPS), groups)


def _placed(df: DataFrame, columns: list[str], value: str, name: str) -> DataFrame:
    """Replace the bounds `_q` by the place of `value` among them, 0 where there are none.

    Any bounds give exact results downstream; good bounds only make the buckets even. They are searched in
    two steps, coarse then fine: 2 x 7 comparisons in generated code. A place is never null, which also
    keeps the optimizer from testing the whole comparison chain for null in a join condition.
    """
    coarse = " + ".join(f"int({value} > _q[{i * FAN_OUT - 1}])" for i in range(1, FAN_OUT))
    fine = " + ".join(f"int({value} > _q[_c * {FAN_OUT} + {j}])" for j in range(FAN_OUT - 1))
    searched = df.selectExpr("*", f"coalesce({coarse}, 0) AS _c")
    return searched.selectExpr(*columns, f"bigint(coalesce(_c * {FAN_OUT} + {fine}, 0)) AS {name}")


def _value_buckets(
    df: DataFrame, groups: list[str], value: str, group_bound: int | None, bucket_rows: int
) -> DataFrame:
    """Add `_b`, an ordered bucket of `value` within its group, so many that none has much more than `bucket_rows` rows.

    A group begins with 64 buckets. What is still too large is split by 64 once more, with bounds of its own, until all
    fit: a group of 10^10 values takes two more passes over it, small ones none but the
    count of rows per bucket. Values of a group are distinct, so every split makes progress.
    """
    return _buckets_with_totals(df, groups, value, [], group_bound, bucket_rows)[0]


def _buckets_with_totals(
    df: DataFrame, groups: list[str], value: str, sums: list[str], group_bound: int | None, bucket_rows: int
) -> tuple[DataFrame, DataFrame]:
    """`_value_buckets` and, stored, the total of each of `sums` in every bucket, from the pass that counts its rows."""
    bucketed = _placed(_with_bounds(df, groups, value, group_bound), df.columns, value, "_b")
    keys = [*groups, "_b"]
    while True:
        totals = cut_lineage(bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_t_{s}") for s in sums]))
        large = totals.filter(F.col("_n") > bucket_rows).select(*keys)
        if large.isEmpty():
            return bucketed, totals
        inside = join_groups(bucketed, broadcast_if_small(cut_lineage(large)), keys)
        bounds = broadcast_if_small(cut_lineage(inside.groupBy(*keys).agg(_bounds(value))), MAX_BOUND_GROUPS)
        finer = _placed(join_groups(bucketed, bounds, keys, "left"), bucketed.columns, value, "_p")
        bucketed = finer.selectExpr(*df.columns, f"_b * {FAN_OUT**2} + _p AS _b")


def running_totals(
    df: DataFrame, groups: list[str], value: str, sums: list[str], group_bound: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add `before_<s>`: the total of `s` over all smaller values of the group.

    `df` has one row per (group, value); aggregate equal values first, which also absorbs heavy ties, and store it: it
    is read for bounds, bucket sizes and totals.
    `group_bound` is the number of groups where the caller knows it. Null is a group of its own.
    """
    bucketed, totals = _buckets_with_totals(df, groups, value, sums, group_bound, bucket_rows)
    earlier = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_b", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    inside = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = join_groups(bucketed, offsets, [*groups, "_b"])
    return joined.select(
        *df.columns, *[(F.col(f"_o_{s}") + F.sum(s).over(inside) - F.col(s)).alias(f"before_{s}") for s in sums]
    )
