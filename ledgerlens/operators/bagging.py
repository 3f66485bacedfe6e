"""Bagged forests that know, for every tree, the rows it has not seen.

How often a row is drawn for a tree is a function of its key, the tree's number and the seed. So membership is never stored
or collected: whoever scores a row works out anew which trees are out of its bag, on any cluster and after any loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.forest import _SCORED_ROWS, StoredForest, _bytes, _leaves, draws_by_name, fit_trees, named_draws, poisson, swapped_leaves
from ledgerlens.operators.models import FOREST_DEPTH
from ledgerlens.operators.ordering import hash_row_number
from ledgerlens.session import cut_lineage


def draws(key: str, tree: int | Column, seed: int) -> Column:
    """How often a row is drawn for a tree: Poisson with mean 1, by the first 52 bits of md5 of key, seed and tree."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}#"), F.lit(tree).cast("string")).cast("binary"))
    return poisson(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"))


def _as_vectors(df: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    values = F.array(*[F.col(f).cast("double") for f in features])
    return df.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("truth"), values.alias("_x"))


def fit_bagged_trees(
    df: DataFrame, features: list[str], label: str, key: str, mtry: int = 7, trees: int = 200, depth: int = FOREST_DEPTH,
    least_rows: int = 1, seed: int = 1,
) -> StoredForest:
    """A forest whose place t is the tree on the rows that `draws(key, t, seed)` gives it.

    `key` tells rows apart: rows that share one are drawn together, so no copy of a training row is out of bag.
    """
    rows = _as_vectors(df, features, label, key).select(F.col("_k").cast("string").alias("_k"), F.col("truth").alias("y"), F.col("_x").alias("x"))
    by_name = draws_by_name("_k", draws("_k", F.col("tree"), seed), seed)
    return fit_trees(rows, by_name, len(features), "truth", mtry, trees, depth, least_rows, seed)


def _parts(df: DataFrame) -> int:
    return max(1, -(-df.count() // _SCORED_ROWS))


def out_of_bag_scores(
    models: StoredForest, df: DataFrame, features: list[str], label: str, key: str, seed: int = 1,
) -> DataFrame:
    """(key, truth, trees, score) of the rows of `df`: the share of votes for class 1 among the trees that have not seen a row.

    Blocks of rows and of trees meet once, all in one job. A row that every tree has seen has no score and no place in the
    result; with 200 trees that is one row in 10^39.
    """
    kind, width = df.schema[key].dataType, len(features)
    rows = _as_vectors(df, features, label, key).select(F.col("_k").cast("string").alias("_k"), "truth", F.col("_x").alias("x"))

    def score(table: pa.Table, trees: Iterator) -> pa.Table:
        x, keys = _bytes(table.column("x"), width), table.column("_k").cast(pa.binary()).to_pylist()
        unseen, votes = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
        for tree, nodes in trees:
            out = np.flatnonzero(named_draws(keys, tree, seed) == 0)
            unseen[out] += 1
            votes[out] += _says(nodes)[_leaves(nodes, x[out])]
        return pa.table({"_k": table.column("_k"), "truth": table.column("truth"), "trees": pa.array(unseen), "votes": pa.array(votes)})

    met = models.meet(models.coded(rows), _parts(df), score, "_k string, truth int, trees int, votes long", by="_k")
    counted = met.groupBy("_k", "truth").agg(F.sum("trees").alias("trees"), F.sum("votes").alias("votes")).filter("trees > 0")
    return counted.select(F.col("_k").cast(kind).alias(key), "truth", "trees", (F.col("votes") / F.col("trees")).alias("score"))


def out_of_bag_importance(
    models: StoredForest, df: DataFrame, features: list[str], label: str, key: str, seed: int = 1,
) -> DataFrame:
    """(feature, importance): what a tree loses in accuracy on the rows it has not seen when a feature is shuffled, over all trees.

    Two hash orders give every row one donor, joined by rank. Of each tree, unseen rows are scored as they are and once for
    each feature the tree splits on, all trees in one job; the others cannot change its votes and count 0, as does a tree that has seen all rows.
    """
    width = len(features)
    rows = _as_vectors(df, features, label, key).select(F.col("_k").cast("string").alias("_k"), "truth", F.col("_x").alias("x"))
    # Bins are all that a tree looks at.
    coded = cut_lineage(models.coded(rows))
    left = hash_row_number(coded, [], "_k", seed, "_place")
    donors = hash_row_number(coded.select("_k", "x"), [], "_k", seed + 1, "_place").select("_place", F.col("x").alias("d"))
    paired = left.join(donors, "_place").select("_k", "truth", "x", "d")

    def lose(table: pa.Table, trees: Iterator) -> pa.Table:
        x, donor, truth = _bytes(table.column("x"), width), _bytes(table.column("d"), width), table.column("truth").to_numpy()
        keys, found = table.column("_k").cast(pa.binary()).to_pylist(), []
        for tree, nodes in trees:
            out, says = np.flatnonzero(named_draws(keys, tree, seed) == 0), _says(nodes)
            plain, row, swapped, leaf = swapped_leaves(nodes, x[out], donor[out])
            right = says[plain] == truth[out]
            moved = (says[leaf] == truth[out][row]).astype(np.int64) - right[row]
            change = np.bincount(swapped, moved, width).astype(np.int64)
            hits = int(right.sum())
            found.append((tree, -1, hits, len(out)))
            found += [(tree, j, hits + int(change[j]), len(out)) for j in np.unique(nodes["feature"][nodes["feature"] >= 0]).tolist()]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table({"tree": pa.array(columns[0], pa.int32()), "j": pa.array(columns[1], pa.int32()), "hits": pa.array(columns[2], pa.int64()), "n": pa.array(columns[3], pa.int64())})

    met = models.meet(paired, _parts(coded), lose, "tree int, j int, hits long, n long", by="_k")
    # A row for each tree and feature it uses.
    rates = {(r["tree"], r["j"]): r["hits"] / r["n"] for r in met.groupBy("tree", "j").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect() if r["n"]}
    total = [0.0] * width
    for (tree, j), rate in sorted(rates.items()):
        if j >= 0:
            total[j] += rates[tree, -1] - rate
    found = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(x / max(len(models), 1)).alias("importance")) for f, x in zip(features, total)])
    return df.sparkSession.range(1).select(F.inline(found))


def _says(nodes: dict[str, np.ndarray]) -> np.ndarray:
    return (nodes["c1"] > nodes["c0"]).astype(np.int64)
