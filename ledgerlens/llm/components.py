"""Connected components of links, and links within posting lists without all pairs of a list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored


def connected(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component); `component` is some node of the group, nodes without links do not occur.

    Each round, every node points to the neighbour (or itself) that comes first in an order drawn anew, and the links
    are drawn between those; links within a group vanish. The number of groups still linked falls by a constant
    factor, whatever the shape. A round moves the remaining links only, and a hot node is one row after the
    map-side minimum.
    """
    edges = stored(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    steps, turn = [], 0
    while not edges.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: B023, E731
        step = edges.groupBy("a").agg(F.min_by("b", rank(F.col("b"))).alias("b")).select(
            F.col("a").alias("node"), F.when(rank(F.col("b")) < rank(F.col("a")), F.col("b")).otherwise(F.col("a")).alias("to"),
        )
        step = stored(step, "contraction")
        left, right = (step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        edges = stored(
            edges.join(left, "a").join(right, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(),
            "links",
        )
        steps.append(step)
        turn += 1
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        later = step.select(F.col("node").alias("component"), F.col("to").alias("later"))
        found = found.join(later, "component", "left").select("node", F.coalesce("later", "component").alias("component"))
    return stored(found, "components")


def pairs_across(left: DataFrame, fits: str = "true") -> DataFrame:
    """(a, b) of nodes that share a key, lie in different components and meet `fits` (columns, and other_ columns)."""
    right = left.select("key", *(F.col(c).alias(f"other_{c}") for c in left.columns if c != "key"))
    return left.join(right, "key").where(f"node < other_node AND component <> other_component AND {fits}").select(
        F.col("node").alias("a"), F.col("other_node").alias("b"),
    )


def _named(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return stored(postings.withColumn("component", F.col("node")), "postings")
    named = postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return stored(named, "postings")


def _heads(named: DataFrame, turn: int) -> DataFrame:
    """One node of each list that lies in several components: in the first turn the one of greatest weight."""
    chance = F.xxhash64(F.lit(turn), "node")
    order = chance if turn else F.struct("weight", chance)
    found = named.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.max_by(F.struct("node", "component"), order).alias("head"),
    )
    return stored(
        found.where("low <> high").select("key", F.col("head.node").alias("head"), F.col("head.component").alias("head_component")), "heads",
    )


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links between nodes."""
    if labels is None:
        return connected(links)
    sides = [labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab"]
    between = links.join(sides[0], "a", "left").join(sides[1], "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"),
    )
    moves = connected(between).select(F.col("node").alias("component"), F.col("component").alias("later"))
    moved = labels.join(moves, "component", "left").select("node", F.coalesce("later", "component").alias("component"))
    fresh = moves.join(labels.select(F.col("node").alias("component")), "component", "left_anti")
    return stored(moved.unionByName(fresh.select(F.col("component").alias("node"), F.col("later").alias("component"))), "labels")


def link_within(
    postings: DataFrame, test: Callable[[DataFrame], DataFrame], rounds: int = 3, finer: Callable[[DataFrame], DataFrame] | None = None,
    fits: str = "true",
) -> DataFrame:
    """Components of the nodes of (key, node[, weight]) under `test`, which keeps those (a, b) pairs, a < b, that are linked.

    Two nodes that share a key are tested, in one component, or known not to be linked, so the components are those that
    testing all pairs of every list would give. First `rounds` times one node of each list is tested with the list's
    nodes of other components, as many pairs as postings: the one of greatest weight, then some drawn anew. What still
    lies in several components, (key, node, component), may be given to `finer`, which returns other lists that hold
    both ends of every link left between components; they are treated in the same way. Last, pairs of a list that are
    still in different components are tested, if they meet `fits`, which every linked pair meets in some list of both.
    """
    if "weight" not in postings.columns:
        postings = postings.withColumn("weight", F.lit(0))
    labels = None
    for lists in (postings, finer):
        if lists is None:
            continue
        if lists is finer:
            if heads.isEmpty():  # noqa: F821
                break
            postings = finer(named.join(heads.select("key"), "key", "left_semi"))  # noqa: F821
        for turn in range(rounds + 1):
            named = _named(postings, labels)
            heads = _heads(named, turn)
            if turn == rounds or heads.isEmpty():
                break
            pairs = named.join(heads, "key").where("component <> head_component").select(
                F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"),
            )
            labels = merged(labels, stored(test(pairs.distinct()), "tested"))
    if not heads.isEmpty():
        pairs = pairs_across(named.join(heads.select("key"), "key", "left_semi"), fits)
        labels = merged(labels, stored(test(pairs.distinct()), "tested"))
    if labels is None:
        labels = postings.select("node", F.col("node").alias("component")).limit(0)
    return labels
