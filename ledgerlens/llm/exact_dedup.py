"""Skew-safe exact deduplication by salted digest groups with whole-content comparison (operator 4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACE, stored, text_or_empty, with_row_id

_LAST = (1 << 63) - 1


def normalised(name: str = "text") -> Column:
    """Each run of white space becomes one space; null is empty."""
    return F.regexp_replace(text_or_empty(name), f"{SPACE}+", " ")


def sha256(content: Column) -> Column:
    return F.sha2(F.encode(content, "UTF-8"), 256)


def _combined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row that stays and the size of each group."""
    return rows.groupBy(*keys).agg(
        F.min_by("row_id", F.coalesce("doc_id", F.lit(_LAST))).alias("keep_row"),
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
    )


def exact_groups(
    docs: DataFrame, *, digest: Callable[[Column], Column] = sha256, salts: int = 64, hot_share: float = 0.001,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, digest and the columns named in `carry`.

    Texts are equal if their normalised content is; the row with the smallest doc_id of a group stays. Every stage
    groups by content next to the digest, so a collision of digests joins nothing:
    1. each task combines its own rows (the partial aggregate before the shuffle);
    2. groups of (digest, salt) are merged; only a digest with at least `hot_share` of all rows gets several salts,
       and there are at most 1 / hot_share of those, so their list may be broadcast;
    3. the salt winners of hot digests, at most `salts` rows for each map task's content, are combined globally.
    Winners return to the rows by digest; rows of a digest that has several contents are grouped by their content once
    more and meet their winners by digest and content. Hot digests' winners are that same bounded list, broadcast.

    A null text is empty; a null doc_id is larger than any other; of rows repeating one doc_id and text a single one is
    kept; an empty table gives no rows. `carry` columns come from `docs` as they are, under their own names.
    """
    content = normalised()
    base = stored(
        with_row_id(docs, F.col("doc_id").cast("long").alias("doc_id"), content.alias("content"), digest(content).alias("digest"), *(F.col(c).alias(f"carry_{c}") for c in carry)),
        "exact-rows",
    )
    narrow = base.select("row_id", "doc_id", "digest", *(f"carry_{c}" for c in carry))

    counts = stored(base.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "exact-digests")
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = counts.where(F.col("n") >= max(2, rows * hot_share)).select("digest", F.lit(True).alias("hot"))

    salted = base.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_id"), F.lit(salts))).otherwise(F.lit(0)),
    )
    # Content leaves this stage with hot groups alone: the others are complete, one row for each content.
    merged = stored(
        _combined(salted, ["digest", "hot", "salt", "content"]).withColumn("content", F.when(F.col("hot"), F.col("content"))),
        "exact-merged",
    )
    hot_winners = merged.where("hot").groupBy("digest", "content").agg(
        F.min_by("keep_row", F.coalesce("keep_id", F.lit(_LAST))).alias("keep_row"),
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
    )
    kept = ["keep_row", "keep_id", "group_size"]
    hot_winners = stored(hot_winners.select("digest", *kept), "exact-hot-winners")
    winners = merged.where(F.col("hot").isNull()).select("digest", *kept)
    several = stored(
        winners.unionByName(hot_winners).groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest"),
        "exact-collisions",
    )
    collided = not several.isEmpty()
    plain = narrow
    if collided:
        plain, winners, hot_winners = (x.join(several, "digest", "left_anti") for x in (narrow, winners, hot_winners))
    flagged = plain.join(F.broadcast(hot_winners), "digest", "left")
    found = flagged.where(F.col("group_size").isNotNull()).unionByName(
        flagged.where(F.col("group_size").isNull()).drop(*kept).join(winners, "digest")
    )
    if collided:
        shared = base.join(several, "digest", "left_semi")
        by_content = _combined(shared, ["digest", "content"])
        found = found.unionByName(shared.join(by_content, ["digest", "content"]).select(found.columns))
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "digest",
        *(F.col(f"carry_{c}").alias(c) for c in carry if c != "doc_id"),
    )
