"""Extendible hashing of documents into shards of bounded bytes (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored, text_or_empty, with_row_id

#: Bits of the hash; the first half comes from doc_id, the second tells rows of one doc_id apart.
BITS = 62
#: Levels added to the directory in one pass over the rows that still need them.
LEVELS = 12


def key_bits(doc_id: Column, row_id: Column) -> Column:
    """62 bits, first bit highest: 31 of md5(doc_id as text), then 31 that differ for rows repeating a doc_id."""
    high = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    return F.shiftleft(F.shiftright(high, 1), 31).bitwiseOR(F.xxhash64(row_id).bitwiseAND(F.lit((1 << 31) - 1)))


def _prefix(bits: str | Column, depth: int | Column) -> Column:
    return F.expr(f"shiftright({bits}, {BITS} - {depth})")


def shard_directory(rows: DataFrame, limit: int) -> DataFrame:
    """Leaf buckets of (bits, bytes) rows: depth, prefix, shard_bytes, shard_docs, stored.

    A bucket is a prefix of the hash; it is a leaf if its bytes fit the limit and its parent's do not. Rows are summed
    once at the deepest level of a pass and the sums are added up level by level, so a pass reads rows once; only rows
    in buckets that are still too large go to the next pass. A single row over the limit ends alone at full depth.
    """
    depth, leaves, open_rows = 0, [], rows
    while True:
        last = min(depth + LEVELS, BITS)
        cells = stored(
            open_rows.groupBy(_prefix("bits", last).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")),
            "shard-cells",
        )
        levels = cells.select(F.explode(F.sequence(F.lit(depth), F.lit(last))).alias("depth"), "cell", "bytes", "docs")
        sums = levels.groupBy("depth", F.expr(f"shiftright(cell, {last} - depth)").alias("prefix")).agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"),
        )
        sums = stored(sums, "shard-levels")
        over = F.col("shard_bytes") > limit
        split = sums.where(over & (F.col("depth") < BITS)).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        done = sums.where(~over | (F.col("depth") == BITS))
        leaf = done.join(split, ["depth", "prefix"], "left_semi") if depth else done.where("depth = 0").unionByName(
            done.where("depth > 0").join(split, ["depth", "prefix"], "left_semi")
        )
        leaves.append(leaf if not depth else leaf.where(F.col("depth") > depth))
        open_cells = sums.where(over & (F.col("depth") == last) & (F.lit(last) < BITS)).select(F.col("prefix").alias("cell"))
        if last == BITS or open_cells.isEmpty():
            break
        open_rows = open_rows.withColumn("cell", _prefix("bits", last)).join(open_cells, "cell", "left_semi").drop("cell")
        depth = last
    directory = leaves[0]
    for more in leaves[1:]:
        directory = directory.unionByName(more)
    return stored(directory, "shard-directory")


def assign_shards(docs: DataFrame, *, limit: int = 16 << 20) -> DataFrame:
    """One row per document: doc_id, bytes (UTF-8), depth, shard (the prefix as a string of bits), shard_bytes, shard_docs.

    A shard whose bytes exceed `limit` splits on the next bit of its documents' hash, others stay as they are, until
    every shard fits. Only a single document larger than the limit makes a shard over it, of its own.
    A null text has 0 bytes, a null doc_id hashes as an empty one, rows repeating a doc_id count each, an empty table
    gives no rows; other columns are not read. No document's text leaves its task.
    """
    rows = stored(
        with_row_id(docs, F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("bytes"))
        .select("doc_id", "bytes", key_bits(F.col("doc_id"), F.col("row_id")).alias("bits")),
        "shard-rows",
    )
    directory = shard_directory(rows, limit)
    depths = sorted(r["depth"] for r in directory.select("depth").distinct().collect())  # at most 63 values
    out = None
    for depth in depths:
        some = rows.withColumn("prefix", _prefix("bits", depth)).join(directory.where(F.col("depth") == depth), "prefix")
        out = some if out is None else out.unionByName(some)
    if out is None:
        out = rows.withColumn("prefix", F.lit(0).cast("long")).join(directory, "prefix")
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select("doc_id", "bytes", "depth", name.alias("shard"), "shard_bytes", "shard_docs")
