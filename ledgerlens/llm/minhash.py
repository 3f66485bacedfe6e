"""Near-duplicates by an inverted join over MinHash signature coordinates (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Words, chunks, rolling, stored, text_column, text_or_empty, with_row_id
from ledgerlens.llm.components import link_within

_LAST = (1 << 63) - 1
#: Coordinates of a signature, and the chance that a pair at the similarity threshold agrees in fewer than it must.
COORDINATES, MISS = 40, 1e-9
_FACTORS = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = "row_id long, doc_id long, words binary, digest binary, n_shingles long, signature array<long>"


def matches(percent: int) -> int:
    """How many coordinates must agree before two documents are compared: the most that miss a pair at `percent` by a chance under MISS, one at least."""
    p, missed, m = percent / 100, 0.0, 0
    while m < COORDINATES and (missed := missed + comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)) < MISS:
        m += 1
    return max(m, 1)


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document; fewer words than `width` are one shingle."""
    counts = words.counts()
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = words.whole_windows(width)
    hashes, owners = [words.windows(width)[whole]], [owner[whole]]
    for n in range(1, width):
        docs = np.flatnonzero(counts == n)
        if len(docs):
            hashes.append(rolling(words.hashes, n, 2 * n + 1)[words.first_word[docs]])
            owners.append(docs)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return owners[new], hashes[new]


def signatures(owners: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and the least value of each coordinate's hash over them."""
    docs, first = np.unique(owners, return_index=True)
    out = np.empty((len(docs), COORDINATES), np.uint64)
    if len(docs):
        for k, factor in enumerate(_FACTORS):
            out[:, k] = np.minimum.reduceat(hashes * factor, first)
    return docs, out


def profiles(docs: DataFrame, width: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """row_id, doc_id, words (ASCII lower case, one space between), their digest, set size and signature; stored."""
    more = [F.col(c).alias(f"carry_{c}") for c in carry]
    rows = with_row_id(docs, F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *more)
    kinds = "".join(f", `carry_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    names = ["row_id", "doc_id", "words", "digest", "n_shingles", "signature", *(f"carry_{c}" for c in carry)]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch)
            for first, last in chunks(column):
                n = last - first
                owners, hashes = shingle_hashes(Words(column, first, last, lower=True), width)
                known, values = signatures(owners, hashes)
                sizes = np.bincount(owners, minlength=n).astype(np.int64)
                offsets = np.zeros(n + 1, np.int32)
                offsets[known + 1] = COORDINATES
                signature = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(values.reshape(-1).view(np.int64)))
                words = [b" ".join(x.as_py().encode().lower().split()) for x in column[first:last]]
                digest = [hashlib.sha256(x).digest() for x in words]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:last], batch.column(1)[first:last], pa.array(words, pa.binary()),
                    pa.array(digest, pa.binary()), pa.array(sizes), signature,
                    *(c[first:last] for c in batch.columns[3:]),
                ], names)

    return stored(rows.mapInArrow(profile, _ROW + kinds), "profiles")


class _Sets:
    """Shingle sets of texts; the last ones are kept, up to `limit` bytes of text (a set takes some 20 times as much)."""

    def __init__(self, width: int, limit: int = 1 << 21):
        self.width, self.limit, self.used, self.known = width, limit, 0, {}

    def of(self, words: bytes) -> frozenset:
        found = self.known.get(words)
        if found is None:
            parts = words.split(b" ")
            found = frozenset(zip(*(parts[i:] for i in range(self.width)), strict=False)) if len(parts) >= self.width else frozenset([tuple(parts)])
            if self.used + len(words) > self.limit:
                self.known, self.used = {}, 0
            if len(words) <= self.limit:
                self.known[words] = found
                self.used += len(words)
        return found


def similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) pairs whose shingle sets have 100 * intersection >= percent * union.

    Set sizes and agreeing coordinates come first; what is left is confirmed on the whole sets of words.
    """
    left, right = (nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}")) for c in "ab")
    agree = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    likely = pairs.join(left, "a").join(right, "b").where(
        (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (agree >= matches(percent))
    ).select("a", "b")
    both = likely.join(texts.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b").join(
        texts.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a"
    ).select("a", "b", "words_a", "words_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(width)
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = sets.of(x.as_py()), sets.of(y.as_py())
                common = len(one & two)
                kept.append(100 * common >= percent * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(confirm, "a long, b long")


def prefix_postings(left: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Lists of nodes by their rarest shingles, which hold all similar pairs of different components of `left`.

    A node needs `percent` of its shingles in common with a partner. Of its shingles that occur in several components it
    is posted under the rarest only, as many as make sure that two partners meet under one; a node that has too few of
    them is skipped. Edited copies of one text, which share many coordinates but are not similar, go that way.
    """
    open_nodes = stored(left.select("node", "component").distinct(), "open-nodes")
    parts = texts.join(open_nodes, "node").select("node", "component", F.col("words").cast("string").alias("words"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch, "words")
            for first, last in chunks(column):
                owners, hashes = shingle_hashes(Words(column, first, last), width)
                at = pa.array(owners + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes.view(np.int64))], ["node", "component", "key"])

    shingles = parts.mapInArrow(split, "node long, component long, key long")
    spread = stored(
        shingles.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low <> high").select("key", "n"),
        "spread-shingles",
    )
    by_node = Window.partitionBy("node")
    found = shingles.join(spread, "key").join(nodes.select("node", "n_shingles"), "node").withColumns({
        "place": F.row_number().over(by_node.orderBy("n", "key")), "of": F.count(F.lit(1)).over(by_node),
    })
    need = f"(n_shingles * {percent} + 99) div 100"
    return stored(
        found.where(f"place <= of - {need} + 1").select("key", "node", F.col("of").alias("weight"), "n_shingles", (F.col("of") - F.col("place")).alias("room")),
        "prefix-postings",
    )


def _enough_room(percent: int) -> str:
    """At the first shingle that two similar sets share, both have enough later ones for what they must share."""
    need = f"((n_shingles + other_n_shingles) * {percent} + {99 + percent}) div {100 + percent}"
    return f"least(room, other_room) + 1 >= {need}"


def near_groups(docs: DataFrame, *, width: int = 5, percent: int = 85, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept, and the columns named in `carry`.

    1. Documents of equal words are one class; only classes take part in what follows.
    2. A class is posted under each (coordinate, value) of its signature. Values that occur once link nothing, and a
       class with fewer than m = `matches(percent)` shared values is skipped, since no partner could agree in enough.
    3. Of a class's s shared values only the s - m + 1 rarest are kept: two classes that agree in m values
       have one of those in common. Frequent values (passages that many documents share) are thereby not merged.
    4. Lists are linked by `link_within`, from the class with most shared values outwards; a pair is compared by set
       sizes, then agreeing coordinates, then whole sets. What is left apart is searched by `prefix_postings`.

    `component_id` is the smallest doc_id of the component. Null text or text without words has no shingles, is linked
    with nothing and kept. A null doc_id is larger than any other; of rows repeating the smallest doc_id of a component
    one is kept; an empty table gives no rows. Other columns are not read, but for those in `carry`.
    """
    base = profiles(docs, width, carry)
    some = F.col("n_shingles") > 0
    order = F.coalesce("doc_id", F.lit(_LAST))
    classes = stored(
        base.where(some).groupBy("digest").agg(
            F.min("row_id").alias("node"), F.min_by("row_id", order).alias("keep_row"), F.min("doc_id").alias("least_id"),
        ),
        "classes",
    )
    members = classes.select(F.col("node").alias("row_id"))
    nodes = base.where(some).select("row_id", "n_shingles", "signature").join(members, "row_id", "left_semi").withColumnRenamed("row_id", "node")
    nodes = stored(nodes, "nodes")
    values = nodes.select("node", F.posexplode("signature").alias("coordinate", "value")).select(
        "node", F.xxhash64("coordinate", "value").alias("key"),
    )
    shared = stored(values.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-values")
    found = values.join(shared, "key")
    by_node = Window.partitionBy("node")
    postings = found.withColumns({
        "place": F.row_number().over(by_node.orderBy("n", "key")), "of": F.count(F.lit(1)).over(by_node),
    }).where(f"place <= of - {matches(percent)} + 1").select("key", "node", F.col("of").alias("weight"))
    postings = stored(postings, "postings")
    active = postings.select(F.col("node").alias("row_id")).distinct()
    texts = stored(base.select("row_id", "words").join(active, "row_id", "left_semi").withColumnRenamed("row_id", "node"), "texts")
    active_nodes = stored(nodes.join(texts.select("node"), "node", "left_semi"), "active")
    labels = link_within(
        postings, lambda pairs: similar(pairs, active_nodes, texts, width, percent),
        rounds=2, finer=lambda left: prefix_postings(left, active_nodes, texts, width, percent), fits=_enough_room(percent),
    )

    named = classes.join(labels, "node", "left").select("digest", "keep_row", "least_id", F.coalesce("component", "node").alias("component"))
    named = stored(named, "named")
    groups = named.groupBy("component").agg(
        F.min_by("keep_row", F.coalesce("least_id", F.lit(_LAST))).alias("keep_row"), F.min("least_id").alias("component_id"),
    )
    resolved = stored(named.select("digest", "component").join(groups, "component").select("digest", "keep_row", "component_id"), "resolved")
    kept = ["row_id", "doc_id", "n_shingles", *(f"carry_{c}" for c in carry)]
    linked = base.where(some).select(*kept, "digest").join(resolved, "digest").select(
        *kept, "component_id", (F.col("row_id") == F.col("keep_row")).alias("kept"),
    )
    alone = base.where(~some).select(*kept, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone).select(
        "doc_id", "n_shingles", "component_id", "kept", *(F.col(f"carry_{c}").alias(c) for c in carry if c != "doc_id"),
    )
