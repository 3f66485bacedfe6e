"""Removal of repeated word windows, found by anchors at difference-cover positions (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WINDOW_BASES, Words, chunks, stored, text_column, text_or_empty, with_row_id

#: A difference cover (fixed values): every residue modulo PERIOD is a difference of two members of COVER, so for any
#: two places there is a shift below PERIOD that moves both onto cover positions.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
_COVERED = np.isin(np.arange(PERIOD), COVER)


def _profile(docs: DataFrame) -> DataFrame:
    rows = with_row_id(docs, F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch)
            for first, last in chunks(column):
                split = [x.as_py().encode().split() for x in column[first:last]]
                words = [b" ".join(x) for x in split]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:last], batch.column(1)[first:last],
                    pa.array([len(x) for x in split], pa.int64()), pa.array([w.decode() for w in words]),
                    pa.array([hashlib.sha256(w).hexdigest() for w in words]),
                ], ["row_id", "doc_id", "n_words", "words", "digest"])

    return stored(rows.mapInArrow(profile, "row_id long, doc_id long, n_words long, words string, digest string"), "word-rows")


def _anchors(base: DataFrame, window: int) -> DataFrame:
    """(hash, row_id, place): hashes of window - PERIOD + 1 words at the cover positions of every long enough text."""
    width = window - PERIOD + 1

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, row_ids = text_column(batch, "words"), batch.column(0).to_numpy()
            for first, last in chunks(column):
                words = Words(column, first, last)
                counts = words.counts()
                owner = np.repeat(np.arange(last - first), counts)
                place = np.arange(len(owner)) - words.first_word[owner]
                chosen = _COVERED[place % PERIOD] & words.whole_windows(width)
                yield pa.RecordBatch.from_arrays([
                    pa.array(words.windows(width)[chosen].view(np.int64)), pa.array(row_ids[first:last][owner[chosen]]),
                    pa.array(place[chosen].astype(np.int32)),
                ], ["hash", "row_id", "place"])

    long_enough = base.where(F.col("n_words") >= window).select("row_id", "words")
    return long_enough.mapInArrow(anchors, "hash long, row_id long, place int")


def _windows(involved: DataFrame, window: int) -> DataFrame:
    """(h1, h2, row_id, place) of each window with a shared anchor among its first PERIOD places."""

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, row_ids, places = text_column(batch, "words"), batch.column(0).to_pylist(), batch.column(2)
            for k in range(batch.num_rows):
                words = Words(column, k, k + 1)
                n = len(words.hashes) - window + 1
                shared = np.zeros(len(words.hashes) + PERIOD + 1, np.int32)
                shared[places[k].values.to_numpy()] = 1
                sums = np.concatenate(([0], np.cumsum(shared)))
                starts = np.flatnonzero(sums[PERIOD:PERIOD + n] > sums[:n])
                h1, h2 = (words.windows(window, base)[starts].view(np.int64) for base in WINDOW_BASES)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h1), pa.array(h2), pa.array(np.full(len(starts), row_ids[k], np.int64)), pa.array(starts.astype(np.int32)),
                ], ["h1", "h2", "row_id", "place"])

    return involved.select("row_id", "words", "places").mapInArrow(extended, "h1 long, h2 long, row_id long, place int")


def _remaining(found: DataFrame, window: int) -> DataFrame:
    """(row_id, n_removed, kept) of texts with the places of their repeated windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().split(" ")
                at = np.zeros(len(words) + 1, np.int64)
                starts = places.values.to_numpy()
                at[starts] += 1
                at[starts + window] -= 1
                gone = np.cumsum(at[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(" ".join([w for w, x in zip(words, gone, strict=True) if not x]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row_id", "n_removed", "kept"])

    return found.select("row_id", "words", "places").mapInArrow(cut, "row_id long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, *, window: int = 35) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept (the words left, one space between) and kept_sha256.

    A caller that needs no more than kept_sha256 moves no unchanged text in the last join.

    A word goes if one of the windows of `window` words of its text that cover it also starts anywhere else, in the
    same text or another. All windows are judged on the input.
    1. Of the positions of each text only those of the difference cover are hashed, PERIOD - 1 words shorter than a
       window: two equal windows share such an anchor at the same distance from their starts.
    2. Hashes that occur once are dropped after a map-side count. Around the others the anchor is extended to whole
       windows, hashed with 128 bits, and counted in the same way. Nothing is compared pairwise.
    3. Texts of equal words are counted once: the others of a class add no windows, and all of its words repeat.
    Every step is linear in the words it reads, and a frequent passage is one row per task before each shuffle of
    counts; the joins back to places are between stored tables, which adaptive execution splits where a key is hot.

    A null text has no words, repeated rows are copies of each other, an empty table gives no rows, a null doc_id is
    kept as it is; other columns are not read. `window` must exceed PERIOD.
    """
    if window <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    base = _profile(docs)
    narrow = base.select("row_id", "doc_id", "n_words", "digest")
    classes = stored(
        narrow.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n")).where("n > 1"),
        "word-classes",
    )
    copies = stored(
        narrow.join(classes, "digest").select("row_id", (F.col("row_id") == F.col("first_row")).alias("first")), "word-copies",
    )
    anchors = _anchors(base, window)
    shared = stored(anchors.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "shared-anchors")
    places = anchors.join(shared, "hash").groupBy("row_id").agg(F.collect_list("place").alias("places"))
    places = stored(places.join(copies.where(~F.col("first")), "row_id", "left_anti"), "anchor-places")
    involved = stored(base.select("row_id", "words").join(places, "row_id"), "involved")

    windows = _windows(involved, window)
    repeated = stored(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "repeated-windows")
    starts = windows.join(repeated, ["h1", "h2"]).groupBy("row_id").agg(F.collect_list("place").alias("places"))
    left = _remaining(involved.select("row_id", "words").join(starts, "row_id"), window)
    return _assembled(base, copies, left)


def _assembled(base: DataFrame, copies: DataFrame, left: DataFrame) -> DataFrame:
    """A changed text has what is left of it, a copy nothing, any other text all its words."""
    marked = base.join(copies.select("row_id", F.lit(True).alias("copied")), "row_id", "left").join(left, "row_id", "left")
    copied = F.coalesce("copied", F.lit(False))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return marked.select(
        "doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit("")).otherwise(F.coalesce("kept", "words")).alias("kept"),
        F.when(copied, sha(F.lit(""))).otherwise(F.coalesce(sha(F.col("kept")), "digest")).alias("kept_sha256"),
    )
