"""Benchmark decontamination by greedy string tiling (operator 2)."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import Words, chunks, stored, text_column, text_or_empty

_TOKEN = re.compile(r"[^\W_]+")
#: Benchmarks of up to so many words are sent to every task (some 20 bytes a word); larger ones are joined by shuffle.
BROADCAST_WORDS = 1_000_000
LEAKS = "array<struct<item_id: long, item_words: int, matched_words: int, coverage: double, tiles: array<struct<item_start: int, doc_start: int, length: int>>>>"
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def tokens(text: str) -> list[str]:
    """Words in lower case, without punctuation."""
    return _TOKEN.findall(text.lower())


def tile(doc: list[str], item: list[str], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item_start, doc_start, length) of the longest matches first, none overlapping.

    Places where `least` words agree are found by a running Karp-Rabin hash over both texts and checked word by word.
    Those on one diagonal join into maximal matches. The longest match is marked, again and again; a match that has
    lost words to a marked one is cut to what is unmarked and waits for its turn. Ties: first in the item, then in the
    document.
    """
    def running(words: list[str]) -> Iterator[tuple[int, int]]:
        top, value = pow(_BASE, least - 1, _MOD), 0
        codes = [hash(w) % _MOD for w in words]
        for k, code in enumerate(codes):
            if k >= least:
                value = (value - codes[k - least] * top) % _MOD
            value = (value * _BASE + code) % _MOD
            if k >= least - 1:
                yield k - least + 1, value

    at = defaultdict(list)
    for i, value in running(item):
        at[value].append(i)
    diagonals = defaultdict(list)
    for j, value in running(doc):
        for i in at.get(value, ()):
            if item[i:i + least] == doc[j:j + least]:
                diagonals[j - i].append(i)
    queue = []
    for shift, starts in diagonals.items():
        first = last = None
        for i in [*starts, None]:
            if first is not None and i != last + 1:
                queue.append((-(last + least - first), first, first + shift))
                first = None
            first, last = (i, i) if first is None else (first, i)
    heapq.heapify(queue)
    in_item, in_doc, found = bytearray(len(item)), bytearray(len(doc)), []
    while queue:
        minus, i, j = heapq.heappop(queue)
        free = [not (in_item[i + k] or in_doc[j + k]) for k in range(-minus)]
        if all(free):
            found.append((i, j, -minus))
            in_item[i:i - minus] = in_doc[j:j - minus] = b"\1" * -minus
            continue
        begin = 0
        for k, ok in enumerate([*free, False]):
            if not ok:
                if k - begin >= least:
                    heapq.heappush(queue, (begin - k, i + begin, j + begin))
                begin = k + 1
    return found


def _leak(item_id: int, item: list[str], doc: list[str], least: int, share: float) -> dict | None:
    tiles = tile(doc, item, least)
    matched = sum(n for *_, n in tiles)
    if matched < share * len(item) - 1e-9:
        return None
    return {
        "item_id": item_id, "item_words": len(item), "matched_words": matched, "coverage": matched / len(item),
        "tiles": [{"item_start": i, "doc_start": j, "length": n} for i, j, n in tiles],
    }


def _spaced(column: pa.Array) -> pa.Array:
    return pa.array([" ".join(tokens(x.as_py())) for x in column], pa.string())


def _seeds(column: pa.Array, least: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and (row, place, hash) of every run of `least` words of a column of spaced tokens."""
    words = Words(column, 0, len(column))
    owner = np.repeat(np.arange(len(column)), words.counts())
    whole = words.whole_windows(least)
    place = np.arange(len(owner)) - words.first_word[owner]
    return words, owner[whole], place[whole], words.windows(least)[whole]


def _arrow_leaks() -> pa.DataType:
    piece = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])
    return pa.list_(pa.struct([
        ("item_id", pa.int64()), ("item_words", pa.int32()), ("matched_words", pa.int32()), ("coverage", pa.float64()), ("tiles", pa.list_(piece)),
    ]))


def _in_tasks(docs: DataFrame, items: list[tuple[int, str]], least: int, share: float) -> DataFrame:
    """With every item in every task: seeds are looked up where the documents are, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([*docs.schema.fields, T.StructField("leaks", T._parse_datatype_string(LEAKS))])
    names = [*docs.columns, "leaks"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = [x.split() for _, x in shared.value]
        _, rows, places, hashes = _seeds(pa.array([x for _, x in shared.value], pa.string()), least)
        order = np.argsort(hashes, kind="stable")
        rows, places, hashes = rows[order], places[order], hashes[order]
        for batch in batches:
            column = text_column(batch)
            for first, last in chunks(column):
                spaced, out = _spaced(column[first:last]), [[] for _ in range(last - first)]
                if len(hashes):
                    _, doc, _, value = _seeds(spaced, least)
                    low, high = np.searchsorted(hashes, value), np.searchsorted(hashes, value, "right")
                    covered = defaultdict(set)
                    for k in np.flatnonzero(high > low):
                        for s in range(low[k], high[k]):
                            covered[int(doc[k]), int(rows[s])].update(range(places[s], places[s] + least))
                    for (d, r), words in sorted(covered.items()):
                        # No tiling covers more words than its seeds do.
                        if len(words) >= share * len(split[r]) - 1e-9:
                            leak = _leak(shared.value[r][0], split[r], spaced[d].as_py().split(), least, share)
                            out[d] += [leak] if leak else []
                kept = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, _arrow_leaks())], names)

    return docs.mapInArrow(look, schema)


def _by_shuffle(docs: DataFrame, items: DataFrame, least: int, share: float) -> DataFrame:
    """Seeds of both sides meet in a join; a pair whose seeds could cover enough of the item is tiled."""
    base = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "tiling-rows")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch)
            for first, last in chunks(column):
                _, row, place, value = _seeds(_spaced(column[first:last]), least)
                yield pa.RecordBatch.from_arrays([
                    pa.array(value.view(np.int64)), batch.column(0)[first:last].take(pa.array(row)), pa.array(place.astype(np.int32)),
                ], ["seed", "row", "place"])

    kind = "seed long, row long, place int"
    of_items = stored(items.select(F.col("item_row").alias("row"), "text").mapInArrow(seeds, kind), "item-seeds")
    of_docs = base.select(F.col("__row").alias("row"), text_or_empty().alias("text")).mapInArrow(seeds, kind)
    hits = of_docs.select("seed", F.col("row").alias("__row")).distinct().join(of_items.select("seed", F.col("row").alias("item_row"), "place"), "seed")
    places = hits.groupBy("__row", "item_row").agg(F.collect_set("place").alias("places"))
    texts = base.select("__row", text_or_empty().alias("text")).join(places, "__row")
    pairs = texts.join(items.select("item_row", "item_id", F.col("text").alias("item")), "item_row").select("__row", "text", "item_id", "item", "places")
    one = T._parse_datatype_string(LEAKS).elementType

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaks = [], []
            for pair in batch.to_pylist():
                item = pair["item"].split()
                if len({p + k for p in pair["places"] for k in range(least)}) >= share * len(item) - 1e-9:
                    leak = _leak(pair["item_id"], item, tokens(pair["text"]), least, share)
                    if leak:
                        rows.append(pair["__row"])
                        leaks.append(leak)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(leaks, _arrow_leaks().value_type)], ["__row", "leak"])

    found = pairs.mapInArrow(check, T.StructType([T.StructField("__row", T.LongType()), T.StructField("leak", one)]))
    lists = found.groupBy("__row").agg(F.sort_array(F.collect_list("leak")).alias("leaks"))
    empty = F.from_json(F.lit("[]"), T._parse_datatype_string(LEAKS))
    return base.join(lists, "__row", "left").withColumn("leaks", F.coalesce("leaks", empty)).select(*docs.columns, "leaks")


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, *, least: int = 5, share: float = 0.8, broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """All rows and columns of `docs` and `leaks`: the benchmark items whose words the text holds, with their tiles.

    An item leaks into a text if greedy string tiling with matches of `least` words or more covers at least `share` of
    the item's words, in whatever order the passages come. Words are lower case and without punctuation. Texts and
    items that share no seed of `least` words, or too few to cover enough, are not tiled. A benchmark of up to
    `broadcast_words` words goes to every task; a larger one is joined by shuffle, with the same result.

    A null text holds nothing. Items without text, or of fewer than `least` words, are too short to tell and match
    nothing. Repeated items are reported each, an empty table on either side leaks nothing. A column of `docs` named
    `leaks` is replaced.
    """
    docs = docs.drop("leaks")
    numbered = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))

    def spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _spaced(text_column(batch))], ["item_id", "text"])

    items = numbered.mapInArrow(spaced, "item_id long, text string").withColumn("item_row", F.monotonically_increasing_id())
    items = stored(items, "benchmark-items")
    words = items.agg(F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0)).alias("n")).first()["n"]
    if words <= broadcast_words:
        known = [(r["item_id"], r["text"]) for r in items.orderBy("item_id", "item_row").collect()]
        return _in_tasks(docs, known, least, share)
    return _by_shuffle(docs, items, least, share)
