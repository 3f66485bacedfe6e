"""Cross-entropy difference of two matched n-gram models (operator 9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Words, _mix, chunks, stored, text_column, text_or_empty

#: In place of word hashes: every word below `word_share`, and the start of a text (context only).
RARE, START = 0, 1
#: What a count is of, in the two lowest bits of its key.
PAIR, WORD, CONTEXT, HELD = range(4)
#: Bytes of text in a block (a longer text is a block of its own), and counted keys of a bucket, by expectation.
BLOCK_BYTES, BUCKET_KEYS = 8 << 20, 1 << 20
#: Buckets beyond this number share tasks, which take them one after the other.
MAX_TASKS = 1 << 16

_BLOCK = "doc_ids array<long>, sizes array<int>, words binary, codes binary"
_REQUEST = "bucket long, block long, keys binary, n0 binary, n1 binary"
_ANSWER = "bucket long, block long, words long, c0 binary, c1 binary"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed: high planes of small numbers are zero."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd").decompress(data[8:], n * 8, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").reshape(n)


def _table(rows: list[dict], schema: dict[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema(schema))


_REQUEST_TYPES = {"bucket": pa.int64(), "block": pa.int64(), "keys": pa.binary(), "n0": pa.binary(), "n1": pa.binary()}
_ANSWER_TYPES = {"bucket": pa.int64(), "block": pa.int64(), "words": pa.int64(), "c0": pa.binary(), "c1": pa.binary()}
_BLOCK_TYPES = {"doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "words": pa.binary(), "codes": pa.binary()}


def _coded(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes by falling frequency, and each one's place among them."""
    words, codes, n = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return words[order], place[codes]


def _blocks(docs: DataFrame) -> DataFrame:
    """block, doc_ids, sizes (words of each row), words (hashes of distinct ones), codes (places in `words`)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch)
            for first, last in chunks(column, BLOCK_BYTES):
                found = Words(column, first, last, lower=True)
                words, codes = _coded(found.hashes)
                yield from _table([{
                    "doc_ids": batch.column(0).slice(first, last - first).to_pylist(), "sizes": found.counts().tolist(),
                    "words": words.astype("<u8").tobytes(), "codes": _packed(codes),
                }], _BLOCK_TYPES).to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(rows.mapInArrow(code, _BLOCK).select(F.monotonically_increasing_id().alias("block"), "*"), "lm-blocks")


class _Block:
    """The words of a block, its distinct pairs of neighbours, and the sorted keys of all that it counts."""

    def __init__(self, row: dict, kinds: tuple[int, ...]):
        self.doc_ids, self.sizes = row["doc_ids"], np.array(row["sizes"], np.int64)
        words, codes = np.frombuffer(row["words"], "<u8"), _unpacked(row["codes"]).astype(np.int64)
        start, n = len(words), max(len(words), 1)
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        firsts = np.cumsum(self.sizes) - self.sizes
        before[firsts[self.sizes > 0]] = start
        pairs, pair = np.unique(before * n + codes, return_inverse=True)
        self.before, self.word = pairs // n, pairs % n
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        hashes = np.append(words, np.uint64(START))
        context = _mix(hashes + np.uint64(CONTEXT))
        parts = {
            PAIR: (_mix(context[self.before] * np.uint64(3) + hashes[self.word]), pair), WORD: (_mix(words + np.uint64(WORD)), codes),
            CONTEXT: (context, before), HELD: (context, before),
        }
        #: of each token, the places of its keys
        self.places = {kind: parts[kind][1] for kind in (PAIR, WORD, CONTEXT)}
        self.ends = np.cumsum([0] + [len(parts[kind][0]) for kind in kinds])
        self.kinds, self.words, self.codes = kinds, words, codes
        keys = np.concatenate([(parts[kind][0] & ~np.uint64(3)) | np.uint64(kind) for kind in kinds])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counted(self, weights: np.ndarray) -> np.ndarray:
        """Sums of the tokens' weights, by sorted key."""
        sums = [
            np.bincount(self.places[CONTEXT if kind == HELD else kind], weights, b - a) for kind, a, b in zip(self.kinds, self.ends, self.ends[1:], strict=False)
        ]
        return np.concatenate(sums)[self.order].astype(np.int64)

    def requests(self, block: int, buckets: int, n0: np.ndarray, n1: np.ndarray) -> pa.Table:
        """One row per bucket in which keys of this block are counted; buckets are ranges of keys."""
        bucket = ((self.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        return _table([{
            "bucket": int(bucket[a]), "block": block, "keys": _packed(np.diff(self.keys[a:b], prepend=np.uint64(0))),
            "n0": _packed(n0[a:b]), "n1": _packed(n1[a:b]),
        } for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)], _REQUEST_TYPES)

    def counts(self, answers: list[dict]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By kind the counts in both models, from the answers to this block's requests."""
        answers = sorted(answers, key=lambda row: row["bucket"])
        both = []
        for c in ("c0", "c1"):
            found = np.empty(len(self.keys))
            found[self.order] = np.concatenate([_unpacked(row[c]) for row in answers])
            both.append(found)
        return {kind: (both[0][a:b], both[1][a:b]) for kind, a, b in zip(self.kinds, self.ends, self.ends[1:], strict=False)}


def _target(row: dict) -> np.ndarray:
    """1 for each row of a block that is target."""
    marks = np.zeros(len(row["sizes"]))
    marks[row["targets"] or []] = 1
    return marks


def _answers(requests: DataFrame, tasks: int, least: float, name: str) -> DataFrame:
    """Answers to all requests: each key's counts over all blocks in the order asked; `words` has, once a bucket, its words of `least`."""

    def count(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        asked = [np.cumsum(_unpacked(row["keys"]), dtype=np.uint64) for row in rows]
        keys, place = np.unique(np.concatenate(asked), return_inverse=True)
        c0, c1 = (np.bincount(place, np.concatenate([_unpacked(row[n]) for row in rows]), len(keys)).astype(np.int64) for n in ("n0", "n1"))
        words = int((((keys & np.uint64(3)) == WORD) & (c0 >= least)).sum())
        ends, out = np.cumsum([len(a) for a in asked]), []
        for i, row in enumerate(rows):
            at = place[ends[i] - len(asked[i]):ends[i]]
            out.append({"bucket": row["bucket"], "block": row["block"], "words": 0 if i else words, "c0": _packed(c0[at]), "c1": _packed(c1[at])})
        return _table(out, _ANSWER_TYPES)

    return stored(requests.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(count, _ANSWER), name)


def _with_answers(blocks: DataFrame, answers: DataFrame, tasks: int, use: Callable[[dict, list[dict]], pa.Table], schema: str) -> DataFrame:
    """`use` of each block and the answers to it, in a number of tasks that grows with the table."""

    def one(block: pa.Table, found: pa.Table) -> pa.Table:
        return use(block.to_pylist()[0], found.to_pylist())

    dealt = (df.repartition(tasks, "block").groupBy("block") for df in (blocks, answers))
    return next(dealt).cogroup(next(dealt)).applyInArrow(one, schema)


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, *, word_share: float = 0.0, pair_share: float = 0.0, weight: float = 0.6, add: float = 0.5,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, target_loss, background_loss, score.

    The losses are bits per word of the whole text (ASCII lower case, cut at white space) under the target model, of the
    rows whose doc_id is in `target_ids`, and the background model, of all rows; `score` is target_loss -
    background_loss: the lower, the more a text is like the target.

    Both models keep every counted word and pair. Words below `word_share` of all words can be made one class, and pairs
    below `pair_share` fall back on the words; by default none are. After word v word w has the probability weight *
    c(v, w) / c(v) + (1 - weight * kept(v)) * (c(w) + add) / (N + add * classes), which sums to one; the classes are the
    words and the one of rare words. Losses are -log2 of it.

    Texts are coded once, in blocks. A block counts its own pairs, words and contexts, and asks for the counts over all
    blocks: one row per bucket of hashes, with the sorted keys (62 bits of hash) packed. A bucket adds up what the
    blocks ask, and answers in the same order. So a hot word is one key of a block, and no key has more rows than there
    are blocks; buckets grow in number with the words of the table, and no model is gathered anywhere.

    Null or blank text has no tokens and null losses; a null doc_id is never target; a repeated doc_id is target in each
    of its rows; without target rows the target model is uniform; an empty table gives no rows. Other columns are not
    read.
    """
    blocks = _blocks(docs)
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    places = blocks.select("block", "sizes", F.posexplode("doc_ids").alias("place", "doc_id")).select(
        "block", "place", "doc_id", F.get("sizes", "place").alias("n"),
    )
    targets = places.join(ids.hint("merge"), "doc_id").groupBy("block").agg(F.collect_list("place").alias("targets"), F.sum("n").alias("n"))
    targets = stored(targets, "lm-targets")
    total = [blocks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, n) -> a + n)"))).first()[0] or 0, targets.agg(F.sum("n")).first()[0] or 0]
    buckets = 1 + total[0] // BUCKET_KEYS
    tasks = min(buckets, MAX_TASKS)

    def answers(of: DataFrame, kinds: tuple[int, ...], least: float, name: str) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    block = _Block(row, kinds)
                    n0, n1 = block.counted(np.ones(len(block.codes))), block.counted(_target(row)[block.owner])
                    yield from block.requests(row["block"], buckets, n0, n1).to_batches()

        return _answers(of.join(targets.select("block", "targets"), "block", "left").mapInArrow(ask, _REQUEST), tasks, least, name)

    if word_share > 0:
        least = total[0] * word_share
        found = answers(blocks, (WORD,), least, "word-answers")

        def rename(row: dict, given: list[dict]) -> pa.Table:
            block = _Block(row, (WORD,))
            if len(block.words):
                rare = block.counts(given)[WORD][0] < least
                words, codes = _coded(np.where(rare, np.uint64(RARE), block.words)[block.codes])
                row |= {"words": words.astype("<u8").tobytes(), "codes": _packed(codes)}
            return _table([row], {"block": pa.int64()} | _BLOCK_TYPES)

        blocks = stored(_with_answers(blocks, found, tasks, rename, f"block long, {_BLOCK}"), "lm-class-blocks")
        classes = (found.agg(F.sum("words")).first()[0] or 0) + 1
    kinds = (PAIR, WORD, CONTEXT)
    found = answers(blocks, kinds, 0, "pair-answers").withColumn("held", F.lit(False))
    if word_share <= 0:
        classes = (found.agg(F.sum("words")).first()[0] or 0) + 1
    known = total[0] * pair_share
    if pair_share > 0:
        def ask_held(row: dict, given: list[dict]) -> pa.Table:
            block, held = _Block(row, kinds), _Block(row, (HELD,))
            kept = (block.counts(given)[PAIR][0] >= known)[block.places[PAIR]].astype(float)
            return held.requests(row["block"], buckets, held.counted(kept), held.counted(kept * _target(row)[held.owner]))

        with_targets = blocks.join(targets.select("block", "targets"), "block", "left")
        more = _answers(_with_answers(with_targets, found, tasks, ask_held, _REQUEST), tasks, 0, "held-answers")
        found = found.unionByName(more.withColumn("held", F.lit(True)))

    def score(row: dict, given: list[dict]) -> pa.Table:
        block = _Block(row, kinds)
        counts = block.counts([a for a in given if not a["held"]])
        held = _Block(row, (HELD,)).counts([a for a in given if a["held"]])[HELD] if pair_share > 0 else counts[CONTEXT]
        n, losses = block.sizes, []
        for m in (0, 1):
            pair = np.where(counts[PAIR][0] >= known, counts[PAIR][m], 0)
            seen = np.maximum(counts[CONTEXT][m], 1)
            own = (counts[WORD][m] + add) / (total[m] + add * classes)
            loss = -np.log2((1 - weight * held[m] / seen)[block.before] * own[block.word] + weight * pair / seen[block.before])
            sums = np.bincount(block.owner, loss[block.places[PAIR]], len(n))
            losses.append(pa.array(sums / np.maximum(n, 1), mask=n == 0))
        return pa.table([pa.array(block.doc_ids, pa.int64()), pa.array(n), losses[1], losses[0]], ["doc_id", "n_tokens", "target_loss", "background_loss"])

    scored = _with_answers(blocks, found, tasks, score, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
