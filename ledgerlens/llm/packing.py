"""Cost-balanced packing of documents into training sequences (operator 1)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import chunks, text_column, text_or_empty
from ledgerlens.llm.tokens import ENCODED_BYTES, codec

_OUT = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64()), ("ids", pa.binary()),
])
_DDL = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"
)


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Place documents of these lengths; return (document, start, length, sequence, offset) per piece.

    As many sequences as the tokens need are open from the start. The longest piece goes first, to the sequence of
    lowest estimated cost that still has room for it. A piece for which no sequence has room fills the cheapest
    sequence that has any, and the rest of it waits for its turn; a document longer than a sequence is cut first.
    Equal lengths keep the documents' order, equal costs go to the lower sequence.
    """
    total = sum(lengths)
    count = -(-total // capacity)
    cost, room = np.zeros(count), np.full(count, capacity, np.int64)
    queue = []
    for document, length in enumerate(lengths):
        for start in range(0, length, capacity):
            queue.append((-min(capacity, length - start), document, start))
    heapq.heapify(queue)
    placed = []
    while queue:
        minus, document, start = heapq.heappop(queue)
        length = -minus
        fits = room >= length
        if not fits.any():
            fits = room > 0
        sequence = int(np.argmin(np.where(fits, cost, np.inf)))
        taken = int(min(length, room[sequence]))
        placed.append((document, start, taken, sequence, capacity - int(room[sequence])))
        room[sequence] -= taken
        cost[sequence] += linear * taken + quadratic * taken * taken
        if taken < length:
            heapq.heappush(queue, (taken - length, document, start + taken))
    return placed


def pack(
    docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 2, linear: float = 1.0,
    quadratic: float = 1 / 4096, block_bytes: int = 2 << 20,
) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most `capacity` tokens; one row per piece.

    Attention over a piece of n tokens is estimated to cost `linear * n + quadratic * n * n`; `cost` is that of the
    piece. Rows are dealt at random into blocks of about `block_bytes` of text, each of which one task packs by
    `assign`; only a block's last tokens leave padding, so the larger the blocks the less of it. One shuffle, of texts.
    A block holds as many rows of a hot source or key as chance gives it. `ids` are unsigned 32-bit, little-endian.

    A null text is empty (its end id alone), a null doc_id and repeated rows are packed like any other row, ties in
    length are broken by the row's place in the block, an empty table gives no rows, other columns are not read.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_or_empty()).cast("long") + 8), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"),
    )

    def packed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, ids, encoded = codec(tokenizer), np.array([end_id], "<u4").tobytes(), [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            column = text_column(batch)
            for first, last in chunks(column, ENCODED_BYTES):
                encoded += [x + end for x in tokens.encode_array(column[first:last])]
        lengths = [len(x) // 4 for x in encoded]
        base = key[0].as_py() << 32
        pieces = assign(lengths, capacity, linear, quadratic)
        for at in range(0, len(pieces), 1024):
            some = pieces[at:at + 1024]
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[d] for d, *_ in some], pa.int64()),
                pa.array([s for _, s, *_ in some], pa.int64()),
                pa.array([n for _, _, n, _, _ in some], pa.int64()),
                pa.array([lengths[d] for d, *_ in some], pa.int64()),
                pa.array([base + q for _, _, _, q, _ in some], pa.int64()),
                pa.array([o for *_, o in some], pa.int64()),
                pa.array([linear * n + quadratic * n * n for _, _, n, _, _ in some], pa.float64()),
                pa.array([encoded[d][4 * s:4 * (s + n)] for d, s, n, _, _ in some], pa.binary()),
            ], schema=_OUT)

    return rows.groupBy("block").applyInArrow(packed, _DDL)
