"""Best-fit packing by a configuration linear program over the length histogram (operator 11)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import chunks, stored, text_column, text_or_empty
from ledgerlens.llm.tokens import ENCODED_BYTES, codec

#: Configurations that are priced at most, how much more than its share of the capacity a long piece weighs, and how fast
#: the weight of a length falls as it is served.
ROUNDS, POWER, RATE = 300, 1.05, 1.0
_PIECES = "part int, place long, doc_id long, piece int, start long, length int, rank long, ids binary"

#: A group of equal sequences: (how many, what each holds as (length, how often), longest first).
Group = tuple[int, tuple[tuple[int, int], ...]]


def best_configuration(weights: np.ndarray, capacity: int) -> Counter:
    """The multiset of lengths of greatest weight that fits `capacity`: unbounded knapsack by dynamic programming.

    `weights[n]` is the weight of length n, 0 for a length that does not occur. best[c] is the greatest weight within c.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    usable = weights[1:]
    for c in range(1, capacity + 1):
        gains = best[c - 1::-1] + usable[:c]
        n = int(gains.argmax())
        if gains[n] > best[c - 1] and usable[n] > 0:
            best[c], last[c] = gains[n], n + 1
        else:
            best[c] = best[c - 1]
    found, c = Counter(), capacity
    while c > 0:
        if last[c]:
            found[int(last[c])] += 1
            c -= int(last[c])
        else:
            c -= 1
    return found


def configuration_program(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[float, Counter]]:
    """Fractional solution of the configuration program, by multiplicative weights: (how much, configuration).

    The program covers `counts` pieces of each length by configurations, multisets of lengths within `capacity`. A length's
    weight starts at its share of the capacity to the power of POWER, which among full configurations prefers those of long
    pieces, and falls by exp(-RATE * share served). Each round prices the configuration of greatest weight and takes as much
    of it as its scarcest length has left, so every round uses a length up; what the rounds leave is for `rounded`.
    """
    lengths = np.array(sorted(counts))
    demand = np.array([counts[n] for n in lengths.tolist()], float)
    place = {n: i for i, n in enumerate(lengths.tolist())}
    served = np.zeros(len(lengths))
    found = []
    for _ in range(rounds):
        left = demand - served
        open_ = left > 0.5
        if not open_.any():
            break
        weights = np.zeros(capacity + 1)
        weights[lengths[open_]] = ((lengths / capacity) ** POWER * np.exp(-RATE * served / demand))[open_]
        configuration = best_configuration(weights, capacity)
        amount = min(left[place[n]] / k for n, k in configuration.items())
        for n, k in configuration.items():
            served[place[n]] += amount * k
        found.append((amount, configuration))
    return found


def rounded(counts: dict[int, int], solution: list[tuple[float, Counter]], capacity: int) -> list[Group]:
    """Whole sequences for all pieces.

    Of each configuration as many copies are taken as the solution says, rounded up, and as what is left of its lengths
    allows. The rest goes, longest first, each to the sequence where it leaves least room, or to a new one. Equal
    sequences are one group throughout, so the work depends on the lengths and not on the pieces.
    """
    left = Counter(counts)
    groups: list[tuple[int, Counter]] = []
    for amount, configuration in solution:
        copies = min(int(np.ceil(amount - 1e-9)), *(left[n] // k for n, k in configuration.items()))
        if copies > 0:
            groups.append((copies, Counter(configuration)))
            for n, k in configuration.items():
                left[n] -= k * copies
    by_room: dict[int, list[tuple[int, Counter]]] = defaultdict(list)
    for copies, held in groups:
        by_room[capacity - sum(n * k for n, k in held.items())].append((copies, held))
    for n in sorted((n for n, k in left.items() if k), reverse=True):
        many, room = left[n], n
        while many and room < capacity:
            # The tightest sequences with room for it; each takes as many as fit, as best fit would give it one by one.
            if not by_room.get(room):
                room += 1
                continue
            copies, held = by_room[room].pop()
            fit = room // n
            filled = min(copies, many // fit)
            if filled:
                by_room[room - fit * n].append((filled, held + Counter({n: fit})))
                many -= filled * fit
            if copies > filled:
                part = min(many, fit - 1) if filled < copies else 0
                if many and part:
                    by_room[room - part * n].append((1, held + Counter({n: part})))
                    many -= part
                    filled += 1
                if copies > filled:
                    by_room[room].append((copies - filled, held))
        if many:
            fit = capacity // n
            if many // fit:
                by_room[capacity - fit * n].append((many // fit, Counter({n: fit})))
            if many % fit:
                by_room[capacity - many % fit * n].append((1, Counter({n: many % fit})))
    return [
        (copies, tuple(sorted(held.items(), reverse=True)))
        for room in sorted(by_room) for copies, held in by_room[room] if copies
    ]


class Places:
    """Where the r-th piece of a length goes, for all lengths and ranks: sequence and offset."""

    def __init__(self, groups: list[Group], capacity: int):
        ranges: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        used, sequence = Counter(), 0
        for copies, held in groups:
            offset = 0
            for n, k in held:
                ranges[n].append((used[n], sequence, k, offset))
                used[n] += copies * k
                offset += n * k
            sequence += copies
        self.sequences = sequence
        flat = [(n, *r) for n in sorted(ranges) for r in ranges[n]]
        self.length, self.first, self.sequence, self.each, self.offset = (
            np.array([x[i] for x in flat], np.int64) for i in range(5)
        )
        self.begin = np.searchsorted(self.length, np.arange(capacity + 2))

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty((2, len(lengths)), np.int64)
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            begin, end = self.begin[n], self.begin[n + 1]
            k = begin + np.searchsorted(self.first[begin:end], ranks[at], "right") - 1
            within = ranks[at] - self.first[k]
            out[0, at] = self.sequence[k] + within // self.each[k]
            out[1, at] = self.offset[k] + within % self.each[k] * n
        return out[0], out[1]


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Stored pieces of all documents: part, place, doc_id, piece, start, length, rank, ids.

    Documents longer than `capacity` are cut into pieces of it, the last may be shorter. `part` is the task that has cut
    a piece, `place` its number there and `rank` its number there among the pieces of its length.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, part = codec(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen, place, step = np.zeros(capacity + 1, np.int64), 0, 4 * capacity
        for batch in batches:
            column, ids = text_column(batch), batch.column(0)
            for first, last in chunks(column, ENCODED_BYTES):
                encoded = [x + end for x in tokens.encode_array(column[first:last])]
                rows = [(d, k) for d, x in enumerate(encoded) for k in range(0, len(x), step)]
                pieces = [encoded[d][k:k + step] for d, k in rows]
                lengths = np.array([len(x) // 4 for x in pieces], np.int64)
                order = np.argsort(lengths, kind="stable")
                in_order = lengths[order]
                ranks = np.empty(len(rows), np.int64)
                ranks[order] = seen[in_order] + np.arange(len(rows)) - np.searchsorted(in_order, in_order)
                seen += np.bincount(lengths, minlength=capacity + 1)
                starts = np.array([k // 4 for _, k in rows], np.int64)
                for at in range(0, len(rows), 1024):
                    some = slice(at, at + 1024)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(rows[some]), part, np.int32)), pa.array(np.arange(place + at, place + at + len(rows[some]))),
                        ids.take(pa.array([first + d for d, _ in rows[some]])), pa.array((starts[some] // capacity).astype(np.int32)),
                        pa.array(starts[some]), pa.array(lengths[some].astype(np.int32)), pa.array(ranks[some]), pa.array(pieces[some], pa.binary()),
                    ], ["part", "place", "doc_id", "piece", "start", "length", "rank", "ids"])
                place += len(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(rows.mapInArrow(cut, _PIECES), "token-pieces")


def pack_best_fit(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """Pack all documents (doc_id, text) into few sequences of at most `capacity` tokens; one row per piece:
    doc_id, piece, start, length, sequence_id, offset, ids (unsigned 32-bit, little-endian).

    1. Texts are encoded once and stored as pieces; the histogram of lengths has `capacity` rows at most.
    2. The driver solves the configuration program of the histogram (`configuration_program`) and rounds it (`rounded`):
       groups of equal sequences, whose number depends on the lengths that occur, not on the documents.
    3. The r-th piece of a length has its place in those groups. r is the piece's rank in its task plus the pieces of that
       length in the tasks before, from a table of counts by task and length: no length, however frequent, is numbered in
       one task, and the pieces are shuffled once.

    A null text is empty (its end id alone), a null doc_id and repeated rows are packed like any other row, equal lengths
    are told apart by their place in the table, an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id)
    per_task = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(rounded(counts, configuration_program(counts, capacity, rounds), capacity), capacity)
    shared = spark.sparkContext.broadcast(places)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch.column("rank").to_numpy() + batch.column("earlier").to_numpy()
            sequence, offset = shared.value.of(batch.column("length").to_numpy(), ranks)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays(
                [*kept, batch.column("length").cast(pa.int64()), pa.array(sequence), pa.array(offset), batch.column("ids")],
                ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"],
            )

    met = pieces.join(earlier, ["part", "length"]).select("doc_id", "piece", "start", "length", "rank", "earlier", "ids")
    return met.mapInArrow(place, "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the sequences that `pack_best_fit` pieces make up, pieces in the order of their offsets."""
    one = F.struct("offset", "length", "ids")
    held = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("held"))
    return held.select(
        "sequence_id", F.aggregate("held", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"),
        F.aggregate("held", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"),
    )
