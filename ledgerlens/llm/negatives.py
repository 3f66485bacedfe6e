"""Hard negatives by rotated one-bit codes whose deterministic score intervals filter the candidates (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import stored
from ledgerlens.llm.vectors import ROWS, by_length, commonest_length, scaled
from ledgerlens.session import scratch_path

#: Bytes of the anchors that one pass over all rows serves (about; they are dealt by hash), and pairs held at a time.
BLOCK_BYTES, PAIRS = 8 << 20, 1 << 20
#: Bits that an anchor's rotated entries are rounded to, and a margin for rounding of doubles, as a share of the norms.
ANCHOR_BITS, SLACK = 6, 1e-9
_CODES = "row_id long, vec_id long, label int, size int, code binary, alignment double, norm double, x binary"


@lru_cache(maxsize=4)
def rotation(size: int, seed: int = 1) -> np.ndarray:
    """A random rotation; the same for one size everywhere."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer vectors -> (codes, alignments, norms).

    A code has the signs of the rotated vector, as bits of 64-bit words; read as a unit vector, with entries of
    1 / root(size) either sign, its inner product with the vector is norm * alignment.
    """
    n, size = x.shape
    turned = x @ rotation(size)
    signs = np.zeros((n, -(-size // 64) * 64), bool)
    signs[:, :size] = turned >= 0
    codes = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
    norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    aligned = np.abs(turned).sum(axis=1) / np.sqrt(size)
    return codes, np.where(norms > 0, np.minimum(aligned / np.where(norms > 0, norms, 1.0), 1.0), 1.0), norms


def intervals(anchors: np.ndarray, codes: np.ndarray, alignment: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score that each anchor can have with each coded row: anchors by rows.

    Let c be the row's code vector, a its alignment, b the anchor's inner product with c. Anchor and row each have a part
    along c and a residual across it; the residuals' product is at most the product of their lengths (Cauchy-Schwarz), so
    the score is a * norm * b, give or take norm * root(1 - a^2) * root(|anchor|^2 - b^2). b is read off bit planes: the
    rotated anchor is rounded to `ANCHOR_BITS` bits, each plane's AND with the code is counted, and what rounding can
    change widens the interval.
    """
    size = anchors.shape[1]
    turned = anchors @ rotation(size)
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-300) / ((1 << ANCHOR_BITS) - 1)
    levels = np.rint((turned - low) / step).astype(np.int64)
    counts = np.zeros((len(anchors), len(codes)), np.int32)
    padded = np.zeros((len(anchors), codes.shape[1] * 64), bool)
    for b in range(ANCHOR_BITS):
        padded[:, :size] = (levels >> b) & 1
        planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        for w in range(codes.shape[1]):
            counts += np.bitwise_count(planes[:, w][:, None] & codes[:, w][None, :]).astype(np.int32) << b
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    # Sum of the rounded entries where the code has ones, minus that where it has not.
    plus = counts * step + low * ones
    whole = levels.sum(axis=1, keepdims=True) * step + low * size
    root = np.sqrt(size)
    b = (2 * plus - whole) / root
    off = step / 2 * root
    length = np.sqrt((anchors.astype(float) ** 2).sum(axis=1, keepdims=True))
    least = np.maximum(np.abs(b) - off, 0.0)  # of |b|, which makes the residual longest
    across = norms * np.sqrt(np.maximum(1 - alignment**2, 0.0)) * np.sqrt(np.maximum(length**2 - least**2, 0.0))
    along = norms * alignment
    wide = across + along * off + SLACK * (length * norms + 1)
    return along * b - wide, along * b + wide


def exact_scores(anchors: np.ndarray, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Integer inner products of anchors and rows where `asked`, 0 elsewhere."""
    out = np.zeros(asked.shape, np.int64)
    bound = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if bound >= 1 << 63:
        raise ValueError("a score is beyond 64 bits")
    if bound < 1 << 53 and asked.mean() > 1 / 16:
        return np.where(asked, (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64), 0)
    i, j = np.nonzero(asked)
    for at in range(0, len(i), 1 << 15):
        p, q = i[at:at + (1 << 15)], j[at:at + (1 << 15)]
        out[p, q] = np.einsum("ij,ij->i", anchors[p], rows[q])
    return out


class _Best:
    """The k best (score, id) of each of some lists: greater scores first, ties by smaller id."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.owner = np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Score that a newcomer must reach to matter, by list.
        self.least = np.full(lists, np.iinfo(np.int64).min)

    def add(self, owners: np.ndarray, scores: np.ndarray, asked: np.ndarray, ids: np.ndarray) -> None:
        """Scores by (list, row), those that are `asked`; `owners` names the lists."""
        k = self.k
        if asked.shape[1] > k:
            ranked = np.where(asked, scores, np.iinfo(np.int64).min)
            asked = asked & (ranked >= np.partition(ranked, -k, axis=1)[:, -k][:, None])
        i, j = np.nonzero(asked)
        if not len(i):
            return
        owner = np.concatenate((self.owner, owners[i]))
        score, found = np.concatenate((self.score, scores[i, j])), np.concatenate((self.id, ids[j]))
        order = np.lexsort((found, -score, owner))
        owner, score, found = owner[order], score[order], found[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < k
        self.owner, self.score, self.id = owner[kept], score[kept], found[kept]
        full = place == k - 1
        self.least[owner[full]] = score[full]


@dataclass(frozen=True)
class _Block:
    """Some anchors, and what each looks for: up to `k` rows with scores in [low, high], of its own label or of others."""

    row_ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    same: bool
    k: int
    #: Which anchor each list belongs to, and its range of scores.
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _scan(codes: DataFrame, block: _Block) -> DataFrame:
    """(list, vec_id, score): for each list of the block, the best of every task."""
    shared = codes.sparkSession.sparkContext.broadcast(block)
    tile = max(1, PAIRS // 2048)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        best = _Best(len(wanted.owner), wanted.k)
        slots = np.arange(len(wanted.owner)) - np.searchsorted(wanted.owner, wanted.owner)
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch[first:first + 2048]
                row_ids, ids, labels, alignment, norms = (part.column(c).to_numpy() for c in ("row_id", "vec_id", "label", "alignment", "norm"))
                bits = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), "<i8").reshape(len(ids), -1)
                for at in range(0, len(wanted.x), tile):
                    anchors = slice(at, at + tile)
                    lists = slice(*np.searchsorted(wanted.owner, (at, at + tile)))
                    if lists.start == lists.stop:
                        continue
                    lowest, highest = intervals(wanted.x[anchors], bits, alignment, norms)
                    fits = (wanted.labels[anchors][:, None] == labels[None, :]) == wanted.same
                    fits &= wanted.row_ids[anchors][:, None] != row_ids[None, :]
                    owner = wanted.owner[lists] - at
                    floor = np.maximum(wanted.low[lists], best.least[lists])
                    # A list's candidates: rows whose interval meets what it still looks for.
                    least, most = np.full(len(fits), np.inf), np.full(len(fits), -np.inf)
                    np.minimum.at(least, owner, floor.astype(float))
                    np.maximum.at(most, owner, wanted.high[lists].astype(float))
                    asked = fits & (highest >= least[:, None]) & (lowest <= most[:, None])
                    scores = exact_scores(wanted.x[anchors], x, asked)
                    for slot in np.unique(slots[lists]).tolist():
                        chosen = np.flatnonzero(slots[lists] == slot)
                        a = owner[chosen]
                        own = asked[a] & (scores[a] >= floor[chosen][:, None]) & (scores[a] <= wanted.high[lists][chosen][:, None])
                        best.add(chosen + lists.start, scores[a], own, ids)
        yield pa.RecordBatch.from_arrays([pa.array(best.owner), pa.array(best.id), pa.array(best.score)], ["list", "vec_id", "score"])

    return codes.select("row_id", "vec_id", "label", "code", "alignment", "norm", "x").mapInArrow(scan, "list long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("list").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def code_table(df: DataFrame, id_column: str, column: str, label: str, scale: float) -> DataFrame:
    """Stored codes of the rows that take part: row_id, vec_id, label, size, code, alignment, norm, x."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch[at:at + ROWS]
                for size, (rows, matrix) in by_length(part.column(3)).items():
                    x = scaled(matrix, scale)
                    codes, alignment, norms = encode(x)
                    picked = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([
                        picked.column(0), picked.column(1), picked.column(2), pa.array(np.full(len(x), size, np.int32)),
                        pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(alignment), pa.array(norms),
                        pa.array([v.tobytes() for v in x.astype("<i8")], pa.binary()),
                    ], ["row_id", "vec_id", "label", "size", "code", "alignment", "norm", "x"])

    rows = df.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_column).cast("long").alias("vec_id"),
        F.col(label).cast("int").alias("label"), F.col(column).cast("array<double>").alias("vector"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL")
    return stored(rows.mapInArrow(coded, _CODES), "vector-codes")


def mine(
    df: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
    scale: float = 256.0, id_column: str = "vec_id", column: str = "embedding", label: str = "label", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    Entries x become floor(scale * x); scores are integer inner products, ties go to the smaller id. Anchors are the rows
    whose id is divisible by `every`; positives the `positives` best other rows of the anchor's label; the negatives of a
    positive the `negatives` best rows of other labels with low_percent * positive <= 100 * negative <= high_percent * positive.

    Every row is stored once as a one-bit code of its rotated vector, with its alignment, norm and integers. Anchors are
    served in blocks of about `block_bytes`, each broadcast to two passes over the codes: one finds positives, one negatives. A
    task gets each pair's score interval from popcounts (`intervals`), scores those as integers whose interval meets what
    the anchor still looks for, and keeps its best; a window of a list's few rows from each task ranks them. Results of a
    block are stored. No pair is formed outside a task, and none is left out but by its interval.

    Rows with a null id, label or vector, an empty vector, one with a null or non-finite entry, or of another length than
    the commonest take no part. A repeated row is a row of its own: it can be a positive of its twin, and a repeated
    anchor gives its rows again. Anchors without positives or fitting negatives give none, nor does an empty table; other
    columns are not read.
    """
    spark = df.sparkSession
    codes = code_table(df, id_column, column, label, scale)
    size = commonest_length({r["size"]: r["count"] for r in codes.groupBy("size").count().collect()})
    codes = codes.where(F.col("size") == size)
    asked = stored(codes.where(F.col("vec_id") % every == 0).select("row_id", "vec_id", "label", "x"), "anchors")
    blocks = -(-asked.count() * 8 * size // block_bytes)
    folder, limits, written = scratch_path(spark, "negatives"), np.iinfo(np.int64), []
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("row_id"), F.lit(blocks)) == b).orderBy("row_id").collect()
        if not rows:
            continue
        row_ids, ids = np.array([r["row_id"] for r in rows]), [r["vec_id"] for r in rows]
        labels, x = np.array([r["label"] for r in rows]), np.stack([np.frombuffer(r["x"], "<i8") for r in rows])
        everyone = np.arange(len(rows))
        first = _Block(row_ids, labels, x, True, positives, everyone, np.full(len(rows), limits.min), np.full(len(rows), limits.max))
        found = _ranked(_scan(codes, first), positives).orderBy("list", "rank").collect()
        # Lists of negatives: one for each positive of an anchor. Ranges of scores by whole numbers, as Python integers.
        low = np.array([max(-(-low_percent * r["score"] // 100), limits.min) for r in found], np.int64)
        high = np.array([min(high_percent * r["score"] // 100, limits.max) for r in found], np.int64)
        owner = np.array([r["list"] for r in found], np.int64)
        second = _Block(row_ids, labels, x, False, negatives, owner, low, high)
        named = spark.createDataFrame(
            [(k, ids[r["list"]], r["vec_id"], r["score"]) for k, r in enumerate(found)],
            "list long, anchor_id long, positive_id long, positive_score long",
        )
        mined = _ranked(_scan(codes, second), negatives).join(F.broadcast(named), "list")
        mined.select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        ).write.parquet(f"{folder}/{b}")
        written.append(f"{folder}/{b}")
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*written)
