"""Whitening of embeddings with an exact covariance from bit-sliced cross-products (operator 12)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.vectors import ROWS, by_length, commonest_length, scaled


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening of vectors of `size` entries: x = floor(scale * entry) + offset."""

    size: int
    scale: float
    offset: int
    n: int
    #: Sums of x by dimension, and n * n times the covariance: integers of any size.
    sums: tuple[int, ...]
    scatter: tuple[tuple[int, ...], ...]
    #: By falling eigenvalue; the columns of `vectors` are unit eigenvectors, their largest entry is positive.
    values: np.ndarray
    vectors: np.ndarray

    def explained(self) -> np.ndarray:
        trace = sum(row[i] for i, row in enumerate(self.scatter)) / (self.n * self.n) if self.n else 0.0
        return self.values / trace if trace else np.zeros_like(self.values)

    def projection(self, components: int) -> tuple[np.ndarray, np.ndarray]:
        """Matrix that takes a centred vector to whitened components, and which of these have any variance."""
        values, vectors = self.values[:components], self.vectors[:, :components]
        least = self.values[:1].sum() * self.size * np.finfo(float).eps * 8
        varies = values > least
        return np.where(varies, vectors / np.sqrt(np.where(varies, values, 1.0)), 0.0), varies


def cross_products(x: np.ndarray) -> np.ndarray:
    """x.T @ x of a matrix of non-negative integers, as Python integers, by counts of common bits.

    Bit b of each dimension, over all rows, is a plane packed into 64-bit words. Two planes of bits b and c have as
    many rows in common as their AND has ones, and each of these adds 2^(b + c). Planes without ones are left out.
    """
    n, size = x.shape
    out = np.zeros((size, size), object)
    words = -(-n // 64)
    planes, owners, weights = [], [], []
    for b in range(int(x.max(initial=0)).bit_length()):
        bits = (x >> b) & 1
        for d in np.flatnonzero(bits.any(axis=0)).tolist():
            packed = np.packbits(bits[:, d].astype(bool), bitorder="little")
            planes.append(np.pad(packed, (0, words * 8 - len(packed))).view(np.uint64))
            owners.append(d)
            weights.append(b)
    if not planes:
        return out
    planes, owners, weights = np.stack(planes), np.array(owners), np.array(weights)
    # One count for each pair of planes; those of a pair of bits are weighted together, as Python integers.
    for b in np.unique(weights).tolist():
        for c in range(b + 1):
            left, right = np.flatnonzero(weights == b), np.flatnonzero(weights == c)
            if not len(right):
                continue
            counts = np.zeros((size, size), np.int64)
            for i in left:
                counts[owners[i], owners[right]] = np.bitwise_count(planes[right] & planes[i]).sum(axis=1, dtype=np.int64)
            both = counts if b == c else counts + counts.T
            out += both.astype(object) << (b + c)
    return out


def fit_whitening(df: DataFrame, column: str = "embedding", *, scale: float = 64.0, offset: int = 1_000_000) -> Whitening:
    """Covariance of all usable vectors of `column`, exactly, and its eigenvectors.

    Each task shifts a batch of x by the least x of each dimension, counts common bits (`cross_products`), shifts back
    and adds up integers; one aggregate adds the tasks' sums, size * size of them, as decimals. The driver centres them
    as integers, n * sum(x y) - sum(x) sum(y), and hands the correctly rounded quotients to `eigh`. Tables of any length
    give as many numbers to the driver as a vector has pairs of entries.

    Null vectors, empty ones and those with a null or non-finite entry take no part. Of vectors of several lengths
    those of the commonest one do (the greater of two as common). Without any the fit has size 0.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, cross = defaultdict(int), {}, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                for size, (_, matrix) in by_length(batch.column(0)[at:at + (1 << 14)]).items():
                    x = scaled(matrix, scale)
                    low = x.min(axis=0)
                    raised = cross_products(x - low)
                    total, shift = x.sum(axis=0).astype(object), low.astype(object)
                    # (x - l)(y - m) summed, plus l sum(y) + m sum(x) - n l m, is the sum of x y.
                    raised += np.outer(shift, total) + np.outer(total, shift) - len(x) * np.outer(shift, shift)
                    counts[size] += len(x)
                    sums[size] = sums.get(size, 0) + total
                    cross[size] = cross.get(size, 0) + raised
        for size, n in counts.items():
            upper = np.triu_indices(size)
            i = np.concatenate((np.full(size + 1, -1), upper[0]))
            j = np.concatenate(([-1], np.arange(size), upper[1]))
            value = pa.array([str(v) for v in (n, *sums[size], *cross[size][upper])], pa.string())
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(i[part]), size, np.int32)), pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32)), value[part],
                ], ["size", "i", "j", "value"])

    vectors = df.select(F.col(column).cast("array<double>").alias("vector"))
    parts = vectors.mapInArrow(partial, "size int, i int, j int, value string")
    added = parts.groupBy("size", "i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    by_size = defaultdict(dict)
    for r in added.collect():
        by_size[r["size"]][r["i"], r["j"]] = int(r["value"])
    size = commonest_length({s: found[-1, -1] for s, found in by_size.items()})
    if not size:
        return Whitening(0, scale, offset, 0, (), (), np.zeros(0), np.zeros((0, 0)))
    found = by_size[size]
    n, sums = found[-1, -1], [found[-1, d] for d in range(size)]
    # Covariances do not depend on the offset, so it joins the sums only.
    scatter = [[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    covariance = np.array([[v / (n * n) for v in row] for row in scatter])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)])
    return Whitening(size, scale, offset, n, tuple(s + n * offset for s in sums), tuple(map(tuple, scatter)), np.maximum(values, 0.0), vectors * signs)


def _whitened(batch: pa.RecordBatch, fit: Whitening, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, n * x - sums, whitened) for some rows at a time."""
    sums = np.array(fit.sums, object) - fit.n * fit.offset
    small = fit.n * (1 << 41) < 1 << 62
    for at in range(0, batch.num_rows, ROWS):
        found = by_length(batch.column(batch.num_columns - 1)[at:at + ROWS]).get(fit.size)
        if found is None:
            continue
        x = scaled(found[1], fit.scale)
        centred = x * fit.n - sums.astype(np.int64) if small else x.astype(object) * fit.n - sums
        yield found[0] + at, centred, (centred / fit.n).astype(float) @ matrix


def identity_error(df: DataFrame, fit: Whitening, column: str = "embedding", components: int = 32) -> float | None:
    """Largest absolute entry of the covariance of the whitened components, minus the identity; None without any.

    Measured on all whitened vectors: each task adds up products of the components, which are centred by the exact
    means, and one aggregate adds the tasks' sums.
    """
    matrix, varies = fit.projection(components)
    k = int(varies.sum())
    if not k:
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, _, white in _whitened(batch, fit, matrix[:, :k]):
                total[:k] += white.T @ white
                total[k] += white.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "value"])

    vectors = df.select(F.col(column).cast("array<double>").alias("vector"))
    added = vectors.mapInArrow(partial, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    found = np.zeros((k + 1, k))
    found.ravel()[[r["place"] for r in added]] = [r["value"] for r in added]
    mean = found[k] / fit.n
    return float(np.abs(found[:k] / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    df: DataFrame, fit: Whitening, id_column: str = "vec_id", column: str = "embedding", components: int = 32,
) -> DataFrame:
    """One row per usable row of `df` and component: the id, component (from 1), n, deviation, whitened, explained.

    `deviation` is the sum over dimensions of (n x - S)^2, exact. `whitened` is x - S / n on the component's unit vector,
    over the root of its eigenvalue; it is null for a component without variance, as when all vectors are equal.

    Rows whose vector is null, empty, of another length than the fit's or holds a null or non-finite entry are dropped;
    null and repeated ids are kept as they are; an empty table gives no rows; other columns are not read.
    """
    matrix, varies = fit.projection(components)
    k, explained = matrix.shape[1], fit.explained()
    schema = f"`{id_column}` long, component int, n long, deviation decimal(38,0), whitened double, explained double"
    if not fit.size:
        return df.sparkSession.createDataFrame([], schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, centred, white in _whitened(batch, fit, matrix):
                if centred.dtype == object or len(centred) and float(np.abs(centred).max()) ** 2 * fit.size >= 1 << 62:
                    deviation = (centred.astype(object) ** 2).sum(axis=1)
                else:
                    deviation = (centred * centred).sum(axis=1)
                many = len(at) * k
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(many, fit.n)),
                    pa.array([str(x) for x in deviation], pa.string()).cast(pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(white.ravel(), mask=~np.tile(varies, len(at))), pa.array(np.tile(explained[:k], len(at))),
                ], [id_column, "component", "n", "deviation", "whitened", "explained"])

    picked = df.select(F.col(id_column).cast("long").alias(id_column), F.col(column).cast("array<double>").alias("vector"))
    return picked.mapInArrow(rows, schema)
