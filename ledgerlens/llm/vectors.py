"""Columns of vectors: which rows count, and their entries as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Entries scaled to integers must stay below this, so that products of two are exact and sums of them fit.
ENTRY_LIMIT = 1 << 40
#: Rows that a task turns into numpy arrays at a time.
ROWS = 4096


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of a list column by length: (their rows, a matrix of doubles).

    Null vectors, vectors of no entries and vectors that hold a null or an entry that is not finite are left out.
    """
    if pa.types.is_null(column.type) or not len(column):
        return {}
    kind = pa.large_list(pa.float64())
    column = column.cast(kind)
    offsets = column.offsets.to_numpy()
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    values = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        matrix = values[offsets[rows][:, None] + np.arange(size)]
        whole = np.isfinite(matrix).all(axis=1)
        if whole.any():
            out[size] = rows[whole], matrix[whole]
    return out


def scaled(matrix: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * entry) as longs."""
    whole = np.floor(matrix * scale)
    if len(whole) and np.abs(whole).max() >= ENTRY_LIMIT:
        raise ValueError(f"an entry times {scale:g} is beyond {ENTRY_LIMIT}")
    return whole.astype(np.int64)


def commonest_length(counts: dict[int, int]) -> int:
    """The length that most vectors have, the greater of two that are as common; 0 without vectors."""
    return max(counts, key=lambda size: (counts[size], size), default=0)
