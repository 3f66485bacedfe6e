"""What the text operators share: stored stages, word spans and word hashes over Arrow text columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path

#: White space of all text operators, as a Java / RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Columns of the documents table.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of text that a task turns into numpy arrays at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a stage as Parquet to the shared folder and read it back: computed once, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def with_row_id(docs: DataFrame, *columns: Column) -> DataFrame:
    """`row_id` tells equal rows apart. It is stable only once stored, so callers store the result."""
    return docs.select(F.monotonically_increasing_id().alias("row_id"), *columns)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longest power table that a worker keeps for each base.
_KEPT_POWERS = 1 << 19
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_for(base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for at least `length` values of i; base is odd, so it has an inverse."""
    kept = _POWERS.get(base)
    if kept is not None and len(kept[0]) >= length:
        return kept
    size = max(1 << int(length - 1).bit_length(), 1 << 12)
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size <= _KEPT_POWERS:
        _POWERS[base] = tables
    return tables


# Fixed odd bases of the rolling hashes over words.
WINDOW_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: Words are hashed in the fields of two primes (fixed values, with a base in each): as polynomials of their bytes, two
#: different words of n bytes agree for n of about 2^31 bases at most, whatever their letters are. Longer words get a digest.
FIELDS = (((1 << 31) - 1, 0x2545F491), ((1 << 31) - 19, 0x5DEECE66))
LONG_WORD, _SEGMENT = 2048, 1 << 16


@lru_cache(maxsize=2)
def _field_powers(prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo a prime, for places within a segment."""
    tables = []
    for x in (base, pow(base, -1, prime)):
        table = np.ones(1, np.uint64)
        while len(table) < _SEGMENT + LONG_WORD:
            table = np.concatenate((table, table * np.uint64(pow(x, len(table), prime)) % np.uint64(prime)))
        tables.append(table)
    return tables[0], tables[1]


class Words:
    """Words of a slice of a text column: byte spans, 64-bit hashes and the first word of each document."""

    def __init__(self, column: pa.Array, first: int, last: int, lower: bool = False):
        offsets = np.frombuffer(column.buffers()[1], np.int32, last - first + 1, (column.offset + first) * 4)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets.astype(np.int64) - int(offsets[0])
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
        solid = (raw != 32) & ((raw < 9) | (raw > 13))
        begins, ends = solid.copy(), solid.copy()
        if len(raw):
            begins[1:] &= ~solid[:-1]
            ends[:-1] &= ~solid[1:]
            inner = offsets[(offsets > 0) & (offsets < len(raw))]
            begins[inner] = solid[inner]
            ends[inner - 1] = solid[inner - 1]
        self.raw, self.offsets = raw, offsets
        self.begins, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: document d owns words first_word[d]:first_word[d + 1]
        self.first_word = np.searchsorted(self.begins, offsets)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        out, sizes, i = np.empty(len(self.begins), np.uint64), self.ends - self.begins, 0
        for k in np.flatnonzero(sizes > LONG_WORD).tolist():
            digest = hashlib.blake2b(self.raw[self.begins[k]:self.ends[k]].tobytes(), digest_size=8).digest()
            out[k] = int.from_bytes(digest, "little")
        short = np.flatnonzero(sizes <= LONG_WORD)
        begins, ends = self.begins[short], self.ends[short]
        while i < len(short):
            j = max(i + 1, int(np.searchsorted(begins, begins[i] + _SEGMENT)))
            low, high = int(begins[i]), int(ends[j - 1])
            b, e = begins[i:j] - low, ends[i:j] - low
            data = self.raw[low:high].astype(np.uint64) + np.uint64(1)
            found = np.zeros(len(b), np.uint64)
            for prime, base in FIELDS:
                up, down = _field_powers(prime, base)
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(data * up[:len(data)], out=sums[1:])  # below 2^9 * 2^31 * 2^17
                p = np.uint64(prime)
                found = (found << np.uint64(32)) | ((sums[e] - sums[b]) % p * down[b] % p)
            out[short[i:j]] = found + (e - b).astype(np.uint64)
            i = j
        return _mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first_word)

    def windows(self, width: int, base: int = WINDOW_BASES[0]) -> np.ndarray:
        """Hash of the `width` words from each word on; windows that run over a document's end are not valid."""
        return rolling(self.hashes, width, base)

    def whole_windows(self, width: int) -> np.ndarray:
        """Which words start a window that lies within its document."""
        ends = np.repeat(self.first_word[1:], self.counts())
        return np.arange(len(self.hashes)) + width <= ends


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of `width` word hashes; the last width - 1 entries are zero."""
    n, out = len(hashes), np.zeros(len(hashes), np.uint64)
    if n >= width:
        up, down = _powers_for(base, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=sums[1:])
        out[: n - width + 1] = _mix((sums[width:] - sums[: n - width + 1]) * down[: n - width + 1])
    return out


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The batch's text as 32-bit-offset strings without nulls."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column
