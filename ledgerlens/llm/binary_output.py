"""Token ids as Arrow stream files of equal-length sequences and masks (operator 10)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import chunks, text_column, text_or_empty
from ledgerlens.llm.tokens import ENCODED_BYTES, codec

#: Sequences of one record batch; all batches but a file's last have as many, so sequence k is in batch k // BATCH.
BATCH = 256
_DOCS = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "part int, file string, n_docs long, n_tokens long, n_sequences long"


def sequence_schema(length: int, vocabulary: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Sequences:
    """Fills fixed-size batches; memory is one batch, whatever the partition's size."""

    def __init__(self, sink, schema: pa.Schema, length: int):
        self.schema, self.length = schema, length
        self.writer = pa.ipc.new_stream(sink, schema)
        self.ids = np.zeros(BATCH * length, schema.field("ids").type.value_type.to_pandas_dtype())
        self.used = self.rows = 0

    def add(self, ids: np.ndarray) -> None:
        while len(ids):
            taken = min(len(ids), len(self.ids) - self.used)
            self.ids[self.used:self.used + taken] = ids[:taken]
            self.used += taken
            ids = ids[taken:]
            if self.used == len(self.ids):
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.used // self.length)
        size = rows * self.length
        mask = np.arange(size) < self.used
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (self.ids[:size].copy(), mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.rows += rows
        self.used = 0
        self.ids[:] = 0

    def close(self) -> None:
        if self.used:
            self._flush()
        self.writer.close()


def write_sequences(
    docs: DataFrame, folder: str, tokenizer: str, *, length: int = 2048, end_id: int = 0,
) -> list[tuple[int, str, int, int, int]]:
    """Write `docs` (doc_id, text) in ascending doc_id order; return one (part, file, documents, tokens, sequences) per file.

    The table is dealt by ranges of doc_id and each range becomes a pair of Arrow stream files: `part-N.arrow` with
    columns `ids` and `mask` (fixed-size lists, 0 in the mask is padding at the file's end) and `part-N.docs.arrow` with
    each document's place. A file is written under another name and moved, so a repeated task leaves whole files only.
    `folder` is one that every executor reaches, as a path or a URI that pyarrow.fs knows.

    A null text is empty (its end id alone); null ids come first; rows of equal doc_id are all written, ordered by text;
    an empty table writes no file. Other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    order = ("doc_id", F.xxhash64("text"), "row_id")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens, target = TaskContext.get().partitionId(), codec(tokenizer), None
        n_docs = n_tokens = 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if target is None:
                system, root = fs.FileSystem.from_uri(folder)
                system.create_dir(root, recursive=True)
                names = [f"part-{part:06d}.arrow", f"part-{part:06d}.docs.arrow"]
                drafts = [f"{root}/.{name}.{uuid.uuid4().hex}" for name in names]
                sinks = [system.open_output_stream(x) for x in drafts]
                target = _Sequences(sinks[0], sequence_schema(length, tokens.size), length)
                index = pa.ipc.new_stream(sinks[1], _DOCS)
            column = text_column(batch)
            for first, last in chunks(column, ENCODED_BYTES):
                encoded = [np.frombuffer(x + end, "<u4") for x in tokens.encode_array(column[first:last])]
                target.add(np.concatenate(encoded))
                counts = np.array([len(x) for x in encoded], np.int64)
                places = n_tokens + np.concatenate(([0], np.cumsum(counts)[:-1]))
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(places), pa.array(counts)], schema=_DOCS))
                n_docs += len(encoded)
                n_tokens += int(counts.sum())
        if target is not None:
            target.close()
            index.close()
            for sink, draft, name in zip(sinks, drafts, names, strict=True):
                sink.close()
                system.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{
                "part": part, "file": names[0], "n_docs": n_docs, "n_tokens": n_tokens, "n_sequences": target.rows,
            }], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    # One row for each file: the listing that any reader of the folder makes.
    return sorted(tuple(r) for r in ordered.mapInArrow(write, _MANIFEST).collect())


class SequenceFile:
    """Random access to one file: batches are mapped, not copied, where the file system is local."""

    def __init__(self, folder: str, name: str):
        system, root = fs.FileSystem.from_uri(folder)
        if isinstance(system, fs.LocalFileSystem):
            self.source = pa.memory_map(f"{root}/{name}")
        else:
            self.source = system.open_input_file(f"{root}/{name}")
        reader = pa.ipc.open_stream(self.source)
        self.batches = list(reader) if isinstance(system, fs.LocalFileSystem) else None
        self.reader = reader

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask (bits) of sequence k, views of the mapped file."""
        batch, row = self.batches[k // BATCH], k % BATCH
        length = batch.schema.field("ids").type.list_size
        at = slice(row * length, (row + 1) * length)
        return batch.column(0).values[at].to_numpy(zero_copy_only=True), batch.column(1).values[at]


def read_documents(spark: SparkSession, folder: str, manifest: list[tuple]) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (unsigned 32-bit, little-endian).

    `start` counts the ids of all documents before it over all files. Each task streams whole files; it holds one
    batch and one document.
    """
    starts = list(accumulate((n for _, _, _, n, _ in manifest), initial=0))
    schema = "doc_id long, start long, n_tokens long, ids binary"
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    files = spark.createDataFrame(
        [(file, start) for (_, file, *_), start in zip(manifest, starts, strict=False)], "file string, first long",
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(f"{root}/{row['file']}") as seqs, system.open_input_stream(
                    f"{root}/{row['file'].removesuffix('.arrow')}.docs.arrow"
                ) as docs:
                    ids = _tokens(pa.ipc.open_stream(seqs))
                    for part in pa.ipc.open_stream(docs):
                        for at in range(0, part.num_rows, 512):
                            some = part.slice(at, 512)
                            cut = [ids.take(n) for n in some.column("n_tokens").to_pylist()]
                            first = [row["first"] + p for p in some.column("position").to_pylist()]
                            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(first, pa.int64()), some.column("n_tokens"), pa.array(cut, pa.binary())], schema=out)

    return files.repartition(max(1, len(manifest))).mapInArrow(read, schema)


class _tokens:
    """The unmasked ids of a stream, a few at a time."""

    def __init__(self, reader):
        self.reader, self.left = reader, np.zeros(0, np.uint32)

    def take(self, n: int) -> bytes:
        got = []
        while n:
            if not len(self.left):
                batch = self.reader.read_next_batch()
                ids = batch.column(0).values.to_numpy(zero_copy_only=True)
                self.left = ids[batch.column(1).values.to_numpy(zero_copy_only=False)].astype("<u4")
            got.append(self.left[:n].tobytes())
            n -= len(self.left[:n])
            self.left = self.left[len(got[-1]) // 4:]
        return b"".join(got)
