"""Token ids as Arrow stream files of fixed-size-list batches (operator 1).

Documents are range-partitioned by doc_id and each range becomes one pair of
files: ``sequences-NNNNN.arrows`` holds record batches of equal-length id lists
and masks, ``documents-NNNNN.arrows`` the place of each document in them. All
batches but the last of a file have the same number of rows and no nulls, so
every message has the same length, and a memory map gives sequence ``i`` by
arithmetic, without reading what stands before it (:class:`SequenceFile`).

Rows: null text counts as empty (it holds the end id only); a null doc_id sorts
first; repeated rows are each kept, next to one another; an empty table gives no
files and no rows; other columns of the input are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import common
from churnlens.llm.tokens import default_tokenizer, encoder

MANIFEST = "part bigint, sequences string, documents string, n_documents bigint, n_tokens bigint, n_sequences bigint"
#: chunks that a writer remembers in each of two generations; beside them it holds one run of texts
CACHE = 600_000
RUN_BYTES = 4 << 20
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that executors share, and the path in it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            path = "file://" + "/" + path[len("file:"):].lstrip("/")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def sequence_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([
        pa.field("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), nullable=False), length), nullable=False),
        pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length), nullable=False)])


class _SequenceWriter:
    """Collects ids and writes a batch whenever ``rows`` sequences are full."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.schema = sequence_schema(dtype, length)
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.dtype, self.length, self.block = dtype, length, length * rows
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= self.block:
            joined = np.concatenate(self.held)
            for i in range(0, len(joined) - self.block + 1, self.block):
                self._write(joined[i:i + self.block], self.block)
            rest = joined[len(joined) // self.block * self.block:]
            self.held, self.n_held = [rest.copy()], len(rest)

    def _write(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(a), type=t)
                 for a, t in zip((ids, mask), self.schema.types, strict=True)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += len(ids) // self.length

    def close(self) -> None:
        if self.n_held:
            ids = np.concatenate(self.held)
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            padded[:len(ids)] = ids
            self._write(padded, len(ids))
        self.writer.close()


def _writer(folder: str, tokenizer: str, end_id: int, length: int, rows: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        enc = encoder(tokenizer, CACHE, RUN_BYTES)
        dtype = np.dtype("<u2") if max(enc.vocab_size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        part = TaskContext.get().partitionId()
        sink = index = out = None
        tag = uuid.uuid4().hex
        names = [f"{base}/{kind}-{part:05d}.arrows" for kind in ("sequences", "documents")]
        n_docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{names[0]}.{tag}")
                index_sink = fs.open_output_stream(f"{names[1]}.{tag}")
                out, index = _SequenceWriter(sink, dtype, length, rows), pa.ipc.new_stream(index_sink, INDEX)
            at = 0
            for ids, counts in enc.encode_all(batch.column("text")):
                begin, n = out.n_tokens, counts + 1
                out.add(np.insert(ids, np.cumsum(counts), end_id))
                index.write_batch(pa.record_batch([batch.column("doc_id").slice(at, len(n)), pa.array(begin + np.cumsum(n) - n),
                                                   pa.array(n)], schema=INDEX))
                at += len(n)
            n_docs += batch.num_rows
        if out is not None:
            out.close()
            index.close()
            sink.close()
            index_sink.close()
            for name in names:  # a rename shows whole files only; a second attempt writes the same bytes
                if fs.get_file_info(name).type != pafs.FileType.NotFound:
                    fs.delete_file(name)
                fs.move(f"{name}.{tag}", name)
            row = [[part], [names[0]], [names[1]], [n_docs], [out.n_tokens], [out.n_sequences]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3),
                                                strict=True)],
                names=["part", "sequences", "documents", "n_documents", "n_tokens", "n_sequences"])
    return write


def write_sequences(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2,
                    length: int = 2048, rows_per_batch: int = 64) -> DataFrame:
    """Write the ids of ``docs`` in ascending doc_id order; return the manifest, one row per pair of files."""
    folder = common.qualified(docs.sparkSession, folder)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                        # rows of one doc_id can still go to several ranges
                        F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    ordered = keyed.repartitionByRange("doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "_n")
    write = _writer(folder, tokenizer or default_tokenizer(), end_id, length, rows_per_batch)
    return common.stored(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")


def _stream(fs: pafs.FileSystem, path: str) -> pa.ipc.RecordBatchStreamReader:
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.ipc.open_stream(pa.memory_map(path))
    return pa.ipc.open_stream(fs.open_input_stream(path))


class SequenceFile:
    """Random access to the sequences of one file through a memory map, without a copy."""

    def __init__(self, path: str):
        self.buffer = pa.memory_map(path).read_buffer()
        reader = pa.BufferReader(self.buffer)
        with pa.ipc.open_stream(reader) as stream:
            self.schema = stream.schema
            self.first = reader.tell()
            self.rows = stream.read_next_batch().num_rows
            self.stride = reader.tell() - self.first

    def batch(self, i: int) -> pa.RecordBatch:
        message = pa.ipc.read_message(self.buffer.slice(self.first + i * self.stride))
        return pa.ipc.read_record_batch(message, self.schema)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch, k = self.batch(i // self.rows), i % self.rows
        length = self.schema.field("ids").type.list_size
        ids = batch.column("ids").values.to_numpy(zero_copy_only=True)[k * length:(k + 1) * length]
        return ids, batch.column("mask").values.slice(k * length, length)


def _valid_ids(stream: pa.ipc.RecordBatchStreamReader) -> Iterator[np.ndarray]:
    for batch in stream:
        ids = batch.column("ids").values.to_numpy(zero_copy_only=True)
        mask = batch.column("mask").values
        yield ids if mask.true_count == len(ids) else ids[mask.to_numpy(zero_copy_only=False)]


def _digest_documents(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for manifest in batches:
            for row in manifest.to_pylist():
                pieces = _valid_ids(_stream(fs, row["sequences"]))
                rest = np.empty(0, "<u2")
                for index in _stream(fs, row["documents"]):
                    crcs = []
                    for n in index.column("n_tokens").to_pylist():
                        crc = 0
                        while n:
                            if not len(rest):
                                rest = next(pieces)
                            crc = zlib.crc32(rest[:n].astype("<u4").tobytes(), crc)
                            n, rest = n - min(n, len(rest)), rest[n:]
                        crcs.append(crc)
                    starts = pa.array(index.column("start").to_numpy() + row["base"], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [index.column("doc_id"), starts, index.column("n_tokens"), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return read


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Read all files back: doc_id, start in the whole id stream, n_tokens, ids_crc32."""
    folder = common.qualified(manifest.sparkSession, folder)
    # one row per pair of files: the running total runs over the files, not over the documents
    base = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("base", F.coalesce(base, F.lit(0)))
    spread = placed.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 8, "part")
    return spread.mapInArrow(_digest_documents(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    folder = common.shared_folder(spark, "token-files")
    return read_documents(write_sequences(common.table(spark, sf_dir, "documents"), folder), folder)
