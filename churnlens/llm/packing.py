"""Bounded-space online best-fit packing (operator 3).

Each scan partition packs its own documents: nothing is shuffled, a lost task
is packed again from its own input and its sequences belong to it alone. The
packer holds a fixed number of open bins, kept by free space; a bitset over the
free space gives the tightest bin that fits with two shifts. When a bin must be
opened and all are in use, the fullest closes first. Pieces reach the packer in
blocks, each sorted by falling length, which leaves short pieces to fill gaps.

Rows: null text counts as empty and holds the end id only; repeated rows are
packed each; an empty table gives no rows; a null doc_id is kept; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import common
from churnlens.llm.tokens import default_tokenizer, encoder

PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"


class BestFit:
    """Open bins by free space; ``place`` gives (bin number, offset in it)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.n_bins
            self.n_bins += 1
        if left := free - length:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
        return number, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first, which may be shorter."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def _packer(tokenizer: str, end_id: int, capacity: int, open_bins: int, block: int):
    def emit(rows: list[tuple], bins: BestFit, part: int) -> pa.RecordBatch:
        rows.sort(key=lambda r: -r[3])
        placed = [(*r, part << 40 | number, offset) for r in rows for number, offset in [bins.place(r[3])]]
        cols = list(zip(*placed, strict=True))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                          names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        bins, held = BestFit(capacity, open_bins), []
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = enc.encode(text.as_py()) + end
                key = doc_id.as_py()
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    held.append((key, k, start, n, ids[4 * start:4 * (start + n)]))
                if len(held) >= block:
                    yield emit(held, bins, part)
                    held = []
        if held:
            yield emit(held, bins, part)
    return pack


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 2048,
                   open_bins: int = 4096, block: int = 4096) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit), sequence and place in it."""
    pack = _packer(tokenizer or default_tokenizer(), end_id, capacity, open_bins, block)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(pack, PACKED)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack_documents(common.table(spark, sf_dir, "documents")))
