"""Quality score by a factorisation machine (operator 8).

Inputs are the hashed words of a text (weights log(1 + count), scaled to length 1),
statistics of its structure, and its size class as metadata; labels, language, source and
doc_id are never inputs. The machine adds to a linear score every pairwise interaction
<v_i, v_j> x_i x_j; with the sum-of-squares identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
a text is scored in time linear in its different words.

It is fitted by Adagrad on the logistic loss, on a sample of labelled rows outside the
held-out fifth. ``TRAIN_ROWS`` bounds the sample: rows are taken by a hash of
doc_id below a fraction of that expected size. Scoring reads every whole text once, with
no shuffle; the weights (HASHES * (RANK + 1) floats) are the only thing sent to the executors.

Rows: null text counts as empty and is scored; a null doc_id has the remainder of an empty
text; repeated rows are scored alike; labels that are null or of unknown documents are
not used; without any label every score is 0.5; an empty table gives no rows;
other columns pass through ``score_documents`` untouched.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from churnlens.llm import common

HASHES = 1 << 14
RANK = 8
TRAIN_ROWS = 12_000
SIZE_CLASSES = 8
DENSE = 14
#: places behind the hashed words: the statistics, then the size classes
WIDTH = HASHES + DENSE + SIZE_CLASSES
SCORE = "_quality_score"


def structure(data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Statistics of a text, most of them shares between 0 and 1."""
    n, size = len(words), max(len(data), 1)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols = int(seen[[35, 42, 36, 37, 38, 124, 60, 62]].sum())
    letters = max(int(seen[65:91].sum() + seen[97:123].sum()), 1)
    stops = int(seen[[46, 63]].sum())
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(n), size / max(n, 1) / 10, symbols / max(n, 1), float(seen[33]) / max(n, 1), seen[65:91].sum() / letters,
        seen[48:58].sum() / size, len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1), same / max(n - 1, 1),
        pairs / max(n - 1, 1), 1 - len(set(lines)) / max(len(lines), 1), len(lines) / max(n, 1), stops / max(n, 1),
        float(seen[124]) / max(n, 1)]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float], int]:
    """(word places, word weights, statistics, size class)."""
    data = (text or "").encode()
    words = data.split()
    counts = Counter(data.lower().split())
    places = np.fromiter((zlib.crc32(w) % HASHES for w in counts), np.int32, len(counts))
    weights = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(weights):
        weights /= np.sqrt((weights ** 2).sum())
    return places, weights.astype(np.float32), structure(data, words, counts), min(len(str(len(data))), SIZE_CLASSES) - 1


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # WIDTH
    factors: np.ndarray  # WIDTH x RANK
    mean: np.ndarray  # DENSE
    spread: np.ndarray

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of all inputs of a text."""
        places, weights, stats, size = features(text)
        return self.full(places, weights, np.array(stats, np.float32), size)

    def full(self, places, weights, stats, size):
        dense = np.clip((stats - self.mean) / self.spread, -4, 4)
        return (np.concatenate([places, np.arange(HASHES, HASHES + DENSE), [HASHES + DENSE + size]]).astype(np.int64),
                np.concatenate([weights, dense, [1.0]]).astype(np.float32))

    def raw(self, places: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[places] * values[:, None]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[places] @ values + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*self.row(text)), -30, 30))))


def fit(rows: list[tuple], labels: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.1,
        shrink: float = 1e-4) -> Machine:
    """Adagrad over minibatches; ``rows`` are results of :func:`features`."""
    rng = np.random.default_rng(7)
    stats = np.array([r[2] for r in rows], np.float32).reshape(-1, DENSE)
    spread = stats.std(axis=0) if len(rows) else np.ones(DENSE)
    m = Machine(0.0, np.zeros(WIDTH, np.float32), rng.normal(0, 0.05, (WIDTH, RANK)).astype(np.float32),
                stats.mean(axis=0) if len(rows) else np.zeros(DENSE), np.where(spread > 1e-6, spread, 1.0))
    if not len(rows):
        m.factors[:] = 0
        return m
    inputs = [m.full(r[0], r[1], np.array(r[2], np.float32), r[3]) for r in rows]
    seen_bias, seen_linear = 1e-6, np.full(WIDTH, 1e-6, np.float32)
    seen_factors = np.full((WIDTH, RANK), 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(inputs))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            places = np.concatenate([inputs[i][0] for i in chosen])
            values = np.concatenate([inputs[i][1] for i in chosen])
            lengths = np.array([len(inputs[i][0]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            v = m.factors[places] * values[:, None]
            total = np.add.reduceat(v, starts, axis=0)
            raw = (m.bias + np.add.reduceat(m.linear[places] * values, starts)
                   + 0.5 * ((total ** 2).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), starts)))
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
            each = np.repeat(slope, lengths)
            own, where = np.unique(places, return_inverse=True)
            g_linear = np.bincount(where, each * values, len(own)) + shrink * m.linear[own]
            g_each = (each * values)[:, None] * (np.repeat(total, lengths, axis=0) - v)
            g_factors = np.stack([np.bincount(where, g_each[:, f], len(own)) for f in range(RANK)], axis=1)
            g_factors += shrink * m.factors[own]
            seen_bias += slope.sum() ** 2
            m.bias -= rate * slope.sum() / np.sqrt(seen_bias)
            seen_linear[own] += g_linear ** 2
            m.linear[own] -= rate * g_linear / np.sqrt(seen_linear[own])
            seen_factors[own] += g_factors ** 2
            m.factors[own] -= 0.5 * rate * g_factors / np.sqrt(seen_factors[own])
    return m


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; 0 marks the held-out rows."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


FEATURES = "quality int, places binary, weights binary, stats array<double>, size int"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.array([f[0].tobytes() for f in found], pa.binary()),
             pa.array([f[1].tobytes() for f in found], pa.binary()),
             pa.array([[float(x) for x in f[2]] for f in found], pa.list_(pa.float64())),
             pa.array([f[3] for f in found], pa.int32())],
            names=["quality", "places", "weights", "stats", "size"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """Fit on about ``train_rows`` labelled rows, none of them held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    usable = usable.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = usable.count()
    share = min(1.0, train_rows / max(n, 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = usable.where(place < share)
    # the sample's size is bounded by train_rows, so it may be broadcast
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = chosen.select("quality", "text").mapInArrow(_extract, FEATURES).collect()
    rows.sort(key=lambda r: (r.quality, r.size, r.places, r.weights))  # the fit doesn't depend on the order of tasks
    inputs = [(np.frombuffer(r.places, np.int32), np.frombuffer(r.weights, np.float32), r.stats, r.size) for r in rows]
    return fit(inputs, np.array([r.quality for r in rows], np.float32))


def score_documents(docs: DataFrame, machine: Machine, name: str = SCORE) -> DataFrame:
    """``docs`` with all its columns and the score of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            scores = pa.array([m.score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose score is ``least`` or more; columns as given."""
    name = common.free_name(docs, SCORE)
    return score_documents(docs, train(docs, labels), name).where(F.col(name) >= least).select(*docs.columns)


def op8_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, common.table(spark, sf_dir, "labels"))
    scored = score_documents(docs, machine, "score")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))
