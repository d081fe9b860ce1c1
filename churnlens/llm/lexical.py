"""Ranked lexical search over bit-sliced Bloom signatures (operator 12).

A document is scored for an item by the terms they share: the term's weight, which falls with the number of
documents that hold it, times a share of one that grows with its occurrences and falls with the
document's length. All of it is integer arithmetic but the logarithm in the weight.

The index holds blocks of documents of similar size. A block has a bit for each of its documents in every
slice; a term sets the bits of its documents in ``HASHES`` slices, and once more under another hash for
each occurrence threshold of ``LEVELS`` that it reaches. The AND of a term's slices holds all
documents with that many occurrences, and few others, so the largest occurrence number it allows gives an upper
bound of the term's part for each document, whose exact length is stored. Sums of these bounds are upper bounds of
scores.

A search reads the slices twice. The documents with the k highest bounds of each item are scored
exactly, which gives a k-th score that the result can't fall below; then all documents whose
bound reaches it are scored exactly. The rest is provably not among the k best. Of documents with the
same text only the k first by doc_id can be among them, and only those are scored.

Rows: a null text has no terms and is never returned; items without terms have no rows; rows of one item_id make one
item with the terms of all; repeated rows of documents are documents of their own; ties go to the smaller
doc_id, null last, then to the row first read; very long texts are counted whole, and where their slices fill up
the bound only gets weaker; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import common

# The characters that stand between terms
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: as bytes of UTF-8: separators become spaces, A-Z small letters, all of 0x80 and above stay
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

HASHES = 7
#: occurrence thresholds that set bits of their own
LEVELS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48)
BITS_PER_ENTRY = 16
MOST_SLICES = 1 << 22
BLOCK_ROWS, BLOCK_CELLS = 4096, 1 << 24
#: entries (8 bytes each) that a task holds before it writes blocks
HELD = 1 << 22
INDEX = ("slices int, doc_id array<bigint>, file array<string>, row array<bigint>, digest array<binary>, "
         "n array<bigint>, signature binary")
PAIRS = "item int, doc_id bigint, file string, row bigint, digest binary, bound double"
#: candidate documents up to which they are sent to all executors; beyond, they meet the texts by a shuffle
SENT = 200_000


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split(b" ") if text else []


def term_counts(text: str | None) -> Counter:
    counts = Counter(terms_of(text))
    counts.pop(b"", None)
    return counts


def term_hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


def slice_numbers(hashes: np.ndarray, level: int, slices: int) -> np.ndarray:
    """(HASHES, len(hashes)) slice numbers for one occurrence threshold."""
    with np.errstate(over="ignore"):
        h = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * level % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        step = (h >> np.uint64(40)) | np.uint64(1)
        at = h[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * step[None, :]
    return (at % np.uint64(slices)).astype(np.int64)


class _Hashes(dict):
    """term -> its hash, for the last million terms or so."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        self[term] = term_hash(term)
        return self[term]


class _Blocks:
    """Collects documents of a task and turns them into blocks of similar size."""

    def __init__(self):
        self.known = _Hashes()
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id, file: str, row: int, text: str) -> None:
        counts = term_counts(text)
        if not counts:
            return
        n = len(counts)
        self.hashes.append(np.fromiter(map(self.known.__getitem__, counts), np.uint64, n))
        tf = np.fromiter(counts.values(), np.int64, n)
        self.counts.append(np.minimum(tf, LEVELS[-1]).astype(np.uint8))
        digest = hashlib.sha256(text.encode()).digest()
        self.rows.append((doc_id, file, row, digest, int(tf.sum())))
        self.n_held += n

    def blocks(self) -> Iterator[pa.RecordBatch]:
        entries = np.array([sum(int((c >= t).sum()) for t in LEVELS) for c in self.counts])
        order = np.argsort(entries, kind="stable")[::-1]
        at = 0
        while at < len(order):
            slices = min(MOST_SLICES, BITS_PER_ENTRY * int(entries[order[at]]))
            rows = max(8, min(BLOCK_ROWS, BLOCK_CELLS // slices))
            yield self._block(order[at:at + rows].tolist(), slices)
            at += rows
        self.clear()

    def _block(self, members: list[int], slices: int) -> pa.RecordBatch:
        cells = np.zeros((slices, -(-len(members) // 8) * 8), np.uint8)
        hashes = np.concatenate([self.hashes[m] for m in members])
        counts = np.concatenate([self.counts[m] for m in members])
        rows = np.repeat(np.arange(len(members)), [len(self.hashes[m]) for m in members])
        for level in LEVELS:
            reach = counts >= level
            if not reach.any():
                break
            cells[slice_numbers(hashes[reach], level, slices), rows[reach]] = 1
        signature = np.packbits(cells, axis=1, bitorder="little").tobytes()
        columns = list(zip(*[self.rows[m] for m in members], strict=True))
        types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([slices], pa.int32()), *[pa.array([c], pa.list_(t)) for c, t in zip(columns, types, strict=True)],
             pa.array([signature], pa.binary())], names=["slices", "doc_id", "file", "row", "digest", "n", "signature"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Blocks()
    for batch in batches:
        for doc_id, file, row, text in zip(*(batch.column(c) for c in ("doc_id", "file", "row", "text")), strict=True):
            if (whole := text.as_py()):
                held.add(doc_id.as_py(), file.as_py(), row.as_py(), whole)
            if held.n_held >= HELD:
                yield from held.blocks()
    yield from held.blocks()


def build_index(keyed: DataFrame) -> DataFrame:
    """The stored index of documents with their row ``key``: one row per block, see INDEX."""
    rows = keyed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "key.file", "key.row", "text")
    return common.stored(rows.mapInArrow(_build, INDEX), "lexical-index")


def _frequencies(wanted: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                df.update(wanted.intersection(terms_of(text.as_py())))
        terms = list(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array([df[t] for t in terms], pa.int64())],
                                         names=["term", "df"])
    return run


def document_frequencies(docs: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the terms stands, from all documents."""
    found = docs.select("text").mapInArrow(_frequencies(frozenset(terms)), "term binary, df bigint")
    return {bytes(r.term): r.df for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}


@dataclass
class Queries:
    """Items of one pass: for each, the numbers of its terms and their weights."""
    ids: list
    terms: list[bytes]
    items: list[tuple[np.ndarray, np.ndarray]]
    n_docs: int
    n_terms: int
    hashes: np.ndarray = field(init=False)

    def __post_init__(self):
        self.hashes = np.fromiter(map(term_hash, self.terms), np.uint64, len(self.terms))

    def length_part(self, n: int) -> int:
        return 50 + 50 * n * self.n_docs // self.n_terms

    def scores(self, text: str, items: list[int]) -> list[int]:
        counts = term_counts(text)
        m, part = 20 * self.length_part(sum(counts.values())), {}
        for k in {k for i in items for k in self.items[i][0].tolist()}:
            if tf := counts.get(self.terms[k]):
                part[k] = 1_000_000_000 * tf // (1000 * tf + m)
        return [sum(w * part[k] for k, w in zip(*(a.tolist() for a in self.items[i]), strict=True) if k in part) for i in items]


def prepare(rows: list, df: dict[bytes, int], n_docs: int, n_terms: int) -> Queries:
    """``rows``: (item_id, its distinct terms). Terms that no document holds, or of weight 0, add nothing."""
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    terms = sorted(t for t, w in weight.items() if w > 0)
    number = {t: k for k, t in enumerate(terms)}
    items = []
    for _, own in rows:
        ks = sorted(number[t] for t in own if t in number)
        items.append((np.array(ks, np.int64), np.array([weight[terms[k]] for k in ks], np.int64)))
    return Queries([i for i, _ in rows], terms, items, n_docs, n_terms)


def _bounds(q: Queries, signature: bytes, slices: int, n: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, items x rows upper bounds) of a block, a stretch of rows at a time."""
    packed = np.frombuffer(signature, np.uint8).reshape(slices, -1)
    width = max(1, min(packed.shape[1], (1 << 22) // max(1, len(q.terms)) // 8))
    m = np.array([20 * q.length_part(x) for x in n], np.float64)
    # an occurrence number below the next threshold, or any at all behind the last one
    most = np.array([0, *[b - 1 for b in LEVELS[1:]]], np.float64)[:, None]
    part = np.vstack([1e9 * most / (1000 * most + m), np.full((1, len(m)), 1e6)]).astype(np.float32) * np.float32(1.0001)
    numbers = [slice_numbers(q.hashes, level, slices) for level in LEVELS]
    for at in range(0, packed.shape[1], width):
        some = packed[:, at:at + width]
        cols = min(len(n) - 8 * at, 8 * width)
        level = np.zeros((len(q.terms), cols), np.uint8)
        lower = np.uint8(255)
        for no in numbers:
            bits = some[no[0]] & lower  # a threshold counts only where all lower ones are reached
            for other in no[1:]:
                bits &= some[other]
            if not bits.any():
                break
            lower = bits
            level += np.unpackbits(bits, axis=1, count=cols, bitorder="little")
        value = part[level, np.arange(8 * at, 8 * at + cols)[None, :]]
        bound = np.empty((len(q.items), cols), np.float32)
        for i, (ks, ws) in enumerate(q.items):
            bound[i] = ws.astype(np.float32) @ value[ks]
        yield 8 * at, bound


def _candidates(q: Queries, k: int, floors: np.ndarray | None):
    """Pairs of an item and a document: the k highest bounds of the task, or all that reach the item's floor."""
    def emit(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 6
        types = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          names=["item", "doc_id", "file", "row", "digest", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in q.items]
        least = np.zeros(len(q.items))
        for batch in batches:
            for b in range(batch.num_rows if q.terms else 0):
                block = {c: batch.column(c)[b] for c in batch.schema.names}
                of = [block[c].values for c in ("doc_id", "file", "row", "digest")]
                for first, bound in _bounds(q, block["signature"].as_buffer(), block["slices"].as_py(), block["n"].as_py()):
                    reach = (bound > 0) & (bound >= (least if floors is None else floors)[:, None])
                    found = []
                    for i in np.flatnonzero(reach.any(axis=1)).tolist():
                        at = np.flatnonzero(reach[i])
                        if floors is None and len(at) > k:
                            at = at[np.argpartition(bound[i, at], -k)[-k:]]
                        mine = [(i, *[c[first + j].as_py() for c in of], float(bound[i, j])) for j in at.tolist()]
                        if floors is not None:
                            found += mine
                            continue
                        best[i] = sorted(best[i] + mine, key=lambda r: -r[-1])[:k]
                        if len(best[i]) == k:
                            least[i] = best[i][-1][-1]
                    if found:
                        yield emit(found)
        if floors is None:
            yield emit([r for rows in best for r in rows])
    return run


def _rescored(q: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, own, text in zip(*(batch.column(c) for c in ("doc_id", "key", "items", "text")), strict=True):
                items = own.as_py()
                out += [(i, doc_id.as_py(), key.as_py(), s) for i, s in zip(items, q.scores(text.as_py(), items), strict=True) if s > 0]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = (pa.int32(), pa.int64(), batch.schema.field("key").type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=["item", "doc_id", "key", "score"])
    return run


def rescore(keyed: DataFrame, pairs: DataFrame, q: Queries) -> DataFrame:
    """item, doc_id, key, score (above 0) of the stored pairs, from the whole texts."""
    # a document is in as many pairs as there are items in a pass, at most
    per = common.stored(pairs.groupBy("file", "row").agg(F.collect_list("item").alias("items")).select(
        F.struct("file", "row").alias("key"), "items"), "lexical-pairs")
    if per.count() <= SENT:
        per = F.broadcast(per)
    rows = keyed.join(per, "key").select(F.col("doc_id").cast("bigint").alias("doc_id"), "key", "items", "text")
    return common.stored(rows.mapInArrow(_rescored(q), "item int, doc_id bigint, key struct<file:string,row:bigint>, score bigint"),
                         "lexical-scores")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_pass(keyed: DataFrame, index: DataFrame, q: Queries, k: int) -> DataFrame:
    """item, rank, doc_id, score of one set of items."""
    first = Window.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last(), "file", "row")
    top = index.mapInArrow(_candidates(q, k, None), PAIRS).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    known = rescore(keyed, top, q).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floors = np.zeros(len(q.items))
    for r in known.where(F.col("n") >= k).collect():  # one row per item
        floors[r.item] = r.least
    # of equal texts, which score the same, no more than k can be in the result
    copies = Window.partitionBy("item", "digest").orderBy(F.col("doc_id").asc_nulls_last(), "file", "row")
    pairs = index.mapInArrow(_candidates(q, k, floors), PAIRS).select("item", "doc_id", "file", "row", "digest")
    pairs = pairs.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k)
    return _best(rescore(keyed, pairs, q), k)


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, terms: the distinct terms of each item, of all its rows."""
    found = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    each = items.select(F.col(item).alias("item"), F.explode(F.array_distinct(found)).alias("term"))
    return each.groupBy("item").agg(F.collect_set("term").alias("terms"))


def search(docs: DataFrame, items: DataFrame, k: int = 50, items_at_once: int = 4096) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0.

    ``items_at_once`` items are held by the driver and each task in a pass over the index; more take
    several passes.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    keyed = common.row_keyed(docs.select("doc_id", "text"), "lexical-rows", "key")
    index = build_index(keyed)
    total = index.select(F.explode("n").alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    wanted = common.stored(item_terms(items), "lexical-items")
    passes = -(-wanted.count() // items_at_once) if total["docs"] else 0
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for number in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).collect()
        rows = sorted(((r["item"], {t.encode() for t in r["terms"]}) for r in part), key=lambda r: (r[0] is None, r[0]))
        q = prepare(rows, document_frequencies(docs, set().union(*[t for _, t in rows])), total["docs"], total["terms"])
        names = spark.createDataFrame(list(enumerate(q.ids)), f"item int, item_id {kind}")
        best = search_pass(keyed, index, q, k).join(F.broadcast(names), "item")
        out = out.unionByName(common.stored(best.select("item_id", "rank", "doc_id", "score"), "lexical-best"))
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as terms from documents),
t as (select r, doc_id, unnest(terms) as term, len(terms) as n from d),
f as (select r, doc_id, term, n, count(*) as tf from t group by all),
g as (select count(*) filter (len(terms) > 0)::bigint as nd, sum(len(terms))::bigint as nt from d),
i as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) as term
  from benchmark),
w as (
  select term, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)))::bigint as w
  from f, g group by term),
s as (
  select i.item_id, f.r, f.doc_id,
         sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (100 - 50 + (50 * f.n * g.nd) // g.nt))))::bigint as score
  from i join f on i.term = f.term join w on w.term = i.term, g
  group by i.item_id, f.r, f.doc_id)
select item_id, rank::int as rank, doc_id, score from (
  select item_id, doc_id, score,
         row_number() over (partition by item_id order by score desc, doc_id nulls last, r) as rank
  from s where score > 0)
where rank <= 50"""
