"""SimHash near-duplicates by BK-trees over shards (operator 7).

A fingerprint has a bit for each of 64 places: 1 if more than half of the
hashes of the text's word shingles have it. Texts link where fingerprints differ in at
most ``radius`` bits.

Only distinct fingerprints are compared. They are cut into ``radius + KEEP``
blocks of bits; two that differ in at most ``radius`` bits agree in some ``KEEP``
blocks, so each is sent to one shard per choice of ``KEEP`` blocks, and every linked pair
meets in a shard. A shard is searched by a BK-tree: children are keyed by their
distance to the parent, and a search follows only the edges within the radius of its
own distance. The shards' trees are dealt to the executors by a shuffle together
with their queries, not broadcast: all of them together grow with the corpus.
A shard holds fingerprints that agree in two thirds of their bits, so copies
(one fingerprint) take one node however many they are.

A shard gives at most one link per node (to the head of its part), and the links
are joined to components by rounds of contraction: each node goes to the smallest hash
among itself and its neighbours, which at least halves what is left in expectation. All
of it stays in tables; nothing is collected.

Rows: null, empty and blank texts have fingerprint 0 and link like any other;
a text with fewer words than a shingle has one shingle of all its words; repeated rows
are each returned; a null doc_id is returned and is never a component's id unless
no other is there; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import common

KEEP = 4
SEED = 42
#: hashes whose bits are counted at once, which bounds memory for very long texts
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 majority bits over the XXH64 hashes of word shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        top = min(at + CHUNK, n)
        spans = zip(starts[at:top].tolist(), ends[at + width - 1:top + width - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", top - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(fps.view("<i8"))],
                                             names=["_row", "doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, width: int = 3, row: Column | None = None) -> DataFrame:
    """_row (new numbers unless given), doc_id, fp (the 64 bits as a long)."""
    row = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(row.alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints(width), f"_row {kind}, doc_id bigint, fp bigint")


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.root: tuple[int, int, dict] | None = None

    def add(self, value: int, number: int) -> None:
        if self.root is None:
            self.root = (value, number, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d not in node[2]:
                node[2][d] = (value, number, {})
                return
            node = node[2][d]

    def within(self, value: int, radius: int) -> list[int]:
        found, ahead = [], [self.root] if self.root else []
        while ahead:
            other, number, children = ahead.pop()
            d = (other ^ value).bit_count()
            if d <= radius:
                found.append(number)
            if children:
                ahead += [children[e] for e in range(max(d - radius, 0), d + radius + 1) if e in children]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links from each value to the head of its part, for the values of one shard."""
    head = list(range(len(values)))

    def top(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i
    tree = BKTree()
    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = top(i), top(j)
            if a != b:
                head[max(a, b)] = min(a, b)
        tree.add(value, i)
    return [(values[i], values[top(i)]) for i in range(len(values)) if top(i) != i]


def block_masks(radius: int) -> list[int]:
    """One mask per choice of KEEP of the radius + KEEP blocks."""
    bounds = [64 * i // (radius + KEEP) for i in range(radius + KEEP + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, KEEP)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search(radius: int):
    def links(values: list[int]) -> Iterator[pa.RecordBatch]:
        if len(values) > 1 and (found := shard_links(values, radius)):
            a, b = (np.array(x, "<u8").view("<i8") for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, values = None, []
        for batch in batches:  # rows of a shard stand together
            if not batch.num_rows:
                continue
            no, key = batch.column("no").to_numpy(), batch.column("key").to_numpy()
            fps = batch.column("fp").to_numpy().view("<u8")
            cuts = np.flatnonzero((no[1:] != no[:-1]) | (key[1:] != key[:-1])) + 1
            edges = [0, *cuts.tolist(), len(fps)]
            # most shards hold one row; only the ends and the larger ones need a look
            sizes = np.diff(edges)
            for i in sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 1).tolist()}):
                at = edges[i]
                own = (int(no[at]), int(key[at]))
                if own != shard:
                    yield from links(values)
                    shard, values = own, []
                values += fps[at:edges[i + 1]].tolist()
        yield from links(values)
    return run


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: links that connect all of the distinct ``fp`` within the radius, directly or by way of others."""
    masks = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(block_masks(radius))])
    shards = distinct.select("fp", F.explode(masks).alias("m")).select(
        F.col("m.no").alias("no"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp")
    dealt = shards.repartition("no", "key").sortWithinPartitions("no", "key", "fp")
    return dealt.mapInArrow(_search(radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges, by contraction."""
    def order(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = common.stored(edges.select("a", "b"), "simhash-links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = nodes.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a")))["v"].alias("to"))
        to = common.stored(to, "simhash-heads")
        roots = common.stored(roots.join(to.select(F.col("a").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")), "simhash-roots")
        up = edges.join(to.withColumnRenamed("to", "ta"), "a").join(
            to.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        edges = common.stored(up.where("ta <> tb").select(
            F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "simhash-links")
    return roots


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2,
                    row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(_row, doc_id, fp of every row; node, root of the fingerprints that link to others)."""
    known = common.stored(fingerprints(docs, width, row), "simhash-fingerprints")
    return known, components(links(known.select("fp").distinct(), radius))


def component_ids(known: DataFrame, found: DataFrame) -> DataFrame:
    """fp, component_id: the smallest doc_id in the component of each fingerprint.

    Copies are merged to their fingerprint first, and each table that meets a hot key is
    written before the join, so that the join can split that key's rows.
    """
    own = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = own.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = common.stored(rooted, "simhash-rooted")
    least = common.stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    return common.stored(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")


def first_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id stays.

    Texts meet the decisions on the row's place in its file, once, by the same kind of join at every size;
    nothing else of the documents is written.
    """
    rows = common.nested(docs, "simhash-rows")
    known, found = near_duplicates(rows.select("key", "doc.doc_id", "doc.text"), row=F.col("key"), **options)
    grouped = known.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    stays = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("key"))
    return common.unnested(rows.join(common.stored(stays.select("key"), "simhash-stays").hint("merge"), "key", "left_semi"), docs)


def op7_simhash_bk_tree(spark, sf_dir: str) -> DataFrame:
    known, found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return known.join(component_ids(known, found), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
