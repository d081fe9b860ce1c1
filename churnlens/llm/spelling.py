"""Spelling variants of words by blocked Gram matrices of letter counts (operator 11).

Two words are near if one inserted, deleted or replaced code point turns one into the
other. Then their letter counts are at a squared distance of 2 at most, and their lengths
are equal or adjacent. A task multiplies blocks of letter-count vectors: the product gives all
squared distances of a block at once, pairs at most two apart in adjacent lengths are
kept, and their edits are verified position by position.

Which words meet in a block: an edit leaves one half of the shorter word as it is, at the start or
at the end of the longer one. So blocks are keyed by the shorter length and one half, and a near
pair always meets; blocks of the whole of two lengths would grow with the square of the vocabulary.
A half that more than ``block`` words share is cut into sub-blocks, and each pair of sub-blocks is a
task of its own, so no group is held whole.

The form of a word is its most frequent near word if that is ``factor`` times as frequent; the
root is where following forms ends. Counts grow at least ``factor``-fold with each step, so paths
are short, and jumps of doubled length find all ends in a few joins.

Rows: null and empty texts have no words; a null doc_id counts as the empty string in what is
hashed; repeated rows count each; ties between forms go to the smallest word in code-point order;
words of any length are whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import common

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = "word string, other string, other_n bigint"
#: what names a block: the shorter length, which half, and that half
KEY = ["short", "at_end", "half"]
#: small blocks of one partition share a product up to so many rows
TOGETHER = 256


def letter_runs(docs: DataFrame, least_length: int = 1) -> DataFrame:
    """doc_id, run: the maximal runs of letters of at least ``least_length``, A-Z lower-cased."""
    # a shorter run never matches, and a longer one is matched whole from its first letter on
    runs = F.regexp_extract_all(common.whole_text(), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    return docs.select(F.col("doc_id"), F.explode(runs).alias("run")).select(
        "doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def word_counts(words: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """word, n of the words long and frequent enough; ``words`` has a column word."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _halves(word: Column) -> Column:
    """Keys of the blocks of a word, as the shorter one of a pair and as the longer one."""
    def keys(length: Column) -> list[Column]:
        head = F.floor(length / 2).cast("int")
        return [F.struct(length.alias("short"), F.lit(False).alias("at_end"), F.substring(word, F.lit(1), head).alias("half")),
                F.struct(length.alias("short"), F.lit(True).alias("at_end"), F.right(word, length - head).alias("half"))]
    n = F.length(word)
    return F.array(*keys(n), *keys(n - 1))


def _dealt(counts: DataFrame, block: int) -> DataFrame:
    """KEY, lo, hi, sub, word, n: rows of one (KEY, lo, hi) are a block, or a pair of sub-blocks if lo and hi differ."""
    keyed = counts.select("word", "n", F.explode(_halves(F.col("word"))).alias("key")).select("key.*", "word", "n")
    large = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block).select(
        *KEY, F.ceil(F.col("rows") / F.lit(block)).cast("int").alias("subs"))
    placed = keyed.join(large, KEY, "left").withColumn("subs", F.coalesce("subs", F.lit(1)))
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("word"), F.col("subs")).cast("int"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    return met.select(*KEY, F.least("sub", "with").alias("lo"), F.greatest("sub", "with").alias("hi"), "sub", "word", "n")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words as one zero-padded matrix, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.zeros((len(words), int(lengths.max())), np.uint32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return codes, lengths


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    letters, place = np.unique(codes, return_inverse=True)
    cell = np.arange(len(codes))[:, None] * len(letters) + place.reshape(codes.shape)
    counts = np.bincount(cell.ravel(), minlength=len(codes) * len(letters)).reshape(len(codes), -1)
    return counts[:, letters > 0].astype(np.float32)  # without the padding


def _leading(equal: np.ndarray) -> np.ndarray:
    """How many places are equal before the first that is not, row by row."""
    return np.where(equal.all(axis=1), equal.shape[1], np.argmin(equal, axis=1))


def near_pairs(words: list[str], short: np.ndarray, at_end: np.ndarray, block: np.ndarray,
               sub: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i the shorter, of near words within the same ``block``; in ``split`` blocks
    only pairs of different sub-blocks. ``short`` is the block's shorter length, ``at_end`` its half."""
    codes, lengths = _codes(words)
    counts = _letter_counts(codes)
    norm = (counts * counts).sum(axis=1)
    distance = norm[:, None] + norm[None, :] - 2 * (counts @ counts.T)
    ok = (distance <= 2) & (block[:, None] == block[None, :])
    ok[lengths != short] = False  # the first of a pair has the shorter length, the second that or one more
    ok &= ~(split[:, None] & (sub[:, None] == sub[None, :]))
    i, j = np.nonzero(ok)
    longer = lengths[j] > lengths[i]
    equal = ~longer & (i < j)
    a, b = i[equal], j[equal]
    hit = (codes[a] != codes[b]).sum(axis=1) == 1
    found = [(a[hit], b[hit])]
    a, b = i[longer], j[longer]
    for n in np.unique(lengths[a]).tolist():
        x, y = a[lengths[a] == n], b[lengths[a] == n]
        head = _leading(codes[x, :n] == codes[y, :n])
        tail = _leading((codes[x, :n] == codes[y, 1:n + 1])[:, ::-1])
        # a pair that shares both halves counts where it shares the first
        hit = (head + tail >= n) & ~(at_end[x] & (head >= n // 2))
        found.append((x[hit], y[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs in both directions; rows of a block stand together and small blocks share a product."""
    def multiply(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows < 2:
            return
        words = rows.column("word").to_pylist()
        lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
        i, j = near_pairs(words, rows.column("short").to_numpy(), rows.column("at_end").to_numpy(),
                          rows.column("block").to_numpy(), rows.column("sub").to_numpy(), lo != hi)
        if len(i):
            a, b = np.concatenate([i, j]), np.concatenate([j, i])
            word, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
            yield pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), n.take(pa.array(b))],
                                             names=["word", "other", "other_n"])

    names = [*KEY, "lo", "hi"]
    held: pa.Table | None = None
    number, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for name in names:
            column = batch.column(name).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        first = tuple(batch.column(name)[0].as_py() for name in names)
        new[0] = first != last
        last = tuple(batch.column(name)[-1].as_py() for name in names)
        block = number + np.cumsum(new)
        number = int(block[-1])
        rows = pa.Table.from_batches([batch]).append_column("block", pa.array(block))
        held = rows if held is None else pa.concat_tables([held, rows])
        starts = held.column("block").to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(starts[1:] != starts[:-1]) + 1))
        at = 0
        while len(ends := starts[starts > at]):  # the last block may go on in the next batch
            within = ends[ends <= at + TOGETHER]
            end = int(within[-1] if len(within) else ends[0])
            yield from multiply(held.slice(at, end - at))
            at = end
        held = held.slice(at)
    if held is not None:
        yield from multiply(held)


def near_words(counts: DataFrame, block: int = 1024) -> DataFrame:
    """word, other, other_n: every pair of near words, in both directions."""
    order = [*KEY, "lo", "hi"]
    dealt = _dealt(counts, block).repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_pairs, NEAR)


def roots(forms: DataFrame, rounds: int = 6) -> DataFrame:
    """word, root for the words that have a form, by jumps of doubled length.

    A path has fewer than 2**rounds steps: with a factor of 10, counts below 10**64 allow no longer one.
    """
    at = common.stored(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    for _ in range(rounds):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = common.stored(at.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    return at


def spelling_groups(counts: DataFrame, factor: int = 10, block: int = 1024) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``counts`` (word, n; words distinct)."""
    if factor < 2:
        raise ValueError("factor must be 2 or more, so that following forms ends")
    known = common.stored(counts.select("word", F.col("n").cast("bigint").alias("n")), "spelling-counts")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_words(known, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    ranked = known.join(near, "word", "left")
    takes = -F.col("best.n") >= F.lit(factor) * F.col("n")
    formed = common.stored(ranked.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(takes, F.col("best.word")).alias("form"),
        F.when(takes, -F.col("best.n")).alias("form_n")), "spelling-near")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The contract's words: a run loses one code point where 31 divides the hash of its document and itself."""
    runs = letter_runs(common.table(spark, sf_dir, "documents"), 7)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling_groups(word_counts(words))
