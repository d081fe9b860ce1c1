"""Spelling variants against plain Python over the same words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import common, spelling

SMALL = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows) -> dict[str, int]:
    n: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_near(words) -> dict[str, set[str]]:
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1:]].add(w)
            if (less := w[:i] + w[i + 1:]) in words:
                near[w].add(less)
                near[less].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_groups(counts: dict[str, int], factor: int = 10) -> set[tuple]:
    near, form = plain_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= factor * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def rows_of(df) -> set[tuple]:
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    want = plain_groups(plain_words(docs))
    assert rows_of(spelling.op11_spelling_variants(spark, "/root/testdata/sf0.001")) == want
    assert any(w[1] for w in want) and any(w[4] > 1 for w in want)


def variants(seed: int, n: int) -> dict[str, int]:
    """Words over three letters, so that many are one or two edits apart and share halves."""
    rnd = random.Random(seed)
    return {"".join(rnd.choice("abÿ") for _ in range(rnd.choice((7, 8, 9)))): rnd.choice((2, 3, 25, 30, 300, 4000)) for _ in range(n)}


@pytest.mark.parametrize("block", [4, 1024])  # sub-blocks, whole blocks
def test_dense_words(spark, block):
    counts = variants(block, 700)
    got = rows_of(spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n bigint"), block=block))
    want = plain_groups(counts)
    assert got == want
    assert any(w[1] and w[2] != w[1] for w in want)  # paths of two steps


def test_every_kind_of_edit():
    words = ["abcdefgh", "abcdefgx", "xbcdefgh", "abcefgh", "abccdefgh", "bcdefgh", "abcdefg", "abdcefgh", "abcdefghi"]
    found = set()
    for short in (7, 8, 9):
        for at_end in (False, True):
            halves = defaultdict(list)
            for w in words:
                if len(w) in (short, short + 1):
                    halves[w[-(short - short // 2):] if at_end else w[:short // 2]].append(w)
            for group in halves.values():
                n = len(group)
                i, j = spelling.near_pairs(group, np.full(n, short), np.full(n, at_end), np.zeros(n, int), np.zeros(n, int), np.zeros(n, bool))
                pairs = [tuple(sorted((group[a], group[b]))) for a, b in zip(i, j, strict=True)]
                assert not found & set(pairs)  # no pair is found twice
                found |= set(pairs)
    want = {tuple(sorted((a, b))) for a, near in plain_near(set(words)).items() for b in near}
    assert found == want and ("abcdefgh", "abdcefgh") not in found


def test_ties_go_to_the_smallest_word(spark):
    counts = {"abcdefg": 2, "abcdefx": 50, "abcdefà": 50, "abcdefh": 50, "zzzzzzz": 2}
    got = {r[0]: r for r in rows_of(spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n bigint")))}
    assert got["abcdefg"] == ("abcdefg", "abcdefh", "abcdefh", 2, 3, 50)
    assert got["zzzzzzz"] == ("zzzzzzz", None, "zzzzzzz", 2, 0, None)


def test_awkward_documents(spark, docs, rows, clashing, no_docs):
    def words(df):
        return spelling.word_counts(spelling.letter_runs(df, 7).select(F.col("run").alias("word")))
    want = Counter(run.translate(SMALL) for r in rows for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""))
    want = {(w, n) for w, n in want.items() if len(w) >= 7 and n >= 2}
    for df in (docs, clashing.withColumns({"run": F.lit("own"), "word": F.lit("own"), "n": F.lit(1)})):
        assert {tuple(r) for r in words(df).collect()} == want
    assert rows_of(spelling.spelling_groups(words(docs))) == plain_groups(dict(want))
    assert rows_of(spelling.spelling_groups(words(no_docs))) == set()


def test_a_factor_below_two_is_refused(spark):
    with pytest.raises(ValueError):
        spelling.spelling_groups(spark.createDataFrame([("abcdefg", 2)], "word string, n bigint"), factor=1)
