"""Operator 4 against the SQL and against the contract's words."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from churnlens.llm import common, mixing


def run(monkeypatch, docs):
    monkeypatch.setattr(common, "table", lambda *a: docs)
    return mixing.op4_mix_sources(docs.sparkSession, "-").collect()


def plain_targets(sizes):
    """source -> target: share by weight, stop at twice the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-6 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: target[s] + left * weight[s] / total for s in open_}
        left = sum(max(0.0, share[s] - 2 * sizes[s]) for s in open_)
        for s in share:
            target[s] = min(share[s], 2.0 * sizes[s])
        open_ = {s for s in open_ if target[s] < 2 * sizes[s]}
    return target


def check(got, rows, blocks=3):
    n = {}
    for r in rows:
        n[r[3]] = n.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want, source = plain_targets(n), {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(n, 0)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == n[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in n:
        assert abs(taken[s] - want[s]) <= 64 * blocks, s


def test_awkward_documents(monkeypatch, docs, rows, clashing, no_docs):
    first = run(monkeypatch, docs)
    check(first, rows)
    assert sorted(map(str, first)) == sorted(map(str, run(monkeypatch, docs)))
    check(run(monkeypatch, clashing), rows)
    assert run(monkeypatch, no_docs) == []


def test_given_documents_against_sql(monkeypatch, spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    got = run(monkeypatch, docs)
    check(got, [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}')")
    assert sorted(map(tuple, got)) == sorted(con.execute(mixing.ORACLE).fetchall())


def test_every_stretch_of_the_schedule_is_near_its_shares(spark):
    targets = spark.createDataFrame([(0, "a", 0, 600.0), (1, "b", 0, 300.0), (2, None, 0, 100.0), (3, "z", 0, 0.0)],
                                    "ord int, source string, source_size bigint, target double")
    slots = sorted((r.slot, r.ord, r.rank) for r in mixing.schedule(targets, 40_000).collect())
    assert [s[0] for s in slots] == list(range(40_000))
    seen = [0, 0, 0]
    for k, (_, o, rank) in enumerate(slots):
        assert rank == seen[o]
        seen[o] += 1
        if k % 500 == 499:
            assert all(abs(seen[i] - (k + 1) * w) <= 4 for i, w in enumerate((0.6, 0.3, 0.1)))


def test_mixed_documents_hold_the_taken_words(spark, docs, rows):
    taken = {}
    for r in mixing.taken_words(docs).collect():
        taken.setdefault(r.doc_id, []).append(r.taken)
    given = docs.withColumn("size", F.lit("own"))
    mixed = mixing.mixed_documents(given)
    assert mixed.columns == given.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {i: sum(t) for i, t in taken.items() if sum(t)}


def test_small_sources_give_what_their_targets_ask_for(monkeypatch, spark):
    def table(rows):
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    one = table([(1, "word " * 20, "en", "a", 100)])
    assert [(r.size, r.target, r.taken) for r in run(monkeypatch, one)] == [(20, 30.0, 30)]
    rows = [(1, "word " * 20, "en", "a", 100)] + [(i, "word " * 10, "en", "b", 50) for i in range(2, 400)]
    got = {r.doc_id: r for r in run(monkeypatch, table(rows))}
    assert got[1].target == 40 and got[1].taken == 40
    assert sum(r.taken for i, r in got.items() if i > 1) == round(got[2].target)
    many = [(i, "word " * (1 + i % 7), "en", f"s{i}", 0) for i in range(300)]  # targets below one block each
    for r in run(monkeypatch, table(many)):
        assert r.taken == round(r.target)


def test_a_cut_text_keeps_its_own_space(spark):
    df = spark.createDataFrame([(t, n) for t, n in (("  a\nb\t c d ", 3), ("a b", 1), ("x", 1), ("\n\n y\n", 1))], "t string, n int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["  a\nb\t c", "a", "x", "\n\n y"]


def test_rows_of_a_partition_follow_the_schedule(spark):
    rows = [(i, f"d{i} " * 64, "en", "ab"[i % 2], 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = mixing.mixed_documents(docs).select("source", F.spark_partition_id().alias("p")).collect()
    by_part: dict = {}
    for r in mixed:
        by_part.setdefault(r.p, []).append(r.source)
    assert any(len(set(part[:8])) == 2 for part in by_part.values())
    assert sum(r.source == "a" for r in mixed) == 200 and sum(r.source == "b" for r in mixed) == 100
