"""Operator 9 against a full sort on Python's integers."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from churnlens.llm import common, topk


def plain(rows, every=50, k=5):
    """Every row but the query's own is a candidate, rows that share a vec_id too."""
    vectors = [(i, [min(max(math.floor(256 * float(x)), topk.LEAST), topk.MOST) for x in v]) for i, v in rows
               if i is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(vectors):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(vectors) if n != at)
            out += [(i, n + 1, j, min(max(-s, topk.LEAST), topk.MOST)) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(monkeypatch, table):
    monkeypatch.setattr(common, "table", lambda *a: table)
    return sorted(map(tuple, topk.op9_top_k(table.sparkSession, "-").collect()))


def test_given_vectors(monkeypatch, spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert run(monkeypatch, table) == plain([(r.vec_id, r.embedding) for r in table.collect()])


def test_ties_nulls_and_odd_lengths(monkeypatch, spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(200)]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")]), (450, [float("inf"), 1.0]), (None, [1.0] * 6),
             (500, []), (550, [1.0] * 9), (50, rows[50][1]), (50, [9.0] * 6), (600, [-0.001, 0.003])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    want = plain(rows)
    assert run(monkeypatch, table) == want
    assert run(monkeypatch, table.withColumns({c: F.lit("x") for c in ("part", "score", "rank", "v", "n", "row", "query_row", "ids", "rows")})) == want
    assert run(monkeypatch, table.limit(0)) == []


def test_large_components_are_exact(monkeypatch, spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** 22 for _ in range(5)]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert run(monkeypatch, table) == plain(rows)


def test_repeated_ids_are_candidates_and_queries_each(monkeypatch, spark):
    rows = [(50, [1.0, 2.0]), (50, [3.0, -1.0]), (50, [1.0, 2.0]), (7, [0.5, 0.5]), (7, [2.0, 2.0]), (8, [2.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(2)
    got = run(monkeypatch, table)
    assert got == plain(rows) and len(got) == 15


def test_components_that_leave_64_bits_have_a_defined_score(monkeypatch, spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.choice([10, 40, 60, 100]) for _ in range(4)]) for i in range(100, 160)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(2)
    got = run(monkeypatch, table)
    want = {(i, j): s for i, v in rows if i % 50 == 0 for j, s in all_scores(i, v, rows)}
    for i in {r[0] for r in got}:
        mine = [r for r in got if r[0] == i]
        best = sorted((s for (q, _), s in want.items() if q == i), reverse=True)[:5]
        assert [r[3] for r in mine] == best and all(want[i, r[2]] == r[3] for r in mine)


def all_scores(i, v, rows):
    def whole(x):
        return min(max(math.floor(256 * x), topk.LEAST), topk.MOST)
    for j, w in rows:
        if j != i:
            yield j, min(max(sum(whole(a) * whole(b) for a, b in zip(v, w)), topk.LEAST), topk.MOST)


def test_several_passes_and_blocks(monkeypatch, spark):
    rng = random.Random(11)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(20)]) for i in range(900)]
    monkeypatch.setattr(topk, "PASS_QUERIES", 512)
    table = topk.whole_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = sorted(tuple(r) for r in topk.top_k(table, table, 3).collect())
    assert got == plain(rows, 1, 3)


def test_bounds_never_lose_a_candidate():
    rng = np.random.default_rng(8)
    c = (rng.standard_normal((64, 700)) * np.linspace(3, 0.1, 64)[:, None] * 40).astype("<i8")
    ids = np.arange(700)
    for step in (4, 16, 64):
        for i, near, scores in topk.best_in_block(ids[:20], c[:, :20], ids, c, 5, step):
            full = c.T @ c[:, i]
            order = [j for j in np.lexsort((ids, -full)) if j != i][:5]
            assert near.tolist() == order and scores.tolist() == full[order].tolist()
