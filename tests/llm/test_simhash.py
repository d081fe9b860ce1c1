"""Operator 7 against plain Python: hashes bit by bit, all pairs, connected components."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from churnlens.llm import common, simhash


def plain_fingerprint(text, width=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(len(words) - width + 1, 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, radius=2):
    """fps: [(id, fp)] -> smallest id reachable, per row."""
    distinct = sorted({f for _, f in fps})
    head = {f: f for f in distinct}

    def top(f):
        while head[f] != f:
            f = head[f]
        return f
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                head[top(a)] = top(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    return [(i, f"{f:016x}", least.get(top(f))) for i, f in fps]


def run(monkeypatch, docs):
    monkeypatch.setattr(common, "table", lambda *a: docs)
    return sorted(map(tuple, simhash.op7_simhash_bk_tree(docs.sparkSession, "-").collect()), key=str)


def test_awkward_documents(monkeypatch, docs, rows, clashing, no_docs):
    want = sorted(plain_components([(r[0], plain_fingerprint(r[1])) for r in rows]), key=str)
    assert run(monkeypatch, docs) == want
    assert run(monkeypatch, clashing) == want
    assert run(monkeypatch, no_docs) == []


def test_given_documents(monkeypatch, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    got = run(monkeypatch, docs)
    assert got == sorted(plain_components(fps), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_clusters_are_joined(spark, seed):
    rng = random.Random(seed)
    fps = []
    for _ in range(30):
        f = rng.getrandbits(64)
        fps.append(f)
        for _ in range(rng.randint(0, 25)):  # walks: each step within the radius of one before
            f = rng.choice(fps[-5:])
            for _ in range(rng.randint(0, 3)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    rows = list(enumerate(fps))
    df = spark.createDataFrame([(simhash._signed(f),) for f in set(fps)], "fp bigint").repartition(4)
    roots = {r.node % 2 ** 64: r.root for r in simhash.components(simhash.links(df, 2)).collect()}
    groups = {}
    for _, f in rows:
        groups.setdefault(roots.get(f, simhash._signed(f)), set()).add(f)
    want = {}
    for _, f, c in plain_components(rows):
        want.setdefault(c, set()).add(int(f, 16))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_tree_follows_only_edges_within_the_radius():
    rng = random.Random(3)
    values = [rng.getrandbits(16) for _ in range(500)]
    tree = simhash.BKTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for q in values[:60]:
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_one_of_each_group_stays(docs, rows):
    kept = simhash.first_of_each_group(docs.withColumn("root", F.lit("own")))
    assert kept.columns == [*docs.columns, "root"]
    got = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    want = {(c is None, c) for _, _, c in plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])}
    assert got == sorted(want)
