"""Lexical search against plain Python scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from churnlens.llm import common, lexical

TERM = re.compile(lexical.TERM)
SMALL = str.maketrans(lexical.UPPER, lexical.LOWER)
SF = "/root/testdata/sf0.001"


def plain_terms(text) -> list[str]:
    return TERM.findall((text or "").translate(SMALL))


def plain_search(docs: list[tuple], items: list[tuple], k: int = 50) -> list[tuple]:
    """Sorted (item_id, rank, doc_id, score) rows."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    n_terms = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc_id, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // n_terms if bag else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                        for t in terms if t in bag)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_whole_tables(spark):
    docs, items = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(lexical.op12_lexical_search(spark, SF)) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    assert sorted(con.execute(f"select item_id, rank, doc_id, score from ({lexical.ORACLE})").fetchall(), key=repr) == want


ITEMS = [(1, "the same text"), (2, "IBAN de89 été@café.fr"), (3, None), (4, ""), (5, "nothing of this kind xyzzy"), (None, "wort und WORT"),
         (6, "one two words"), (6, "iban"), (6, "iban"), (7, "\U0001f600 10 0 a")]


def test_awkward_documents(spark, docs, rows, clashing, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = plain_search([(r[0], r[1]) for r in rows], ITEMS)
    assert found(lexical.search(docs, items)) == want
    wide = items.withColumns({"item": F.lit(0), "terms": F.lit("x"), "doc_id": F.lit(9)})
    own = clashing.withColumns({c: F.lit("own") for c in ("key", "file", "row", "digest", "items", "item", "n", "signature")})
    assert found(lexical.search(own, wide, items_at_once=2)) == want  # several passes
    assert found(lexical.search(no_docs, items)) == []
    assert found(lexical.search(docs, items.limit(0))) == []
    assert found(lexical.search(docs, items, k=2)) == plain_search([(r[0], r[1]) for r in rows], ITEMS, 2)


def test_copies_and_ties(spark):
    """Of thousands of equal texts the k smallest doc_ids are returned, and equal scores of other texts compete with them."""
    rnd = random.Random(3)
    texts = [(i, "alpha beta gamma") for i in range(3000, 0, -1)] + [(i, f"gamma alpha beta {'' if i % 2 else '.'}") for i in range(3001, 3050)]
    texts += [(9000 + i, " ".join(rnd.choices(["alpha", "delta", "beta", "eps"], k=rnd.randint(1, 60)))) for i in range(300)]
    items = [(0, "alpha gamma"), (1, "delta delta eps"), (2, "beta")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    assert found(lexical.search(docs, spark.createDataFrame(items, "item_id bigint, text string"))) == plain_search(texts, items)


def test_bounds_are_never_below_scores():
    rnd = random.Random(5)
    vocabulary = [f"t{i}" for i in range(200)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice((1, 5, 40, 900)))) for _ in range(300)]
    held = lexical._Blocks()
    for i, t in enumerate(texts):
        held.add(i, "f", i, t)
    df = Counter(t.encode() for text in texts for t in set(text.split()))
    items = [(i, {t.encode() for t in rnd.sample(vocabulary, 12)}) for i in range(5)]
    q = lexical.prepare(items, df, len(texts), sum(len(t.split()) for t in texts))
    seen = 0
    for batch in held.blocks():
        block = {c: batch.column(c)[0].as_py() for c in batch.schema.names}
        for first, bound in lexical._bounds(q, block["signature"], block["slices"], block["n"]):
            for j in range(bound.shape[1]):
                exact = q.scores(texts[block["doc_id"][first + j]], list(range(5)))
                assert (bound[:, j].astype(float) >= np.array(exact)).all()
                seen += 1
    assert seen == len(texts)
