"""Operator 10: counts against plain Python, rules on texts whose quality is known."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from churnlens.llm import common, rules

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def plain(doc_id, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places: dict = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), failed)


def run(monkeypatch, docs, labels):
    monkeypatch.setattr(common, "table", lambda spark, d, name: {"documents": docs, "labels": labels}[name])
    return rules.op10_quality_rules(docs.sparkSession, "-").collect()


def counts(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str)


def test_awkward_documents(monkeypatch, spark, docs, rows, clashing, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    want = sorted((plain(r[0], r[1]) for r in rows), key=str)
    got = run(monkeypatch, docs, none)
    assert counts(got) == want and all(r.kept == (not r.base_failed) for r in got)
    assert counts(run(monkeypatch, clashing, none)) == want
    assert run(monkeypatch, no_docs, none) == []


def test_given_documents_and_held_out_accuracy(monkeypatch, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = run(monkeypatch, docs, labels)
    assert counts(got) == sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=str)
    import zlib
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    right = [r.kept == bool(truth[r.doc_id]) for r in got if r.doc_id in truth]
    assert len(right) > 50 and sum(right) / len(right) > 0.95


def test_list_finds_the_planted_thresholds(spark):
    rows = []
    for i in range(600):
        symbols, stops = (i * 37 % 100) / 100, (i * 61 % 90) / 100
        poor = symbols >= 0.6 or (stops < 0.2 and symbols >= 0.3)
        rows.append((i, 0 if poor else 1, *[symbols if s == "symbols" else stops if s == "stops" else 0.5 for s in rules.STATS]))
    df = spark.createDataFrame(rows, "doc_id bigint, quality int, " + ", ".join(f"s_{s} double" for s in rules.STATS))
    learned = rules.learn(df)
    assert 2 <= len(learned) <= 6
    judged = df.withColumn("rule", rules.verdict(learned))
    wrong = judged.where(F.col("rule").isNull() != (F.col("quality") == 1)).count()
    assert wrong <= 12, [" and ".join(map(str, r)) for r in learned]


def test_null_labels_and_one_class(monkeypatch, spark, docs):
    labels = spark.createDataFrame([(4, None, 0), (None, 1, 0), (6, 1, 0), (999, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert all(r.kept == (not r.base_failed) for r in run(monkeypatch, docs, labels))
