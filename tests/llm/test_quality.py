"""Operator 8: the machine's identity, held-out accuracy, and awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from churnlens.llm import common, quality_fm


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.WIDTH), rng.normal(size=(quality_fm.WIDTH, quality_fm.RANK)),
                           np.zeros(quality_fm.DENSE), np.ones(quality_fm.DENSE))
    places, values = m.row("one two three three\nfour! #5")
    pairs = sum((m.factors[a] @ m.factors[b]) * values[i] * values[j]
                for i, a in enumerate(places) for j, b in enumerate(places) if i < j)
    assert abs(m.raw(places, values) - (m.bias + m.linear[places] @ values + pairs)) < 1e-6


def run(monkeypatch, docs, labels):
    monkeypatch.setattr(common, "table", lambda spark, d, name: {"documents": docs, "labels": labels}[name])
    return quality_fm.op8_quality_fm(docs.sparkSession, "-").collect()


def test_held_out_accuracy_and_reruns_agree(monkeypatch, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in run(monkeypatch, docs, labels)}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    again = {r.doc_id: r.score for r in run(monkeypatch, docs.repartition(5), labels.repartition(2))}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in got.items())


def test_held_out_labels_are_not_used(monkeypatch, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_fm.remainder(F.col("doc_id")) == 0, 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in run(monkeypatch, docs, x)} for x in (labels, turned))
    assert a == b


def test_awkward_rows(monkeypatch, spark, docs, clashing, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (7, None, 0), (None, 1, 0), (999, 0, 0), (4, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    got = run(monkeypatch, docs, labels)
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len(run(monkeypatch, clashing, labels)) == docs.count()
    assert run(monkeypatch, no_docs, labels) == []
    assert {r.score for r in run(monkeypatch, docs, labels.limit(0))} == {0.5}
    kept = quality_fm.keep_good(clashing, labels)
    assert kept.columns == clashing.columns
