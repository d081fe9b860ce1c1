"""The pipeline: each stage against plain Python on its own input."""

from __future__ import annotations

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_simhash import plain_components, plain_fingerprint  # noqa: E402

from churnlens.llm import common, mixing, quality_fm  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (rows before, rows after)."""
    docs, out = common.table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def test_columns(stages):
    want = ["doc_id", "text", "lang", "source", "n_chars"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == want


def test_quality_drops_what_it_rejects(spark, stages):
    before, after = stages["quality"]
    machine = quality_fm.train(before, common.table(spark, SF, "labels"))
    want = sorted(r.doc_id for r in before.collect() if machine.score(r.text) >= 0.3)
    assert sorted(r.doc_id for r in after.collect()) == want and 0 < len(want) < before.count()


def test_one_document_of_each_group(stages):
    before, after = stages["near_dedup"]
    groups = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in groups})


def test_no_secret_is_left(stages):
    before, after = stages["secrets"]
    old = {r.doc_id: r.text for r in before.collect()}
    new = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    assert old.keys() == new.keys()
    for i, (text, n) in new.items():
        assert not any(brute.base_spans(text, brute.SECRETS)[0])
        if not any(brute.base_spans(old[i], brute.SECRETS)[0]):
            assert text == old[i]
        assert n == len(text)


def test_mix_takes_what_the_operator_says(stages):
    before, after = stages["mix"]
    want = {r.doc_id: r.taken for r in mixing.taken_words(before).collect() if r.taken}
    got: dict = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == want


def test_packing_covers_every_token(stages):
    before, after = stages["pack"]
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    by_bin: dict = {}
    for r in pieces:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in pieces)
    assert len(by_bin) <= 1.03 * total / 2048 + 2


def test_empty_documents(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0


@pytest.mark.parametrize("name", ["near_dedup", "secrets", "mix"])
def test_rows_stay_themselves_when_scans_pack_files_anew(spark, monkeypatch, tmp_path, name):
    path = str(tmp_path / "documents.parquet")
    common.table(spark, SF, "documents").withColumn("text", F.concat("text", F.lit(" pwd = Live77kkTT"), "doc_id")).repartition(
        24).write.parquet(path)
    docs, stored, key = spark.read.parquet(path), common.stored, "spark.sql.files.maxPartitionBytes"
    stage, given = dict(corpus_pipeline.STAGES)[name], spark.conf.get(key)

    def rows(packed_anew):
        def store(df, at):
            out = stored(df, at)
            if packed_anew:  # later scans of the documents put each file into a partition of its own
                spark.conf.set(key, "16k")
            return out
        monkeypatch.setattr(common, "stored", store)
        spark.conf.set(key, given)
        return sorted(map(tuple, stage(spark, docs, SF).collect()))
    try:
        assert rows(True) == rows(False)
    finally:
        spark.conf.set(key, given)


def test_a_run_leaves_only_the_rows_of_the_last_stage(spark, monkeypatch, tmp_path):
    import itertools
    numbers = itertools.count()
    monkeypatch.setattr(common, "shared_folder", lambda spark, name: str(tmp_path / f"{name}-{next(numbers)}"))
    out = corpus_pipeline.run(spark, SF)
    left = [p.name for p in tmp_path.iterdir()]
    assert len(left) == 1 and left[0].startswith("pipeline-pack") and out.count() > 0


def test_intermediates_stay_when_a_table_outside_is_stored(spark, tmp_path, monkeypatch):
    import itertools
    numbers = itertools.count()
    monkeypatch.setattr(common, "shared_folder", lambda spark, name: str(tmp_path / f"{name}-{next(numbers)}"))
    kept = common.stored(spark.range(3), "kept")
    with common.removed_after(spark):
        assert common.stored(spark.range(4), "gone").count() == 4
    assert kept.count() == 3 and [p.name for p in tmp_path.iterdir()] == ["kept-0"]
