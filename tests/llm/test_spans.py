"""Operators 2 and 5: base spans against plain Python, and what the methods add."""

from __future__ import annotations

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

from churnlens.llm import pii, secret_scan  # noqa: E402


class _Files:
    """Stands for a folder of tables in the queries under test."""


def _run(monkeypatch, module, query, docs):
    monkeypatch.setattr(module.common, "table", lambda *a: docs)
    return query(docs.sparkSession, "-")


def _check(got, rows, kinds):
    want = sorted(((r[0] if r[0] is not None else -1), tuple(c), h) for r in rows
                  for c, h, _ in [brute.base_spans(r[1], kinds)])
    have = sorted(((r[0] if r[0] is not None else -1), tuple(r[1:1 + len(kinds)]), r["base_sha256"]) for r in got)
    assert have == want
    texts = {r[0]: r[1] for r in rows}
    for r in got:  # base ones stay, in order among all spans
        _, _, line = brute.base_spans(texts[r["doc_id"]], kinds)
        every = r["spans"].split(",") if r["spans"] else []
        assert [s for s in every if s.split(":")[0] in kinds] == (line.split(",") if line else [])


def test_personal_data(monkeypatch, docs, rows):
    got = _run(monkeypatch, pii, pii.op2_personal_data, docs).collect()
    _check(got, rows, brute.PII)


def test_secrets(monkeypatch, docs, rows):
    got = _run(monkeypatch, secret_scan, secret_scan.op5_secret_scan, docs).collect()
    _check(got, rows, brute.SECRETS)


def test_given_documents(monkeypatch, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    _check(_run(monkeypatch, pii, pii.op2_personal_data, docs).collect(), rows, brute.PII)
    _check(_run(monkeypatch, secret_scan, secret_scan.op5_secret_scan, docs).collect(), rows, brute.SECRETS)


def test_empty_and_clashing(monkeypatch, no_docs, clashing, docs, rows):
    for module, query, kinds in ((pii, pii.op2_personal_data, brute.PII),
                                 (secret_scan, secret_scan.op5_secret_scan, brute.SECRETS)):
        assert _run(monkeypatch, module, query, no_docs).count() == 0
        _check(_run(monkeypatch, module, query, clashing).collect(), rows, kinds)


def test_many_matches_in_one_text(monkeypatch, spark):
    text = "x a@b.cd " * 3000
    docs = spark.createDataFrame([(1, text, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    _check(_run(monkeypatch, pii, pii.op2_personal_data, docs).collect(), [(1, text)], brute.PII)


def _corpus(spark):
    rows = [(i, f"mail a{i}@b.org or call +1 (524) 555-{7000 + i} now, tel 555-123-{4000 + i}", "en", f"s{i % 9}", 0)
            for i in range(60)]
    rows += [(100 + i, f"part number {4111111111111112 + 10 * i} is order 123-45-{6000 + i}", "en", "s1", 0) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_labelers_agree_on_phones_not_on_part_numbers(spark):
    got = {r.doc_id: [s["kind"] for s in r.added or []] for r in pii.find_personal_data(_corpus(spark)).collect()}
    assert all(got[i] == ["phone_like"] for i in range(60))
    assert not any(got[100 + i] for i in range(40))


def test_em_finds_the_unreliable_labeler():
    patterns = [("k", (1, 1, 1, 1), 400), ("k", (-1, -1, -1, -1), 400), ("k", (1, 1, 1, -1), 300), ("k", (-1, -1, -1, 1), 300)]
    _, says, posterior = pii.reliabilities(patterns)
    assert posterior["k", (1, 1, 1, -1)] > 0.95 and posterior["k", (-1, -1, -1, 1)] < 0.05
    assert says[0][1][1] > 0.9 and says[3][1][1] < 0.7


def test_ownership_separates_copies_from_credentials(spark):
    copied, own = "pwd = Zz91kLmnopQ8", "pwd = Live77kkTTx2"
    rows = [(i, f"docs say {copied} here", "en", f"s{i}", 0) for i in range(5)]
    rows += [(10, f"my {own}", "en", "s7", 0), (11, f"again {own}", "en", "s7", 0), (12, "pwd = example12345", "en", "s8", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    scanned = secret_scan.scan(docs)
    judged = secret_scan.ownership(secret_scan.candidates(scanned)).collect()
    assert sorted((r.n_repositories, r.n_owners, r.verdict) for r in judged) == [
        (1, 1, "unclear"), (2, 1, "live"), (5, 5, "copied")]
    got = {r.doc_id: bool(r.added) for r in secret_scan.find_secrets(docs).collect()}
    assert [i for i, yes in got.items() if yes] == [10, 11] or sorted(i for i, yes in got.items() if yes) == [10, 11]


def test_redaction_leaves_no_secret(docs, rows):
    got = secret_scan.redact(docs).collect()
    assert len(got) == len(rows)
    before = {r[0]: r[1] for r in rows}
    for r in got:
        counts, _, _ = brute.base_spans(r.text, brute.SECRETS)
        assert not any(counts), r.text[:200]
        if not any(brute.base_spans(before[r.doc_id], brute.SECRETS)[0]) and "pwd" not in (before[r.doc_id] or ""):
            assert r.text == before[r.doc_id]
    assert secret_scan.redact(docs.withColumn("_x", F.lit(1))).columns == [*docs.columns, "_x"]


def test_many_repositories_of_one_owner_are_copies_and_stay(spark):
    copied, own = "pwd = Zz91kLmnopQ8", "pwd = Live77kkTTx2"
    rows = [(i, f"docs say {copied} here", "en", "s1", 0) for i in range(30)]
    rows += [(50, f"\U0001f600 {copied}, my {own}; {copied} password = {own[6:]} token=ghp_{'aB3dE6gH9' * 4}+more end", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    judged = secret_scan.ownership(secret_scan.candidates(secret_scan.scan(docs))).collect()
    assert ("copied", 31, 1) in [(r.verdict, r.n_repositories, r.n_owners) for r in judged]
    found = {r.doc_id: (r.n_live or 0, r.n_copied or 0, len(r.added or [])) for r in secret_scan.find_secrets(docs).collect()}
    assert found[0] == (0, 1, 0) and found[50][1:] == (2, 2)
    got = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    mark = secret_scan.MARK
    assert got[50] == f"\U0001f600 {copied}, my {mark}; {copied} {mark} {mark} end"
    assert all(got[i] == rows[i][1] for i in range(30))


def test_account_numbers_of_every_listed_country_are_whole(spark):
    numbers = ["AT611904300234573201", "BE68539007547034", "CH9300762011623852957", "DE89370400440532013000", "ES9121000418450200051332",
               "FR1420041010050500013M02606", "GB29NWBK60161331926819", "IE29AIBK93115212345678", "IT60X0542811101000000123456",
               "LU280019400644750000", "NL91ABNA0417164300", "PL61109010140000071219812874", "PT50000201231234567890154",
               "SE4550000000058398257466", "NO9386011117947", "MT84MALT011000012345MTLCAST001S", "HU42117730161111101800000000"]
    spaced = [" ".join(n[i:i + 4] for i in range(0, len(n), 4)) for n in numbers]
    texts = [f"iban {n}{after}" for n in numbers + spaced for after in (".", "", " to me", " AND 12 MORE", ", 5")]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spans, each = pii.candidates(docs)
    got = {r.doc_id: [s["value"] for s in r["_spans_account_like"]] for r in spans.collect()}
    assert got == {i: [(numbers + spaced)[i // 5]] for i in range(len(texts))}
    listed = {r.gazetteer for r in each.where("kind = 'account_like'").select("gazetteer").distinct().collect()}
    assert listed == {1, -1}


def test_names_with_a_prefix_are_candidates(spark):
    values = ["wJalrXUtnFEMI7K8MDENG", "q7Rt55aaXy21bb", "Zz91kLmnopQ8"]
    text = f"AWS_SECRET_ACCESS_KEY={values[0]} db2_pwd: '{values[1]}' DB_PWD = {values[2]}"
    docs = spark.createDataFrame([(1, text + " xghp_" + "a1B2" * 9, "en", "s", 0), (2, "_" * 20000, "en", "s", 0)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    r = next(r for r in secret_scan.find_secrets(docs).collect() if r.doc_id == 1)
    found = sorted((s["start"], text[s["start"]:s["end"]]) for s in r.added)
    assert [f for _, f in found] == [f"AWS_SECRET_ACCESS_KEY={values[0]}", f"db2_pwd: '{values[1]}", f"DB_PWD = {values[2]}"]
