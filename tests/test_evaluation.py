"""Golden rows: list-valued entities, own expectations, details, and the nested report."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from churnlens.operators import evaluation, intents
from churnlens.plans.registry import _golden
from churnlens.sources import files
from churnlens.sources.tables import Model

SF = "/root/testdata/sf0.001"


def golden(**given) -> str:
    base = {"conv_id": 1, "turn": 0, "expected_intent": "ticket_query", "expected_route": "themes", "expected_entities": {},
            "expected_tools": [], "expected_retrieval": [], "expected_render": "markdown", "expects_recommendations": False,
            "expects_prioritization": False, "irrelevant": False, "no_data": False}
    return json.dumps(base | given)


def evaluated(spark, tmp_path, question: str, answer: dict | None, **given) -> dict:
    path = str(tmp_path / f"golden-{len(list(tmp_path.iterdir()))}")
    spark.createDataFrame([(golden(**given),)], "value string").write.text(path)
    q = intents.tag_questions(spark.createDataFrame([(1, 0, "user", question)], "conv_id bigint, turn bigint, role string, text string"))
    rows = [] if answer is None else [(1, 0, 1, json.dumps(answer))]
    a = spark.createDataFrame(rows, "conv_id bigint, turn bigint, answer_turn bigint, answer_json string")
    per = evaluation.metrics(evaluation.golden_frame(evaluation.read_golden(spark, path), q, a))
    return {r.metric: r for r in evaluation.long_metrics(evaluation.metrics_by_name(per)).collect()}


ANSWER = {"summary": "two are open", "confidence": "high", "facts": [{"heading": "T", "content": "TCK-0001 waits", "citations": []}],
          "interpretation": [], "recommendation": [], "other_sections": [], "render_hint": {"kind": "markdown"}}


def test_every_listed_entity_must_be_found(spark, tmp_path):
    text = "is ticket TCK-00042 or TCK-00043 of the smb segment open?"
    both = evaluated(spark, tmp_path, text, ANSWER, expected_entities={"ticket_ids": ["TCK-00042", "TCK-00043"], "segment": ["smb"]})
    assert both["entities"].passed and both["entities"].score == 1.0 and both["entities"].detail is None
    one = evaluated(spark, tmp_path, text, ANSWER, expected_entities={
        "ticket_ids": ["TCK-00042", "TCK-00099"], "segment": ["smb"], "plan": ["team"], "feedback_ids": []})
    assert not one["entities"].passed and one["entities"].score == 0.25
    assert one["entities"].detail == "missing feedback_ids|plan|ticket_ids"


def test_expectations_are_not_those_of_the_classifier(spark, tmp_path):
    got = evaluated(spark, tmp_path, "is ticket TCK-00042 open?", ANSWER, expected_intent="trend", expected_route="trend")
    assert not got["intent"].passed and got["intent"].detail == "expected trend, got ticket_query"
    assert not got["routing"].passed and got["citations"].passed and got["render"].passed


def test_tools_retrieval_and_what_an_answer_must_hold(spark, tmp_path):
    got = evaluated(spark, tmp_path, "is ticket TCK-00042 open?", ANSWER | {"other_sections": [
        {"heading": "Priorities", "content": "this first", "citations": []}]}, expected_tools=["get_ticket_breakdown", "get_usage_trend"],
        expected_retrieval=["waits", "invoice"], expects_recommendations=True, expects_prioritization=True, expected_render="table")
    assert got["tools"].score == 0.5 and got["tools"].detail == "missing get_usage_trend"
    assert got["retrieval"].score == 0.5 and got["retrieval"].detail == "missing invoice"
    assert not got["recommendations"].passed and got["prioritization"].passed
    assert got["render"].detail == "expected table, got markdown"


def test_a_question_without_an_answer_fails_what_needs_one(spark, tmp_path):
    got = evaluated(spark, tmp_path, "is ticket TCK-00042 open?", None, expects_recommendations=True, irrelevant=False)
    assert not got["citations"].passed and not got["confidence"].passed and not got["recommendations"].passed
    assert got["routing"].passed and got["irrelevant"].passed


def test_every_metric_passes_and_fails_somewhere(spark):
    rows = evaluation.long_metrics(evaluation.metrics_by_name(_golden(Model(spark, SF)))).groupBy("metric").agg(
        F.count_if("passed").alias("ok"), F.count_if(~F.col("passed")).alias("bad")).collect()
    assert {r.metric for r in rows} == set(evaluation.METRIC_NAMES)
    assert all(r.ok and r.bad for r in rows)


def test_the_report_reads_back_equal(spark, tmp_path):
    per = _golden(Model(spark, SF))
    path = files.write_report(evaluation.summary(per), evaluation.metrics_by_name(per), str(tmp_path / "report"))
    back = spark.read.schema(files.REPORT_QUESTION).json(f"{path}/questions")

    def flat(df):
        return sorted((r.conv_id, r.turn, r.passed_metrics, r.passed, sorted((k, *v) for k, v in r.metrics.items())) for r in df.collect())
    assert flat(back) == flat(evaluation.metrics_by_name(per))
    overall = spark.read.json(f"{path}/overall").collect()
    assert len(overall) == 1 and overall[0].questions == back.count()


def test_a_scorer_without_a_result_leaves_the_cosine_order(spark):
    from churnlens.operators import vectors
    rows = spark.createDataFrame([("ticket", "T1", "a", 0.2), ("ticket", "T2", "b", 0.9), ("feedback", "F1", "c", 0.9)],
                                 "record_type string, record_id string, text string, score double")
    got = vectors.rerank(rows, "x", k=3, scorer=lambda q, text: F.lit(None).cast("double")).orderBy("rank").collect()
    assert [r.record_id for r in got] == ["F1", "T2", "T1"]
    half = vectors.rerank(rows, "x", k=2, scorer=lambda q, text: F.when(text == "a", 0.5)).orderBy("rank").collect()
    assert [r.record_id for r in half] == ["T1", "F1"]


def test_an_empty_store_gives_no_sources(spark, fx):
    from churnlens.operators import vectors
    chunks = vectors.with_hash(vectors.chunks_all(fx))
    store = vectors.store_rows(vectors.embed(chunks.limit(0), embedded_at="2024-01-01"))
    found = vectors.retrieve(store, "search", k=5)
    assert found.count() == 0 and vectors.source_refs(found).count() == 0 and vectors.rerank(found, "search").count() == 0
    assert vectors.sync_delta(chunks, store).count() == chunks.count()
