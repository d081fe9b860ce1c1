"""Tool calls answered in batch, against the same tools called one by one."""

from __future__ import annotations

from churnlens.operators import calls, insights
from churnlens.sources.tables import Model

SF = "/root/testdata/sf0.001"
CALL = "conv_id bigint, turn bigint, call_order bigint, tool string, args map<string,string>"


def summary(m, spark, *made) -> list:
    log = spark.createDataFrame([(i, 0, 0, tool, args) for i, (tool, args) in enumerate(made)], CALL)
    return sorted(calls.tool_result_summary(m, log).collect(), key=lambda r: r.conv_id)


def refs(m, spark, *made) -> dict:
    log = spark.createDataFrame([(i, 0, 0, tool, args) for i, (tool, args) in enumerate(made)], CALL)
    out: dict = {}
    for r in sorted(calls.tool_source_refs(m, log).collect(), key=lambda r: (r.tool, r.request, r.pos)):
        out.setdefault((r.tool, r.request), []).append(r.ref)
    return out


def test_rows_equal_those_of_single_calls(spark):
    m = Model(spark, SF)
    busy = m.fact_ticket.groupBy("customer_id").count().orderBy("count", ascending=False).first().customer_id
    seen = m.fact_usage.orderBy("date", ascending=False).first().customer_id
    made = [("get_customer_tickets", {"customer_id": busy, "limit": "3"}), ("get_customer_tickets", {"customer_id": busy, "status": "open"}),
            ("get_subscription_events", {"customer_id": busy, "limit": "4"}), ("list_customers", {"segment": "smb", "limit": "7"}),
            ("list_customers", {"status": "churned"}), ("rank_customer_risk", {"limit": "5", "segment": "SMB"}),
            ("rank_customer_risk", {}), ("rank_customer_risk", {"status": "canceled"}), ("resolve_customer_name", {"name": "r#0000000"}),
            ("resolve_customer_name", {"name": "%1"}), ("resolve_customer_name", {"name": "_"}),
            ("get_usage_change", {"segment": "enterprise"}), ("get_usage_trend", {"customer_id": seen, "weeks": "2"})]
    want = [insights.customer_tickets(m, busy, 3), insights.customer_tickets(m, busy, status="open"),
            insights.subscription_events(m, busy, 4), insights.list_customers(m, segment="smb", limit=7),
            insights.list_customers(m, status="churned"), insights.rank_customer_risk(m, 5, "SMB"), insights.rank_customer_risk(m),
            insights.rank_customer_risk(m, status="canceled"), insights.resolve_customer_name(m, "r#0000000"),
            insights.resolve_customer_name(m, "%1"), insights.resolve_customer_name(m, "_"),
            insights.usage_change(m, segment="enterprise").orderBy("customer_id"), insights.usage_trend(m, seen, 2)]
    key = ["ticket_id", "ticket_id", "source_ref"] + ["customer_id"] * 9 + ["source_ref"]
    got = summary(m, spark, *made)
    found = refs(m, spark, *made)
    log = spark.createDataFrame([(i, 0, 0, t, a) for i, (t, a) in enumerate(made)], CALL)
    requests = {r.conv_id: (r.tool, r.request) for r in calls._called(log).collect()}
    for i, (df, k) in enumerate(zip(want, key, strict=True)):
        expected = [r[k] for r in df.collect()]
        assert expected and found[requests[i]] == expected, made[i]
        assert got[i].row_count == len(expected) and len(got[i].sample) == min(5, len(expected))


def test_calls_that_find_nothing_stay_and_are_warned_of(spark, fx):
    made = [("get_customer_profile", {"customer_id": "CUST-9"}), ("get_customer_profile", {}),
            ("get_customer_profile", {"customer_id": "CUST-0001"}), ("resolve_customer_name", {"name": "  "}),
            ("resolve_customer_name", {"name": "Nobody"}), ("resolve_customer_name", {"name": "alph"}),
            ("get_customer_tickets", {"customer_id": "CUST-0009"}), ("drop_tables", {})]
    log = spark.createDataFrame([(i, 0, 0, t, a) for i, (t, a) in enumerate(made)], CALL)
    notes = {(r.tool, r.request): r.warning for r in calls.tool_warnings(fx, log).collect()}
    by_call = {r.conv_id: notes.get((r.tool, r.request)) for r in calls._called(log).collect()}
    counts = {r.conv_id: r.row_count for r in calls.tool_result_summary(fx, log).collect()}
    assert counts == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0}  # a tool that isn't registered has no answer
    assert by_call[0] == "Customer CUST-9 not found." and by_call[1] == "Customer None not found."
    assert by_call[2] is None and by_call[3] == "Empty customer name."
    assert by_call[4] == "No customer found matching 'Nobody'." and by_call[5] is None and by_call[7] is None


def test_equal_arguments_are_one_request(spark):
    rows = [(i, 0, 0, "list_customers", args) for i, args in enumerate([{"segment": "SMB", "limit": "2"}, {"limit": "2", "segment": "SMB"}])]
    assert calls.requests(spark.createDataFrame(rows, CALL)).count() == 1


def test_the_limit_is_bounded_before_the_exchange(spark):
    m = Model(spark, SF)
    log = spark.createDataFrame([(1, 0, 0, "get_customer_tickets", {"customer_id": "CUST-000000001"})], CALL)
    plan = calls._tickets(m, calls.requests(log))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_no_cross_join(spark):
    m = Model(spark, SF)
    log = spark.createDataFrame([(1, 0, 0, t, {"segment": "SMB"}) for t in calls.TOOLS], CALL)
    plan = calls.tool_result_summary(m, log)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
