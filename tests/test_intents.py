"""Question classification (cases of the reference's unit tests)."""

from churnlens.operators import intents

CASES = [
    ("Who is CUST-0001 and what's their profile?", "customer_query"),
    ("Show me ticket TCK-00042", "ticket_query"),
    ("What are the top complaints and themes?", "theme_sentiment"),
    ("Which segment has the highest churn? compare revenue at risk", "analytics_exec"),
    ("How have sessions changed over the last 4 weeks?", "trend"),
    ("Find feedback that mentions billing problems", "free_text_rag"),
    ("Hello there", "general"),
    ("What's the weather like in Paris?", "irrelevant"),
]


def test_intents(spark):
    df = spark.createDataFrame(CASES, "text string, expected string")
    out = intents.classify(df).select("intent", "expected").collect()
    assert [r.intent for r in out] == [r.expected for r in out]


def test_entities(spark):
    df = spark.createDataFrame([("look at TCK-00042 and FDB-00007 for cust-0001",),
                                ("enterprise segment, business plan",)], "text string")
    rows = intents.extract_segment_plan(intents.extract_ids(df)).collect()
    assert rows[0].ticket_ids == ["TCK-00042"] and rows[0].feedback_ids == ["FDB-00007"]
    assert rows[0].customer_ids == ["CUST-0001"]
    assert (rows[1].segment, rows[1].plan) == ("enterprise", "business")


def test_requested_metric(spark):
    df = spark.createDataFrame([("How many tickets by category?",)], "text string")
    r = intents.requested_metric(intents.route_intent(intents.classify(df))).first()
    assert (r.intent, r.req_metric, r.req_of, r.req_dimensions) == ("analytics_exec", "count", "ticket",
                                                                     ["category"])
