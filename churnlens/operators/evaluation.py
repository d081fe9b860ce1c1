"""Trace, answer and golden tables derived from the conversation log, and the
evaluation metrics over them (J1-J16).

Derivation (all Spark jobs over ``conversations``):
* a *question* is a user turn, classified by operators/intents (H1-H7);
* its *trace* holds the spans the serving path records: classify (intent,
  entities), route (routed node), ``node:<node>`` (tools of that node) and
  reason (token counts);
* its *answer* is the next assistant (or system) turn of the same
  conversation, shaped as the structured answer (summary, sections with
  citations, confidence, render hint);
* its *golden* row expects every turn of a conversation to route like the
  conversation's opening question.
Metrics are Column expressions over the joined row; the summary is a global
aggregate. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions import lexicons as L
from churnlens.operators import intents

# Render kinds offered by the answer builder, by turn number
ANSWER_KINDS = ["table", "chart", "qa", "cards", "markdown", "graph"]
GOLDEN_SCHEMA = ("conv_id bigint, turn bigint, expected_intent string, expected_route string, "
                 "expected_entities map<string,array<string>>, expected_tools array<string>, "
                 "expected_retrieval array<string>, expected_render string, expects_recommendations boolean, "
                 "expects_prioritization boolean, irrelevant boolean, no_data boolean")
SECTION_T = "array<struct<heading:string,content:string,citations:array<string>>>"


def node_tools() -> Column:
    """Tools of the routed node: one map lookup (the node is referenced once)."""
    tools = F.create_map(*[x for node, ts in L.NODE_TOOLS
                           for x in (F.lit(node), F.array(*[F.lit(t) for t in ts]))])
    return F.coalesce(tools[F.col("routed_node")], F.array().cast("array<string>"))


def questions(conversations: DataFrame) -> DataFrame:
    """Classified and routed user turns."""
    return intents.route_intent(intents.classify(intents.question_log(conversations)))


# price of a token by kind, as the stand-in traces report it
PRICES = {"input": 3e-6, "cache_read": 3e-7, "cache_write": 4e-6, "output": 1.5e-5}


def traces(q: DataFrame, further: list[Column] | None = None) -> DataFrame:
    """One trace per question: spans array with typed metadata. The reasoning span reports its tokens (a word
    is one, and a later question finds half of its words cached), cost, requests and tool calls."""
    ents = F.struct(F.col("customer_ids"), F.col("ticket_ids"), F.col("feedback_ids"),
                    F.col("segment"), F.col("plan"))
    n_words = F.size(F.split(F.trim(F.col("text")), r"\s+"))
    cached = F.when(F.col("turn") > 0, F.floor(n_words / 2)).otherwise(0).cast("bigint")
    fresh = n_words.cast("bigint") - cached
    cost = cached * F.lit(PRICES["cache_read"]) + fresh * F.lit(PRICES["input"] + PRICES["cache_write"])

    def span(name, kind, started, latency, intent=None, node=None, tools=None, entities=None,
             used_llm=None, tin=None, tout=None, usage=None):
        usage = usage or {}

        def given(field, kind):
            return (usage[field] if field in usage else F.lit(None)).cast(kind).alias(field)
        null_ents = F.lit(None).cast("struct<customer_ids:array<string>,ticket_ids:array<string>,"
                                     "feedback_ids:array<string>,segment:string,plan:string>")
        meta = F.struct(
            (intent if intent is not None else F.lit(None).cast("string")).alias("intent"),
            (node if node is not None else F.lit(None).cast("string")).alias("routed_node"),
            (tools if tools is not None else F.lit(None).cast("array<string>")).alias("tools"),
            (entities if entities is not None else null_ents).alias("entities"),
            (used_llm if used_llm is not None else F.lit(None).cast("boolean")).alias("used_llm"),
            (tin if tin is not None else F.lit(None).cast("bigint")).alias("input_tokens"),
            (tout if tout is not None else F.lit(None).cast("bigint")).alias("output_tokens"),
            given("cache_read_tokens", "bigint"), given("cache_write_tokens", "bigint"), given("cost", "double"),
            given("requests", "bigint"), given("tool_calls", "bigint"))
        label = name if isinstance(name, Column) else F.lit(name)
        start, end = started.cast("double"), started.cast("double") + latency.cast("double") / 1000
        return F.struct(label.alias("name"), F.lit(kind).alias("kind"), F.lit("ok").alias("status"),
                        start.alias("started_at"), end.alias("ended_at"),
                        F.round((end - start) * 1000, 2).alias("latency_ms"), meta.alias("metadata"))

    t0 = F.col("turn").cast("double")
    spans = F.array(
        span("classify", "node", t0, F.length("text") / 100.0, intent=F.col("intent"), entities=ents),
        span("route", "node", t0 + 0.1, F.lit(0.05), intent=F.col("intent"), node=F.col("routed_node")),
        # node span name is data-dependent: node:<routed_node>
        span(F.concat(F.lit("node:"), F.col("routed_node")), "node", t0 + 0.2, F.size(node_tools()) * 1.5,
             node=F.col("routed_node"), tools=node_tools()),
        span("reason", "llm", t0 + 0.3, n_words * 0.25, used_llm=F.lit(False), tin=n_words.cast("bigint"),
             tout=F.lit(0).cast("bigint"),
             usage={"cache_read_tokens": cached, "cache_write_tokens": fresh, "cost": cost, "requests": F.lit(1),
                    "tool_calls": F.size(node_tools())}),
    )
    return q.select("conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
                    .alias("trace_id"), F.col("text").alias("question"), spans.alias("spans"), *(further or []))


def answers(conversations: DataFrame) -> DataFrame:
    """Assistant and system turns shaped as answers to the preceding turn.
    System turns carry no facts and no confidence, so they fail the schema."""
    c = conversations.filter(F.col("role").isin("assistant", "system"))
    text = F.col("text")
    assistant = F.col("role") == "assistant"
    lines = F.split(text, "\n")
    facts = F.when(assistant, F.array(F.struct(
        F.lit("Facts").alias("heading"), text.alias("content"),
        F.regexp_extract_all(text, F.lit(L.RECORD_ID_PATTERN), 0).alias("citations"))))
    rec = F.when(F.size(lines) > 2, F.array(F.struct(
        F.lit("Recommendation").alias("heading"), F.element_at(lines, -1).alias("content"),
        F.array().cast("array<string>").alias("citations")))).otherwise(F.array().cast(SECTION_T))
    conf = F.when(assistant, F.when(F.length(text) > 400, "high").when(F.length(text) > 150, "medium")
                  .otherwise("low"))
    kinds = F.array(*[F.lit(k) for k in ANSWER_KINDS])
    hint = F.struct(F.element_at(kinds, (F.col("turn") % len(ANSWER_KINDS) + 1).cast("int")).alias("kind"),
                    F.struct(F.lit(None).cast("string").alias("kind")).alias("payload"))
    ans = F.struct(text.alias("summary"), conf.alias("confidence"), facts.alias("facts"),
                   F.array().cast(SECTION_T).alias("interpretation"), rec.alias("recommendation"),
                   F.array().cast(SECTION_T).alias("other_sections"), hint.alias("render_hint"))
    return c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("answer_turn"),
                    F.to_json(ans).alias("answer_json"))


def golden_columns() -> list[Column]:
    """Expected values per question: route like the conversation's first question, held in ``f``."""
    tools = None
    for node, ts in L.NODE_TOOLS:
        arr = F.array(*[F.lit(t) for t in ts[:2]])
        cond = F.col("f.routed_node") == node
        tools = F.when(cond, arr) if tools is None else tools.when(cond, arr)
    return [
        F.col("f.intent").alias("expected_intent"), F.col("f.routed_node").alias("expected_route"),
        F.when(F.col("f.segment").isNotNull(), F.create_map(F.lit("segment"), F.array("f.segment")))
        .otherwise(F.create_map().cast("map<string,array<string>>")).alias("expected_entities"),
        tools.otherwise(F.array().cast("array<string>")).alias("expected_tools"),
        F.when(F.col("f.routed_node") == "rag", F.array(F.lit("feedback"))).otherwise(
            F.array().cast("array<string>")).alias("expected_retrieval"),
        F.lit("markdown").alias("expected_render"),
        F.lit(False).alias("expects_recommendations"), F.lit(False).alias("expects_prioritization"),
        (F.col("f.intent") == "irrelevant").alias("irrelevant"), F.lit(False).alias("no_data")]


def eval_frame(conversations: DataFrame, q: DataFrame | None = None, ans: DataFrame | None = None) -> DataFrame:
    """Golden values, trace and answer per question (answer may be missing). The first question of
    a conversation comes by a window over it, so the questions are read once; only answers are joined.
    ``q`` / ``ans`` are the question log and answers when already materialised."""
    from churnlens.operators.guards import parse_answer
    q = questions(conversations) if q is None else q
    ans = answers(conversations) if ans is None else ans
    opening = F.first(F.struct("intent", "routed_node", "segment")).over(Window.partitionBy("conv_id").orderBy("turn"))
    t = traces(q.withColumn("f", opening), golden_columns())
    a = ans.select("conv_id", "turn", parse_answer(F.col("answer_json")).alias("answer"))
    return t.join(a, ["conv_id", "turn"], "left")


def _span(name: str) -> Column:
    return F.get(F.filter("spans", lambda s: s["name"] == name), 0)


def _metric(passed: Column, score: Column | None = None, detail: Column | None = None) -> Column:
    p = F.coalesce(passed, F.lit(False))
    return F.struct(p.alias("passed"),
                    (score if score is not None else F.when(p, 1.0).otherwise(0.0)).cast("double").alias("score"),
                    (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def _versus(expected: Column, actual: Column) -> Column:
    return F.concat(F.lit("expected "), expected, F.lit(", got "), F.coalesce(actual, F.lit("none")))


def _named(label: str, items: Column) -> Column:
    """``label`` and the items, or null if there are none."""
    return F.when(F.size(items) > 0, F.concat(F.lit(label + " "), F.array_join(items, "|")))


def metrics(df: DataFrame) -> DataFrame:
    """J1-J11 per question as struct columns; J12 the per-question verdict."""
    a = F.col("answer")
    route = _span("route")["metadata"]["routed_node"]
    intent = _span("classify")["metadata"]["intent"]
    ents = _span("classify")["metadata"]["entities"]
    # Every expected key's set must be contained in the actual one
    exp_keys = F.map_keys("expected_entities")

    def actual_for(k):
        return (F.when(k == "customer_ids", ents["customer_ids"]).when(k == "ticket_ids", ents["ticket_ids"])
                .when(k == "feedback_ids", ents["feedback_ids"])
                .when(k == "segment", F.when(ents["segment"].isNotNull(), F.array(ents["segment"])))
                .when(k == "plan", F.when(ents["plan"].isNotNull(), F.array(ents["plan"]))))

    found = F.filter(exp_keys, lambda k: (F.size(F.col("expected_entities")[k]) > 0) & (F.size(F.array_except(
        F.col("expected_entities")[k], F.coalesce(actual_for(k), F.array().cast("array<string>")))) == 0))
    n_exp = F.size(exp_keys)
    not_found = F.array_sort(F.array_except(exp_keys, found))
    called = F.array_distinct(F.flatten(F.transform(
        F.filter("spans", lambda s: s["name"].startswith("node:")),
        lambda s: F.coalesce(s["metadata"]["tools"], F.array().cast("array<string>")))))
    missing_tools = F.filter("expected_tools", lambda t: ~F.array_contains(called, t))
    n_tools = F.size("expected_tools")
    blob = F.lower(F.concat_ws(" ", F.coalesce(a["summary"], F.lit("")),
                               F.array_join(F.transform(F.coalesce(a["facts"], F.array()),
                                                        lambda s: F.coalesce(s["content"], F.lit(""))), " ")))
    found_ret = F.filter("expected_retrieval", lambda r: blob.contains(F.lower(r)))
    n_ret = F.size("expected_retrieval")
    facts = F.coalesce(a["facts"], F.array())
    uncited = F.filter(facts, lambda s: (F.coalesce(F.size(s["citations"]), F.lit(0)) <= 0)
                       & ~F.coalesce(s["content"], F.lit("")).rlike(L.RECORD_ID_PATTERN))
    missing_ret = F.filter("expected_retrieval", lambda r: ~blob.contains(F.lower(r)))
    kind = F.coalesce(a["render_hint"]["payload"]["kind"], a["render_hint"]["kind"], F.lit("markdown"))
    others = F.coalesce(a["other_sections"], F.array())
    has_prio = F.exists(others, lambda s: F.lower(F.coalesce(s["heading"], F.lit(""))).contains("priorit")
                        | F.lower(F.coalesce(s["content"], F.lit(""))).contains("priorit"))
    conf = a["confidence"]
    hint_kind = F.coalesce(a["render_hint"]["kind"], F.lit("markdown"))
    m = {
        "routing": _metric(route == F.col("expected_route"), None, _versus(F.col("expected_route"), route)),
        "intent": _metric(intent == F.col("expected_intent"), None, _versus(F.col("expected_intent"), intent)),
        "entities": _metric(F.size(found) == n_exp, F.size(found) / F.greatest(n_exp, F.lit(1)),
                            _named("missing", not_found)),
        "tools": _metric(F.size(missing_tools) == 0,
                         (n_tools - F.size(missing_tools)) / F.greatest(n_tools, F.lit(1)), _named("missing", missing_tools)),
        "retrieval": _metric(F.size(found_ret) == n_ret,
                             F.when(n_ret == 0, 1.0).otherwise(F.size(found_ret) / n_ret), _named("missing", missing_ret)),
        "citations": _metric(F.col("irrelevant") | ((F.size(facts) > 0) & (F.size(uncited) == 0)), None,
                             _named("uncited", F.transform(uncited, lambda s: s["heading"]))),
        "render": _metric(kind == F.col("expected_render"), None, _versus(F.col("expected_render"), kind)),
        "recommendations": _metric(~F.col("expects_recommendations")
                                   | (F.size(F.coalesce(a["recommendation"], F.array())) > 0)),
        "prioritization": _metric(~F.col("expects_prioritization") | has_prio),
        "irrelevant": _metric(~F.col("irrelevant") | ((conf == "low") & (hint_kind == "markdown"))),
        "confidence": _metric(F.when(F.col("no_data"), conf == "low").otherwise(conf.isin("high", "medium")), None,
                              _versus(F.when(F.col("no_data"), "low").otherwise("high or medium"), conf)),
    }
    passed_n = sum((F.col(k)["passed"].cast("int") for k in m), F.lit(0))
    return (df.select("conv_id", "turn", "trace_id", *[v.alias(k) for k, v in m.items()])
              .withColumn("passed_metrics", passed_n)
              .withColumn("total_metrics", F.lit(len(m)))
              .withColumn("passed", F.col("passed_metrics") == len(m)))


METRIC_NAMES = ["routing", "intent", "entities", "tools", "retrieval", "citations", "render", "recommendations",
                "prioritization", "irrelevant", "confidence"]


def read_golden(spark, path: str) -> DataFrame:
    """Golden rows of a JSON-lines file: expected values per question, entities as lists per kind."""
    return spark.read.schema(GOLDEN_SCHEMA).option("mode", "FAILFAST").json(path)


def golden_frame(golden: DataFrame, q: DataFrame, ans: DataFrame) -> DataFrame:
    """Golden values with the trace and the answer of their question; questions without golden values are left out."""
    from churnlens.operators.guards import parse_answer
    a = ans.select("conv_id", "turn", parse_answer(F.col("answer_json")).alias("answer"))
    return traces(q).join(golden, ["conv_id", "turn"]).join(a, ["conv_id", "turn"], "left")


def metrics_by_name(per_question: DataFrame) -> DataFrame:
    """The per-question rows with the metrics as one map: name -> (passed, score, detail)."""
    pairs = [x for k in METRIC_NAMES for x in (F.lit(k), F.col(k))]
    return per_question.select("conv_id", "turn", "passed_metrics", "total_metrics", "passed", F.create_map(*pairs).alias("metrics"))


def long_metrics(by_name: DataFrame) -> DataFrame:
    """One row per question and metric."""
    # every question has metrics; the outer form infers no filter on them, which would work them out twice
    each = by_name.select("conv_id", "turn", F.explode_outer("metrics").alias("metric", "m"))
    return each.select("conv_id", "turn", "metric", "m.passed", "m.score", "m.detail")


def summary(per_question: DataFrame) -> DataFrame:
    """Questions, passed, failed, pass rate, metric rate (3 decimals)."""
    n = F.count(F.lit(1))
    ok = F.count_if("passed")
    mok = F.sum("passed_metrics")
    mtot = F.sum("total_metrics")
    return per_question.agg(
        n.alias("questions"), ok.alias("passed"), (n - ok).alias("failed"),
        F.when(n > 0, F.round(ok / n, 3)).otherwise(0.0).alias("pass_rate"),
        mok.cast("bigint").alias("metric_ok"), mtot.cast("bigint").alias("metric_total"),
        F.when(mtot > 0, F.round(mok / mtot, 3)).otherwise(0.0).alias("metric_rate"))


def trace_latency(t: DataFrame) -> DataFrame:
    """Total latency (ms, 2 decimals) and span count per trace."""
    return t.select("trace_id",
                    F.round(F.aggregate("spans", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["latency_ms"],
                                                                                          F.lit(0.0))), 2)
                    .alias("total_latency_ms"),
                    F.size("spans").alias("span_count"))


def trace_token_usage(t: DataFrame) -> DataFrame:
    """Tokens by kind, cost, requests and tool calls over the reasoning spans, per trace."""
    reason = F.filter("spans", lambda s: s["name"] == "reason")

    def total(field, kind="bigint"):
        return F.aggregate(reason, F.lit(0).cast(kind),
                           lambda acc, s: acc + F.coalesce(s["metadata"][field], F.lit(0).cast(kind))).alias(field)

    # one trace per row: a row-local fold, no shuffle
    return t.select("trace_id", *[total(f) for f in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
                                                     "requests", "tool_calls")], total("cost", "double"))


def tool_calls(q: DataFrame) -> DataFrame:
    """The calls each question's node makes, with arguments from its entities."""
    # the outer form infers no filter on the tools, which would classify the questions twice
    calls = q.select("conv_id", "turn", F.posexplode_outer(node_tools()).alias("call_order", "tool"),
                     "customer_ids", "segment", "plan").where("tool is not null")
    args = F.map_filter(F.map_from_arrays(
        F.array(F.lit("customer_id"), F.lit("segment"), F.lit("plan")),
        F.array(F.get("customer_ids", 0), F.col("segment"), F.col("plan"))), lambda k, v: v.isNotNull())
    return calls.select("conv_id", "turn", F.col("call_order").cast("bigint").alias("call_order"), "tool",
                        args.alias("args"))
