"""Evaluation and tool-call oracles (J1-J16, G11) as DuckDB SQL."""

from __future__ import annotations

from churnlens.functions import lexicons as L
from churnlens.operators.evaluation import PRICES
from churnlens.plans.oracle_calls import call_sqls
from churnlens.plans.oracle_sql import _lit_list, answers_sql, intents_sql
from churnlens.sources import logs

METRIC_COLS = ["routing", "intent_ok", "entities", "tools", "retrieval", "citations", "render", "recommendations",
               "prioritization", "irrelevant_ok", "confidence_ok"]


def _tools_map() -> str:
    return "MAP {" + ", ".join(f"'{node}': {_lit_list(ts)}" for node, ts in L.NODE_TOOLS) + "}"


def _head(with_answers: bool) -> str:
    parts = [intents_sql().strip()]
    if with_answers:
        parts.append(answers_sql().strip())
    return "WITH " + ",\n".join(parts) + "\n"


def _calls() -> str:
    tm = _tools_map()
    keys = ("list_filter([CASE WHEN len(customer_ids) > 0 THEN 'customer_id' END, "
            "CASE WHEN segment is not null THEN 'segment' END, CASE WHEN plan is not null THEN 'plan' END], "
            "lambda x: x is not null)")
    own = ("map {'customer_id': customer_ids[1], 'segment': segment, 'plan': plan}")
    return (f"select conv_id, turn, call_order, tool, map_keys(args) as keys, args from ({logs.calls_sql()}) c union all "
            f"select conv_id, turn, unnest(range(len(coalesce({tm}[routed_node], [])))) as call_order, "
            f"unnest(coalesce({tm}[routed_node], [])) as tool, {keys} as keys, {own} as args from h3")


def eval_sqls(risk_sql: str) -> dict[str, str]:
    tm = _tools_map()
    blob = ("lower(coalesce(summary, '') || ' ' || array_to_string(list_transform(coalesce(facts, []), "
            "lambda s: coalesce(s.content, '')), ' '))")
    found_ret = f"len(list_filter(e_ret, lambda r: contains({blob}, lower(r))))"
    missing = "len(list_filter(e_tools, lambda t: not list_contains(called, t)))"
    uncited = (f"len(list_filter(coalesce(facts, []), lambda s: not (len(s.citations) > 0 or "
               f"regexp_matches(coalesce(s.content, ''), '{L.RECORD_ID_PATTERN}'))))")
    base = _head(True).rstrip() + f""",
first AS (select conv_id, arg_min({{'i': intent, 'r': routed_node, 's': segment}}, turn) as f from h3 group by conv_id),
e AS (select q.conv_id, q.turn, q.intent, q.routed_node, q.segment, f.f.i as e_intent, f.f.r as e_route,
  f.f.s as e_segment, coalesce({tm}[f.f.r], []::varchar[])[1:2] as e_tools,
  CASE WHEN f.f.r = 'rag' THEN ['feedback'] ELSE []::varchar[] END as e_ret, f.f.i = 'irrelevant' as irrelevant,
  coalesce({tm}[q.routed_node], []::varchar[]) as called, a.summary, a.facts, a.confidence, a.kind, a.payload
 from h3 q join first f using (conv_id) left join ans a on a.conv_id = q.conv_id and a.turn = q.turn),
m AS (select conv_id, turn,
  coalesce(routed_node = e_route, false) as routing,
  coalesce(intent = e_intent, false) as intent_ok,
  coalesce(e_segment is null or segment = e_segment, false) as entities,
  CASE WHEN e_segment is not null and segment = e_segment THEN 1.0 ELSE 0.0 END as entities_score,
  {missing} = 0 as tools,
  (len(e_tools) - {missing}) / greatest(len(e_tools), 1) as tools_score,
  {found_ret} = len(e_ret) as retrieval,
  CASE WHEN len(e_ret) = 0 THEN 1.0 ELSE {found_ret} / len(e_ret) END as retrieval_score,
  irrelevant or (len(coalesce(facts, [])) > 0 and {uncited} = 0) as citations,
  coalesce(payload, kind, 'markdown') = 'markdown' as render,
  true as recommendations, true as prioritization,
  not irrelevant or coalesce(confidence = 'low' and coalesce(kind, 'markdown') = 'markdown', false) as irrelevant_ok,
  coalesce(confidence in ('high', 'medium'), false) as confidence_ok
 from e)
"""
    flags = {"eval_routing": "routing", "eval_intent": "intent_ok", "eval_citations": "citations",
             "eval_render": "render", "eval_recommendations": "recommendations",
             "eval_prioritization": "prioritization", "eval_irrelevant": "irrelevant_ok",
             "eval_confidence": "confidence_ok"}
    out = {k: base + f"select conv_id, turn, {c} as passed, CASE WHEN {c} THEN 1.0 ELSE 0.0 END as score from m"
           for k, c in flags.items()}
    for k, c in (("eval_entities", "entities"), ("eval_tools", "tools"), ("eval_retrieval", "retrieval")):
        out[k] = base + f"select conv_id, turn, {c} as passed, cast({c}_score as double) as score from m"
    n_ok = " + ".join(f"cast({c} as integer)" for c in METRIC_COLS)
    pq = f"select conv_id, turn, {n_ok} as passed_metrics, 11 as total_metrics, ({n_ok}) = 11 as passed from m"
    out["eval_question"] = base + pq
    out["eval_summary"] = base + (
        "select count(*) as questions, count(*) filter (where passed) as passed, "
        "count(*) filter (where not passed) as failed, "
        "CASE WHEN count(*) > 0 THEN round(count(*) filter (where passed) / count(*), 3) ELSE 0.0 END as pass_rate, "
        "cast(sum(passed_metrics) as bigint) as metric_ok, cast(sum(total_metrics) as bigint) as metric_total, "
        "CASE WHEN sum(total_metrics) > 0 THEN round(sum(passed_metrics) / sum(total_metrics), 3) ELSE 0.0 END "
        f"as metric_rate from ({pq}) p")
    out |= golden_sqls()
    words = "len(string_split_regex(trim(text), '\\s+'))"
    cached = f"(CASE WHEN turn > 0 THEN {words} // 2 ELSE 0 END)"
    head = _head(False)
    out["trace_latency"] = head + (
        "select cast(conv_id as varchar) || '-' || cast(turn as varchar) as trace_id, "
        f"round(length(text) / 100.0 + 0.05 + len(coalesce({tm}[routed_node], [])) * 1.5 + {words} * 0.25, 2) "
        "as total_latency_ms, 4 as span_count from h3")
    out["trace_token_usage"] = head + (
        f"select cast(conv_id as varchar) || '-' || cast(turn as varchar) as trace_id, "
        f"cast({words} as bigint) as input_tokens, cast(0 as bigint) as output_tokens, cast(1 as bigint) as requests, "
        f"cast({cached} as bigint) as cache_read_tokens, cast({words} - {cached} as bigint) as cache_write_tokens, "
        f"cast(len(coalesce({tm}[routed_node], [])) as bigint) as tool_calls, "
        f"{cached} * {PRICES['cache_read']!r}::double + ({words} - {cached}) * {PRICES['input'] + PRICES['cache_write']!r}::double "
        "as cost from h3")
    out |= call_sqls(head, _calls(), risk_sql)
    out["guard_tool_calls"] = head + tool_calls_body()
    return out


def golden_sqls() -> dict[str, str]:
    """The metrics of the golden rows, one row per question and metric, and their summary."""
    tm = _tools_map()
    blob = ("lower(coalesce(summary, '') || ' ' || array_to_string(list_transform(coalesce(facts, []), "
            "lambda s: coalesce(s.content, '')), ' '))")
    actual = ("CASE x.k WHEN 'customer_ids' THEN customer_ids WHEN 'ticket_ids' THEN ticket_ids WHEN 'feedback_ids' THEN "
              "feedback_ids WHEN 'segment' THEN CASE WHEN segment is null THEN []::varchar[] ELSE [segment] END "
              "WHEN 'plan' THEN CASE WHEN plan is null THEN []::varchar[] ELSE [plan] END ELSE []::varchar[] END")
    lost = (f"list_sort(list_transform(list_filter(expected_entities, lambda x: len(x.v) = 0 or "
            f"not list_has_all({actual}, x.v)), lambda x: x.k))")
    no_tool = "list_filter(expected_tools, lambda t: not list_contains(called, t))"
    no_ret = f"list_filter(expected_retrieval, lambda r: not contains({blob}, lower(r)))"
    uncited = (f"list_transform(list_filter(coalesce(facts, []), lambda s: not (len(s.citations) > 0 or "
               f"regexp_matches(coalesce(s.content, ''), '{L.RECORD_ID_PATTERN}'))), lambda s: s.heading)")
    prio = ("len(list_filter(coalesce(other_sections, []), lambda s: contains(lower(coalesce(s.heading, '')), 'priorit') "
            "or contains(lower(coalesce(s.content, '')), 'priorit'))) > 0")

    def versus(expected: str, got: str) -> str:
        return f"'expected ' || {expected} || ', got ' || coalesce({got}, 'none')"

    def named(label: str, items: str) -> str:
        return f"CASE WHEN len({items}) > 0 THEN '{label} ' || array_to_string({items}, '|') END"

    def share(lacking: str, of: str) -> str:
        return f"(len({of}) - len({lacking})) / greatest(len({of}), 1)"
    shown = "coalesce(payload, kind, 'markdown')"
    wanted_conf = "CASE WHEN no_data THEN 'low' ELSE 'high or medium' END"
    m = {
        "routing": ("routed_node = expected_route", None, versus("expected_route", "routed_node")),
        "intent": ("intent = expected_intent", None, versus("expected_intent", "intent")),
        "entities": (f"len({lost}) = 0", share(lost, "expected_entities"), named("missing", lost)),
        "tools": (f"len({no_tool}) = 0", share(no_tool, "expected_tools"), named("missing", no_tool)),
        "retrieval": (f"len({no_ret}) = 0", f"CASE WHEN len(expected_retrieval) = 0 THEN 1.0 ELSE {share(no_ret, 'expected_retrieval')} END",
                      named("missing", no_ret)),
        "citations": (f"irrelevant or (len(coalesce(facts, [])) > 0 and len({uncited}) = 0)", None, named("uncited", uncited)),
        "render": (f"{shown} = expected_render", None, versus("expected_render", shown)),
        "recommendations": ("not expects_recommendations or len(coalesce(recommendation, [])) > 0", None, "null"),
        "prioritization": (f"not expects_prioritization or {prio}", None, "null"),
        "irrelevant": ("not irrelevant or (confidence = 'low' and coalesce(kind, 'markdown') = 'markdown')", None, "null"),
        "confidence": ("CASE WHEN no_data THEN confidence = 'low' ELSE confidence in ('high', 'medium') END", None,
                       versus(wanted_conf, "confidence")),
    }
    parts = [f"select conv_id, turn, '{name}' as metric, coalesce({ok}, false) as passed, "
             f"cast({score or f'CASE WHEN coalesce({ok}, false) THEN 1.0 ELSE 0.0 END'} as double) as score, "
             f"cast({detail} as varchar) as detail from e" for name, (ok, score, detail) in m.items()]
    head = _head(True).rstrip() + f""",
e AS (select g.*, q.intent, q.routed_node, q.customer_ids, q.ticket_ids, q.feedback_ids, q.segment, q.plan,
  coalesce({tm}[q.routed_node], []::varchar[]) as called, a.summary, a.facts, a.recommendation, a.other_sections,
  a.confidence, a.kind, a.payload
 from ({logs.golden_sql()}) g join h3 q on q.conv_id = g.conv_id and q.turn = g.turn
  left join ans a on a.conv_id = g.conv_id and a.turn = g.turn),
m AS ({" union all ".join(parts)})
"""
    per_question = "select count(*) filter (where passed) as ok, count(*) as n from m group by conv_id, turn"
    return {"golden_metrics": head + "select * from m",
            "sink_report_questions": head + "select * from m",
            "golden_summary": head + (
                "select count(*) as questions, count(*) filter (where ok = n) as passed, count(*) filter (where ok < n) as failed, "
                "round(count(*) filter (where ok = n) / count(*), 3) as pass_rate, cast(sum(ok) as bigint) as metric_ok, "
                "cast(sum(n) as bigint) as metric_total, round(sum(ok) / sum(n), 3) as metric_rate "
                f"from ({per_question}) p")}


def tool_calls_body() -> str:
    allowed = "MAP {" + ", ".join(f"'{t}': {_lit_list(a) if a else '[]::varchar[]'}"
                                  for t, a in L.TOOL_REGISTRY) + "}"
    keys = "keys"
    unknown = f"list_sort(list_filter({keys}, lambda k: not list_contains(coalesce({allowed}[tool], []::varchar[]), k)))"
    known = f"({allowed}[tool] is not null)"
    q1 = "'''"
    return f"""select conv_id, turn, call_order, tool, 0 as check_order,
 {known} as passed, CASE WHEN {known} THEN 'pass' ELSE 'block' END as severity, 'allowed_tools' as rule,
 CASE WHEN {known} THEN 'Tool {q1} || tool || {q1} is registered.' ELSE 'Tool {q1} || tool || {q1} is not in the registry.' END as message,
 cast(null as varchar) as detail from ({_calls()}) c
union all select conv_id, turn, call_order, tool, 1, {known} and len({unknown}) = 0,
 CASE WHEN {known} and len({unknown}) = 0 THEN 'pass' ELSE 'block' END, 'tool_arguments',
 CASE WHEN {known} and len({unknown}) = 0 THEN 'Args for {q1} || tool || {q1} are valid.'
  WHEN {known} THEN 'Invalid arguments for tool {q1} || tool || {q1}.'
  ELSE 'Tool {q1} || tool || {q1} is not in the registry.' END,
 CASE WHEN {known} and len({unknown}) > 0 THEN 'extra_forbidden=' || array_to_string({unknown}, '|') END
 from ({_calls()}) c"""
