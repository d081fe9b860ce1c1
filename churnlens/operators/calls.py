"""Tool calls answered as a batch (J16, and the tool contract of E1-E17): rows, source refs and warnings.

Calls with the same tool and arguments are one request, answered once. The requests of a tool meet the tool's rows
in one join under each request's own parameters, and a window ranks the rows within their request. Parameters that
may be missing are matched by equality too: customers stand under their segment and under ``ANY``, so a request
without a segment finds all of them and no pair is formed that a request doesn't ask for.

A request that finds nothing is kept by the outer joins and has the warnings its tool gives. The rows of a
request are bounded by its limit where the tool has one (``MOST_ROWS`` at most); the others are counted
without being gathered, and only the sample is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.rules import risk_score
from churnlens.operators import insights

SAMPLE = 5
#: a limit above this counts as this
MOST_ROWS = 1000
ANY = "*"
# Warnings that users of the tools know
NOT_FOUND = "Customer %s not found."
NO_REVENUE = "monthly_revenue is NULL (unknown); revenue-at-risk excludes it."
EMPTY_NAME = "Empty customer name."
NO_MATCH = "No customer found matching '%s'."
RISK_NOTE = "Composite heuristic risk score (0-100); not a model. Canceled customers excluded (already lost)."
THEME_NOTE = "Themes are rule-based (source='rule'); LLM overlay may upgrade them."
NOTES = {"rank_customer_risk": RISK_NOTE, "get_feedback_themes": THEME_NOTE}
DEFAULT_LIMIT = {"get_customer_tickets": 20, "get_customer_feedback": 20, "get_subscription_events": 10,
                 "list_customers": 50, "rank_customer_risk": 10, "resolve_customer_name": 10}


def request_key(args: Column) -> Column:
    """The arguments as one text, whatever their order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args))))


def requests(calls: DataFrame) -> DataFrame:
    """tool, request, args: each distinct request once."""
    return calls.select("tool", request_key(F.col("args")).alias("request"), "args").dropDuplicates(["tool", "request"])


def _of(reqs: DataFrame, tool: str, *params: str) -> DataFrame:
    """request, the parameters (``p_`` names, null if missing or blank) and ``n``, the limit."""
    default = DEFAULT_LIMIT.get(tool)
    given = F.coalesce(F.col("args")["limit"].cast("int"), F.lit(default))
    return reqs.where(F.col("tool") == tool).select(
        "request", *[F.nullif(F.trim(F.col("args")[p]), F.lit("")).alias(f"p_{p}") for p in params],
        (F.least(given, F.lit(MOST_ROWS)) if default else F.lit(None).cast("int")).alias("n"))


def _line(*cols: str | Column) -> Column:
    return F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")) for c in cols]).alias("line")


def _ranked(rows: DataFrame, order: list[Column], limited: bool) -> DataFrame:
    """request, pos, line, ref; with a limit only the rows within it."""
    pos = F.row_number().over(Window.partitionBy("request").orderBy(*order))
    out = rows.withColumn("pos", pos)
    if limited:  # the fixed bound lets each task drop rows before the exchange
        out = out.where((F.col("pos") <= MOST_ROWS) & (F.col("pos") <= F.col("n")))
    return out.select("request", "pos", "line", "ref")


def _matches(param: str, value: Column) -> Column:
    return F.col(param).isNull() | (F.lower(param) == value)


def _tickets(m, reqs):
    r = _of(reqs, "get_customer_tickets", "customer_id", "category", "priority", "status")
    rows = r.join(m.fact_ticket, F.col("p_customer_id") == F.col("customer_id"))
    for c in ("category", "priority", "status"):
        rows = rows.where(_matches(f"p_{c}", F.col(c)))
    rows = rows.select("request", "n", "created_at", "ticket_id", _line("ticket_id", "category", "priority", "status"),
                       F.col("ticket_id").alias("ref"))
    return _ranked(rows, [F.desc("created_at"), F.asc("ticket_id")], True)


def _feedback(m, reqs):
    r = _of(reqs, "get_customer_feedback", "customer_id")
    rows = r.join(m.fact_feedback.select("customer_id", "feedback_id", "created_at", "feedback_source"),
                  F.col("p_customer_id") == F.col("customer_id"))
    rows = rows.select("request", "n", "created_at", "feedback_id", _line("feedback_id", "feedback_source"),
                       F.col("feedback_id").alias("ref"))
    return _ranked(rows, [F.desc("created_at"), F.asc("feedback_id")], True)


def _events(m, reqs):
    r = _of(reqs, "get_subscription_events", "customer_id")
    rows = r.join(m.fact_subscription_event, F.col("p_customer_id") == F.col("customer_id"))
    rows = rows.select("request", "n", "event_date", "_input_row_number", "event_type", "revenue_change",
                       _line("event_date", "event_type", "previous_plan", "new_plan"),
                       F.concat_ws(":", "customer_id", F.col("event_date").cast("string"), "event_type").alias("ref"))
    return _ranked(rows, [F.desc("event_date"), F.desc("_input_row_number"), F.asc("event_type"), F.desc("revenue_change")], True)


def _trend(m, reqs):
    r = _of(reqs, "get_usage_trend", "customer_id", "weeks")
    end = m.fact_usage.select(F.max("date")).scalar()
    rows = r.join(m.fact_usage, F.col("p_customer_id") == F.col("customer_id")).where(
        F.col("date") >= F.date_sub(end, 7 * (F.coalesce(F.col("p_weeks").cast("int"), F.lit(8)) - 1)))
    rows = rows.select("request", "date", _line("date", "active_users", "sessions", "errors"),
                       F.concat_ws(":", "customer_id", F.col("date").cast("string")).alias("ref"))
    return _ranked(rows, [F.asc("date")], False)


def _profile(m, reqs):
    r = _of(reqs, "get_customer_profile", "customer_id")
    rows = r.join(m.dimension_customer, F.col("p_customer_id") == F.col("customer_id")).select(
        "request", "customer_id", _line("customer_id", "customer_name", "customer_segment", "subscription_plan", "account_status"),
        F.col("customer_id").alias("ref"))
    return _ranked(rows, [F.asc("customer_id")], False)


def _under_any(rows: DataFrame, **keys: Column) -> DataFrame:
    """Each row under its own value of the keys and under ANY, so that requests without one find it by equality."""
    for name, value in keys.items():
        rows = rows.withColumn(name, F.explode(F.array_distinct(F.array(F.coalesce(value, F.lit("")), F.lit(ANY)))))
    return rows


def _wanted(param: str) -> Column:
    return F.coalesce(F.lower(F.col(param)), F.lit(ANY))


def _usage_change(m, reqs):
    r = _of(reqs, "get_usage_change", "customer_id", "segment")
    use = insights.usage_change(m).select("customer_id", "customer_segment", "sessions_last_4_weeks", "sessions_previous_4_weeks")
    line = _line("customer_id", "customer_segment", "sessions_last_4_weeks", "sessions_previous_4_weeks")
    one = r.where("p_customer_id is not null").join(use, F.col("p_customer_id") == F.col("customer_id")).where(
        _matches("p_segment", F.lower("customer_segment")))
    some = r.where("p_customer_id is null and p_segment is not null").join(
        use, F.lower("p_segment") == F.lower("customer_segment"))
    each = _ranked(one.unionByName(some).select("request", "customer_id", line, F.col("customer_id").alias("ref")),
                   [F.asc("customer_id")], False)
    # neither: one row of totals for each such request
    total = insights.usage_change_total(m).select(_line(
        "customers", "sessions_last_4_weeks", "sessions_previous_4_weeks", "errors_total", "customers_with_sessions_decline"))
    every = r.where("p_customer_id is null and p_segment is null").withColumn("line", total.scalar())
    return each.unionByName(every.select("request", F.lit(1).alias("pos"), "line", F.lit(None).cast("string").alias("ref")))


def _by_segment(m, facts: DataFrame, *group: str) -> DataFrame:
    """Counts of a fact per ``group``, for each segment and for all of them, in one aggregation."""
    seg = m.dimension_customer.select("customer_id", F.lower("customer_segment").alias("own"))
    rows = facts.join(seg, "customer_id")
    # rows are counted per segment first, so only the small groups stand twice
    counts = rows.groupBy("own", *group).agg(F.count(F.lit(1)).alias("c"))
    return _under_any(counts, seg=F.col("own")).groupBy("seg", *group).agg(F.sum("c").alias("c"))


def _themes(m, reqs):
    r = _of(reqs, "get_feedback_themes", "min_count", "segment")
    counts = _by_segment(m, m.aggregate_theme.select("customer_id", "theme"), "theme")
    rows = r.join(counts, _wanted("p_segment") == F.col("seg")).where(
        F.col("c") >= F.coalesce(F.col("p_min_count").cast("int"), F.lit(1)))
    rows = rows.select("request", "c", "theme", _line("theme", "c"), F.concat(F.lit("theme:"), "theme").alias("ref"))
    return _ranked(rows, [F.desc("c"), F.asc("theme")], False)


def _breakdown(m, reqs):
    r = _of(reqs, "get_ticket_breakdown", "segment")
    counts = _by_segment(m, m.fact_ticket.select("customer_id", "category", "priority", "status"), "category", "priority", "status")
    rows = r.join(counts, _wanted("p_segment") == F.col("seg")).select(
        "request", "c", "category", "priority", "status", _line("category", "priority", "status", "c"),
        F.lit(None).cast("string").alias("ref"))
    return _ranked(rows, [F.desc("c"), F.asc("category"), F.asc("priority"), F.asc("status")], False)


def _status(param: str) -> Column:
    """The canonical status; an unknown word counts as none, as the tools have it."""
    known = F.create_map(*[F.lit(x) for pair in insights.STATUS_ALIASES.items() for x in pair])
    return F.coalesce(known[F.lower(param)], F.lit(ANY))


def _customers(m, reqs):
    r = _of(reqs, "list_customers", "segment", "status", "search")
    d = _under_any(m.dimension_customer.select("customer_id", "customer_name", "customer_segment", "account_status"),
                   seg=F.lower("customer_segment"), state=F.col("account_status"))
    rows = r.join(d, (_wanted("p_segment") == F.col("seg")) & (_status("p_status") == F.col("state")))
    search = F.lower("p_search")
    rows = rows.where(F.col("p_search").isNull() | F.contains(F.lower("customer_id"), search) | F.contains(F.lower("customer_name"), search))
    rows = rows.select("request", "n", "customer_id", _line("customer_id", "customer_name", "account_status"),
                       F.col("customer_id").alias("ref"))
    return _ranked(rows, [F.asc("customer_id")], True)


def _risk(m, reqs):
    r = _of(reqs, "rank_customer_risk", "segment", "status")
    d = m.dimension_customer.select("customer_id", F.lower("customer_segment").alias("own"), "account_status").where(
        "account_status is not null")
    f = m.customer_features.select("customer_id", "churn_proxy", "sessions_last_4_weeks", "sessions_change_percent", "tickets_open",
                                   "tickets_urgent", "average_satisfaction_score")
    scored = f.join(d, "customer_id").select("customer_id", "own", "account_status", risk_score().alias("score"))
    # without a status, all but the canceled
    state = F.explode(F.when(F.col("account_status") == "canceled", F.array("account_status")).otherwise(
        F.array("account_status", F.lit(ANY))))
    kept = _under_any(scored, seg=F.col("own")).withColumn("state", state)
    # the best of each segment and status hold the best of every request
    best = Window.partitionBy("seg", "state").orderBy(F.desc("score"), F.asc("customer_id"))
    kept = kept.withColumn("place", F.row_number().over(best)).where(F.col("place") <= MOST_ROWS)
    rows = r.join(kept, (_wanted("p_segment") == F.col("seg")) & (_status("p_status") == F.col("state"))).select(
        "request", "n", "score", "customer_id", _line("customer_id", F.col("score").cast("decimal(6,1)")), F.col("customer_id").alias("ref"))
    return _ranked(rows, [F.desc("score"), F.asc("customer_id")], True)


def _named(m, reqs):
    """A name that holds a request's pattern holds the pattern's longest run of plain characters. Customers stand under
    all parts of their names that are as long as some request's run, so a request is compared only with customers
    that hold its whole run; a pattern without plain characters meets the empty part of every name."""
    r = _of(reqs, "resolve_customer_name", "name").where("p_name is not null")
    runs = F.regexp_extract_all(F.lower("p_name"), F.lit(r"[^%_\\]+"), 0)
    longest = F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("part"))))["part"]
    r = r.withColumn("part", F.coalesce(longest, F.lit("")))
    # the different lengths of the runs: a few numbers, one row
    sizes = r.agg(F.collect_set(F.length("part")).alias("sizes")).select("sizes").scalar()
    d = m.dimension_customer.select("customer_id", "customer_name", F.lower("customer_name").alias("low")).withColumn("sizes", sizes)
    parts = F.flatten(F.transform(F.filter("sizes", lambda k: k <= F.length("low")), lambda k: F.transform(
        F.sequence(F.lit(1), F.length("low") - k + 1), lambda i: F.substring("low", i, k))))
    # the outer form infers no filter that cuts the parts twice; a name without parts meets no request
    d = d.select("customer_id", "customer_name", F.explode_outer(F.array_distinct(parts)).alias("part"))
    rows = r.join(d, "part").where(F.expr("customer_name ilike concat('%', p_name, '%')")).select(
        "request", "n", "customer_id", _line("customer_id", "customer_name"), F.col("customer_id").alias("ref"))
    return _ranked(rows, [F.asc("customer_id")], True)


TOOLS = {"get_customer_tickets": _tickets, "get_customer_feedback": _feedback, "get_subscription_events": _events,
         "get_usage_trend": _trend, "get_customer_profile": _profile, "get_usage_change": _usage_change,
         "get_feedback_themes": _themes, "get_ticket_breakdown": _breakdown, "list_customers": _customers,
         "rank_customer_risk": _risk, "resolve_customer_name": _named}


def request_rows(m, reqs: DataFrame, tools: dict | None = None) -> DataFrame:
    """tool, request, pos, line, ref: all rows of all requests."""
    parts = [f(m, reqs).withColumn("tool", F.lit(name)) for name, f in (tools or TOOLS).items()]
    return reduce(DataFrame.unionByName, parts)


def _called(calls: DataFrame) -> DataFrame:
    return calls.select("conv_id", "turn", "call_order", "tool", request_key(F.col("args")).alias("request"))


def tool_result_summary(m, calls: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per call how many rows its tool returned, and the first ``sample`` of them."""
    reqs = requests(calls)
    rows = request_rows(m, reqs)
    first = F.filter(F.array_sort(F.collect_list(F.when(F.col("pos") <= sample, F.struct("pos", "line")))), lambda s: s.isNotNull())
    found = rows.groupBy("tool", "request").agg(F.count(F.lit(1)).alias("row_count"), F.transform(first, lambda s: s["line"]).alias("sample"))
    out = _called(calls).where(F.col("tool").isin(*TOOLS)).join(found, ["tool", "request"], "left")
    return out.select("conv_id", "turn", "call_order", "tool", F.coalesce("row_count", F.lit(0)).alias("row_count"),
                      F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def tool_source_refs(m, calls: DataFrame) -> DataFrame:
    """The records each answer is based on, in order: one row per request and ref."""
    return request_rows(m, requests(calls)).where("ref is not null").select("tool", "request", "pos", "ref")


def tool_warnings(m, calls: DataFrame) -> DataFrame:
    """The notes of each request: what was not found, and what a reader must know. One row per note."""
    reqs = requests(calls)
    d = m.dimension_customer.select("customer_id", "monthly_revenue")
    p = _of(reqs, "get_customer_profile", "customer_id").join(d, F.col("p_customer_id") == F.col("customer_id"), "left")
    note = F.when(F.col("customer_id").isNull(), F.format_string(NOT_FOUND, F.coalesce("p_customer_id", F.lit("None")))).when(
        F.col("monthly_revenue").isNull(), F.lit(NO_REVENUE))
    profile = p.select(F.lit("get_customer_profile").alias("tool"), "request", note.alias("warning"))
    names = _of(reqs, "resolve_customer_name", "name")
    hits = _named(m, reqs).select("request").distinct().withColumn("hit", F.lit(True))
    note = F.when(F.col("p_name").isNull(), F.lit(EMPTY_NAME)).when(F.col("hit").isNull(), F.format_string(NO_MATCH, "p_name"))
    named = names.join(hits, "request", "left").select(F.lit("resolve_customer_name").alias("tool"), "request", note.alias("warning"))
    notes = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])
    fixed = reqs.select("tool", "request", notes[F.col("tool")].alias("warning"))
    return profile.unionByName(named).unionByName(fixed).where("warning is not null")
