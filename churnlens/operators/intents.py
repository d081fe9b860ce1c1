"""Question classification over a text log (H1-H8), all native Column logic.

Input: any DataFrame with a text column (here the user turns of the
``conversations`` table). Each step adds columns; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions import lexicons as L
from churnlens.functions.rules import count_contained

NAME_PATTERN = r"\b[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]*)?\b"
ISO_DATE_PATTERN = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
# Python str.title() of the segment and plan words
TITLE_CASE = {"smb": "Smb", "mid-market": "Mid-Market", "enterprise": "Enterprise", "free": "Free",
              "team": "Team", "business": "Business"}


#: the text in lower case, while words are looked for in it
LOW = "_low"


def _from_low(df: DataFrame, text: str, made) -> DataFrame:
    """``df`` and the columns that ``made`` makes of the text in lower case. That is a projection of its own: all
    words read it, and inside a lambda it would be made again for each word."""
    if LOW in df.columns:
        return df.select("*", *made(F.col(LOW)))
    return df.select("*", F.lower(F.col(text)).alias(LOW)).select("*", *made(F.col(LOW))).drop(LOW)


def _first_contained(low: Column, words: list[str]) -> Column:
    out = None
    for w in words:
        cond = low.contains(w)
        out = F.when(cond, F.lit(w)) if out is None else out.when(cond, F.lit(w))
    return out


def extract_ids(df: DataFrame, text: str = "text") -> DataFrame:
    """H1: CUST-/TCK-/FDB- + >=3 digits, any case, upper-cased, distinct in order."""
    t = F.col(text)
    return df.select("*", *[
        F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(p), 0), lambda x: F.upper(x))).alias(name)
        for name, p in L.ID_PATTERNS])


def extract_segment_plan(df: DataFrame, text: str = "text") -> DataFrame:
    """H2: first segment / plan word contained, in list order."""
    return _from_low(df, text, lambda low: [_first_contained(low, L.SEGMENTS).alias("segment"),
                                            _first_contained(low, L.PLANS).alias("plan")])


def extract_date_hints(df: DataFrame, text: str = "text") -> DataFrame:
    """H3: fixed phrases in order, then ISO dates."""
    def hints(low: Column) -> list[Column]:
        phrases = F.filter(F.array(*[F.when(low.contains(p), F.lit(p)) for p in L.DATE_PHRASES]),
                           lambda x: x.isNotNull())
        return [F.concat(phrases, F.regexp_extract_all(low, F.lit(ISO_DATE_PATTERN), 0)).alias("date_hints")]
    return _from_low(df, text, hints)


def name_hint(text: Column) -> Column:
    """H4: first capitalised 1-2 token phrase, >= 3 chars, whose tokens longer
    than one char are all non-stop-words."""
    stop = F.array(*[F.lit(w) for w in L.NAME_STOP_WORDS])

    def ok(m: Column) -> Column:
        meaningful = F.filter(F.split(m, r"\s+"), lambda t: F.length(t) > 1)
        return ((F.size(meaningful) > 0) & (F.length(m) >= 3)
                & F.forall(meaningful, lambda t: ~F.array_contains(stop, F.lower(t))))

    cands = F.filter(F.regexp_extract_all(text, F.lit(NAME_PATTERN), 0), ok)
    return F.get(cands, 0)


def extract_name_hint(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("*", name_hint(F.col(text)).alias("customer_name_hint"))


def keyword_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """H5: keywords contained per intent, plus the irrelevant list."""
    lists = [(f"score_{intent}", words) for intent, words, _ in L.INTENT_LEXICONS] + [("score_irrelevant", L.IRRELEVANT_KEYWORDS)]
    return _from_low(df, text, lambda low: [count_contained(low, words).alias(name) for name, words in lists])


def classify(df: DataFrame, text: str = "text") -> DataFrame:
    """H1-H6: entities, scores and the intent label."""
    low = F.col(LOW)
    out = df.select("*", F.lower(F.col(text)).alias(LOW))
    out = keyword_scores(extract_name_hint(extract_date_hints(extract_segment_plan(extract_ids(out, text), text),
                                                              text), text), text)
    hint = F.col("customer_name_hint")
    looks_brand = F.substring(hint, 2, 1 << 20).rlike("[A-Z]") | (F.length(hint) >= 10)
    framed = (F.col("score_customer_query") > 0) | low.contains(" about ") | low.contains("customer")
    counting = low.contains("how many") | low.contains("count of") | low.contains("number of") | \
        low.contains(" total ")
    n = len(L.INTENT_LEXICONS)
    best = F.greatest(*[F.struct(F.col(f"score_{i}").alias("s"), F.lit(spec).alias("spec"),
                                 F.lit(n - k).alias("first"), F.lit(i).alias("intent"))
                        for k, (i, _, spec) in enumerate(L.INTENT_LEXICONS)])
    total = sum((F.col(f"score_{i}") for i, _, _ in L.INTENT_LEXICONS), F.lit(0))
    intent = (F.when(F.size("customer_ids") > 0, "customer_query")
              .when(F.size("ticket_ids") > 0, "ticket_query")
              .when(F.size("feedback_ids") > 0, "feedback_query")
              .when(hint.isNotNull() & (looks_brand | framed), "customer_query")
              .when(counting, "analytics_exec")
              .when((F.col("score_irrelevant") > 0) & (total == 0), "irrelevant")
              .when(best["s"] == 0, "general")
              .otherwise(best["intent"]))
    return out.withColumn("intent", intent).drop(LOW)


def route_intent(df: DataFrame) -> DataFrame:
    """H7: intent -> routed node (fixed map; unknown -> general)."""
    routes = F.create_map(*[F.lit(x) for pair in L.ROUTES for x in pair])
    return df.withColumn("routed_node", F.coalesce(routes[F.col("intent")], F.lit("general")))


def requested_metric(df: DataFrame, text: str = "text") -> DataFrame:
    """H8: the metric request a question asks for (analytics questions only).

    Substring matching as in the reference: 'count' also hits 'country' and
    'account'."""
    low = F.col(LOW)
    metric = (F.when(low.contains("revenue") | low.contains("mrr") | low.contains("earning"), "sum")
              .when(low.contains("average") | low.contains(" avg") | low.contains("mean"), "avg"))
    for w, mname in L.METRIC_WORDS:
        metric = metric.when(low.contains(w), mname)
    entity = None
    for w, e in L.ENTITY_WORDS:
        entity = F.when(low.contains(w), e) if entity is None else entity.when(low.contains(w), e)
    entity = entity.when(low.contains("revenue"), "customer")
    by = low.contains(" by ") | low.contains(" per ")
    dim = None
    for w, d in L.DIMENSION_WORDS:
        dim = F.when(by & low.contains(w), d) if dim is None else dim.when(by & low.contains(w), d)
    # columns of their own, each worked out once: the request's parts read them many times
    found = df.select("*", F.lower(F.col(text)).alias(LOW)).select(
        "*", metric.alias("_metric"), entity.alias("_entity"), dim.alias("_dim")).drop(LOW)
    metric, entity, dim = F.col("_metric"), F.col("_entity"), F.col("_dim")
    numeric = None
    for e, d in L.DEFAULT_NUMERIC_DIM:
        numeric = F.when(entity == e, d) if numeric is None else numeric.when(entity == e, d)
    numeric = numeric.otherwise("monthly_revenue")
    seg_title = _title(F.col("segment"))
    plan_title = _title(F.col("plan"))
    filters = F.map_filter(F.map_from_arrays(
        F.array(F.lit("customer_segment"), F.lit("subscription_plan")), F.array(seg_title, plan_title)),
        lambda k, v: v.isNotNull())
    has_plan = (F.col("intent") == "analytics_exec") & metric.isNotNull() & entity.isNotNull()
    return found.select(
        "*",
        F.when(has_plan, metric).alias("req_metric"),
        F.when(has_plan, entity).alias("req_of"),
        F.when(has_plan & metric.isin("sum", "avg"), numeric).alias("req_of_dimension"),
        F.when(has_plan, F.when(dim.isNotNull(), F.array(dim)).otherwise(F.array().cast("array<string>")))
        .alias("req_dimensions"),
        F.when(has_plan, filters).alias("req_filters"),
    ).drop("_metric", "_entity", "_dim")


def _title(c: Column) -> Column:
    out = None
    for k, v in TITLE_CASE.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def question_log(conversations: DataFrame) -> DataFrame:
    """User turns as a question log; a turn without text is stopped by the input check (G1)."""
    return conversations.filter((F.col("role") == "user") & F.col("text").isNotNull()).select("conv_id", "turn", "text")


def tag_questions(conversations: DataFrame) -> DataFrame:
    return requested_metric(route_intent(classify(question_log(conversations))))


def metric_demand(tagged: DataFrame) -> DataFrame:
    """H8 roll-up: demand per requested (metric, entity, dimension)."""
    return tagged.groupBy("intent", "req_metric", "req_of", F.get("req_dimensions", 0).alias("req_dimension")) \
        .agg(F.count(F.lit(1)).alias("questions"))


def request_log(tagged: DataFrame) -> DataFrame:
    """Questions as semantic requests (input of the F2 audit)."""
    return tagged.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.col("req_metric").alias("metric"), F.col("req_of").alias("of"),
        F.col("req_of_dimension").alias("of_dimension"), F.col("req_dimensions").alias("dimensions"),
        F.col("req_filters").alias("filters"),
        F.lit(None).cast("map<string,string>").alias("time_range"), F.lit(None).cast("int").alias("limit"))
