"""Serving analytics (E1-E18): risk, revenue at risk, breakdowns, trends.

Each tool is ``f(model, **params) -> DataFrame``. Parameters become filters in
the plan (so they reach the scan or prune the join input) instead of Python
post-filters; risk score and drivers are Column expressions, and top-n is
``orderBy(...).limit(n)`` (TakeOrderedAndProject: a bounded heap per task,
not a global sort). Per-customer lists use ``row_number() <= n`` per customer,
which Spark plans with a WindowGroupLimit before the shuffle so a hot customer
ships at most n rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.rules import risk_drivers, risk_score

# Caller status words and their canonical form
STATUS_ALIASES = {"active": "active", "canceled": "canceled", "paused": "paused", "churned": "canceled"}


def normalize_status(status: str | None) -> str | None:
    """Map the caller's status filter to the canonical set; unknown -> None."""
    if status is None:
        return None
    return STATUS_ALIASES.get(status.strip().lower())


def _seg_eq(col: Column, segment: str | None) -> Column:
    """Segment filter; case-insensitive so a lower-cased hand-over still matches
    (documented deviation: the reference compared case-sensitively)."""
    return F.lower(col) == F.lit(segment.lower())


def top_n_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# E1 ------------------------------------------------------------------------------------------
def resolve_customer_name(m, name: str, limit: int = 10) -> DataFrame:
    """ILIKE %name% (user % and _ stay wildcards), ordered by id, first 10."""
    name = (name or "").strip()
    d = m.dimension_customer
    cols = ["customer_id", "customer_name", "customer_segment", "subscription_plan", "account_status"]
    if not name:
        return d.select(*cols).limit(0)
    return d.filter(F.col("customer_name").ilike(f"%{name}%")).select(*cols).orderBy("customer_id").limit(limit)


# E2 ------------------------------------------------------------------------------------------
PROFILE_FEATURES = ["churn_proxy", "ticket_count", "tickets_open", "tickets_urgent",
                    "average_resolution_time_hours", "average_satisfaction_score", "sessions_last_4_weeks",
                    "sessions_previous_4_weeks", "sessions_change_percent", "errors_total", "feedback_count",
                    "average_rating", "cancellations", "downgrades", "upgrades", "renewals", "revenue_change_sum",
                    "last_event_date", "last_event_type"]


def customer_profile(m, customer_id: str | None = None) -> DataFrame:
    """Dimension LEFT JOIN features (28 columns) + a revenue warning column.
    ``customer_id=None`` returns every customer's profile (batch form)."""
    d = m.dimension_customer
    if customer_id is not None:
        d = d.filter(F.col("customer_id") == customer_id)
    f = m.customer_features.select("customer_id", *PROFILE_FEATURES)
    out = d.join(f, "customer_id", "left")
    return out.select(
        *d.columns, *PROFILE_FEATURES,
        F.when(F.col("monthly_revenue").isNull(),
               F.lit("monthly_revenue is NULL (unknown); revenue-at-risk excludes it.")).alias("warning"),
    )


# E3-E5 ---------------------------------------------------------------------------------------
def rank_customer_risk(m, limit: int | None = 10, segment: str | None = None,
                       status: str | None = None) -> DataFrame:
    """Score desc, ties by customer id; canceled excluded unless asked for
    (``<> 'canceled'`` also drops NULL status, as the reference does)."""
    f = m.customer_features.select("customer_id", "churn_proxy", "sessions_last_4_weeks",
                                   "sessions_previous_4_weeks", "sessions_change_percent", "tickets_open",
                                   "tickets_urgent", "average_satisfaction_score")
    d = m.dimension_customer.select("customer_id", "customer_name", "customer_segment", "subscription_plan",
                                    "account_status", "monthly_revenue")
    if segment:
        d = d.filter(_seg_eq(F.col("customer_segment"), segment))
    st = normalize_status(status)
    d = d.filter(F.col("account_status") == st) if st else d.filter(F.col("account_status") != "canceled")
    j = f.join(d, "customer_id")
    out = j.select("customer_id", "customer_name", "customer_segment", "subscription_plan", "account_status",
                   "monthly_revenue", "churn_proxy", "sessions_last_4_weeks", "sessions_previous_4_weeks",
                   "sessions_change_percent", "tickets_open", "tickets_urgent", "average_satisfaction_score",
                   risk_score().alias("risk_score"), risk_drivers().alias("risk_drivers"))
    out = out.orderBy(F.desc("risk_score"), F.asc("customer_id"))
    return out.limit(limit) if limit is not None else out


def _risk_candidates(m, segment: str | None) -> DataFrame:
    d = m.dimension_customer.select("customer_id", "customer_name", "customer_segment", "monthly_revenue",
                                    "account_status")
    if segment:
        d = d.filter(_seg_eq(F.col("customer_segment"), segment))
    f = m.customer_features.select("customer_id", "churn_proxy", "sessions_change_percent", "tickets_open",
                                   "tickets_urgent", "average_satisfaction_score", "sessions_last_4_weeks")
    j = d.join(f, "customer_id", "left")
    status = F.col("account_status")
    # canceled are already lost; a NULL status is kept (Python `==` on None)
    j = j.filter(status.isNull() | (status != "canceled"))
    j = j.withColumn("risk_score", risk_score())
    at_risk = (F.coalesce(status == "paused", F.lit(False)) | F.coalesce(F.col("churn_proxy"), F.lit(False))
               | (F.col("risk_score") >= 50.0))
    return j.filter(at_risk)


def revenue_at_risk(m, segment: str | None = None) -> DataFrame:
    """One row; money summed as decimal(18,2) so the total is order-free."""
    c = _risk_candidates(m, segment)
    rev = F.col("monthly_revenue")
    return c.agg(
        F.coalesce(F.sum(rev.cast("decimal(18,2)")), F.lit(0).cast("decimal(28,2)")).cast("decimal(18,2)")
        .alias("revenue_at_risk"),
        F.count_if(rev.isNotNull()).alias("at_risk_customers"),
        F.count_if(rev.isNull()).alias("at_risk_with_unknown_revenue"),
    ).withColumn("segment_filter", F.lit(segment).cast("string"))


def revenue_at_risk_customers(m, segment: str | None = None) -> DataFrame:
    """Per-customer list behind E6 (known revenue only)."""
    return _risk_candidates(m, segment).filter(F.col("monthly_revenue").isNotNull()).select(
        "customer_id", "customer_name", "account_status", "monthly_revenue", "risk_score")


# E8-E11 -------------------------------------------------------------------------------------
def customer_tickets(m, customer_id: str | None = None, limit: int = 20, category: str | None = None,
                     priority: str | None = None, status: str | None = None) -> DataFrame:
    """Newest first (ticket id breaks ties); no id -> top ``limit`` per customer."""
    t = m.fact_ticket
    for col, v in (("category", category), ("priority", priority), ("status", status)):
        if v:
            t = t.filter(F.col(col) == v.lower())
    cols = ["customer_id", "ticket_id", "created_at", "subject", "category", "priority", "status",
            "resolution_time_hours", "satisfaction_score"]
    order = [F.desc("created_at"), F.asc("ticket_id")]
    if customer_id is not None:
        return t.filter(F.col("customer_id") == customer_id).select(*cols).orderBy(*order).limit(limit)
    return top_n_per_key(t.select(*cols), "customer_id", order, limit)


def customer_feedback(m, customer_id: str | None = None, limit: int = 20) -> DataFrame:
    """Feedback LEFT JOIN themes on feedback_id, newest first."""
    f = m.fact_feedback
    if customer_id is not None:
        f = f.filter(F.col("customer_id") == customer_id)
    t = m.aggregate_theme.select("feedback_id", "theme", "sentiment", F.col("source").alias("_source"))
    j = f.join(t, "feedback_id", "left").select(
        "customer_id", "feedback_id", "created_at", "feedback_text", "feedback_source", "rating", "theme",
        "sentiment", "_source")
    order = [F.desc("created_at"), F.asc("feedback_id"), F.asc_nulls_last("_source")]
    if customer_id is not None:
        return j.orderBy(*order).limit(limit).drop("_source")
    return top_n_per_key(j, "customer_id", order, limit).drop("_source")


def feedback_themes(m, min_count: int = 1, segment: str | None = None) -> DataFrame:
    """Theme counts with sentiment split; HAVING count >= min_count."""
    t = m.aggregate_theme
    d = m.dimension_customer.select("customer_id", "customer_segment")
    if segment:
        d = d.filter(_seg_eq(F.col("customer_segment"), segment))
    s = F.col("sentiment")
    return (t.join(d, "customer_id").groupBy("theme").agg(
        F.count(F.lit(1)).alias("feedback_count"),
        F.count_if(s == "positive").alias("positive"),
        F.count_if(s == "negative").alias("negative"),
        F.count_if(s == "neutral").alias("neutral"),
    ).filter(F.col("feedback_count") >= min_count)
        .withColumn("source_ref", F.concat(F.lit("theme:"), F.col("theme")))
        .orderBy(F.desc("feedback_count"), "theme"))


def ticket_breakdown(m, segment: str | None = None) -> DataFrame:
    """Group by category, priority, status."""
    d = m.dimension_customer.select("customer_id", "customer_segment")
    if segment:
        d = d.filter(_seg_eq(F.col("customer_segment"), segment))
    return (m.fact_ticket.join(d, "customer_id").groupBy("category", "priority", "status").agg(
        F.count(F.lit(1)).alias("ticket_count"),
        F.avg("resolution_time_hours").alias("average_resolution_time_hours"),
        F.avg("satisfaction_score").alias("average_satisfaction_score"),
    ).orderBy(F.desc("ticket_count"), "category", "priority", "status"))


# E12-E15 ------------------------------------------------------------------------------------
USAGE_COLS = ["sessions_last_4_weeks", "sessions_previous_4_weeks", "sessions_change_percent",
              "active_users_last_4_weeks", "active_users_previous_4_weeks", "active_users_change_percent",
              "errors_total"]


def usage_change(m, customer_id: str | None = None, segment: str | None = None) -> DataFrame:
    """Per-customer rows; the segment filter reads the features' segment."""
    f = m.customer_features.select("customer_id", "customer_segment", *USAGE_COLS)
    if customer_id:
        f = f.filter(F.col("customer_id") == customer_id)
    if segment:
        f = f.filter(_seg_eq(F.col("customer_segment"), segment))
    d = m.dimension_customer.select("customer_id", "customer_name",
                                    F.col("customer_segment").alias("_dseg"))
    return f.join(d, "customer_id").select("customer_id", "customer_name",
                                           F.col("_dseg").alias("customer_segment"), *USAGE_COLS)


def usage_change_total(m) -> DataFrame:
    """Totals over all customers; change % NULL when the prior total is 0."""
    u = usage_change(m)
    z = F.lit(0)
    last = F.sum(F.coalesce(F.col("sessions_last_4_weeks"), z))
    prev = F.sum(F.coalesce(F.col("sessions_previous_4_weeks"), z))
    agg = u.agg(
        F.count(F.lit(1)).alias("customers"),
        last.alias("sessions_last_4_weeks"),
        prev.alias("sessions_previous_4_weeks"),
        F.sum(F.coalesce(F.col("errors_total"), z)).alias("errors_total"),
        F.count_if(F.coalesce(F.col("sessions_change_percent"), F.lit(0.0)) < -20.0)
        .alias("customers_with_sessions_decline"),
    )
    p = F.col("sessions_previous_4_weeks")
    return agg.withColumn("sessions_change_percent", F.when(
        p != 0, F.round((F.col("sessions_last_4_weeks") - p) * F.lit(100.0) / p, 1)))


def usage_trend(m, customer_id: str | None = None, weeks: int = 8) -> DataFrame:
    """Daily rows since max(date over all) - (weeks-1) weeks, ascending."""
    u = m.fact_usage
    end = u.select(F.max("date")).scalar()
    rows = u.filter(F.col("date") >= F.date_sub(end, 7 * (weeks - 1)))
    if customer_id is not None:
        rows = rows.filter(F.col("customer_id") == customer_id)
    return rows.select(
        "customer_id", "date", "active_users", "sessions", "errors", "feature_usage", "average_session_duration",
        F.concat_ws(":", F.col("customer_id"), F.col("date").cast("string")).alias("source_ref"),
    ).orderBy("customer_id", "date")


def subscription_events(m, customer_id: str | None = None, limit: int = 10) -> DataFrame:
    """Newest first, ties by input position (latest first)."""
    s = m.fact_subscription_event.select(
        "customer_id", "event_date", "event_type", "previous_plan", "new_plan", "revenue_change",
        "_input_row_number",
        F.concat_ws(":", F.col("customer_id"), F.col("event_date").cast("string"), F.col("event_type"))
        .alias("source_ref"))
    order = [F.desc("event_date"), F.desc("_input_row_number"), F.asc("event_type"), F.desc("revenue_change")]
    if customer_id is not None:
        return s.filter(F.col("customer_id") == customer_id).orderBy(*order).limit(limit) \
            .drop("_input_row_number")
    return top_n_per_key(s, "customer_id", order, limit).drop("_input_row_number")


# E16-E17 ------------------------------------------------------------------------------------
def segment_metrics_lookup(m, segment: str | None = None) -> DataFrame:
    s = m.segment_metrics
    if segment:
        s = s.filter((F.col("segment") == segment) | (F.col("plan") == segment))
    return s.orderBy(F.asc_nulls_last("segment"), F.asc_nulls_last("plan"))


def list_customers(m, segment: str | None = None, status: str | None = None, limit: int = 50,
                   search: str | None = None) -> DataFrame:
    d = m.dimension_customer.select("customer_id", "customer_name", "customer_segment", "country",
                                    "subscription_plan", "monthly_revenue", "account_status")
    if segment:
        d = d.filter(_seg_eq(F.col("customer_segment"), segment))
    st = normalize_status(status)
    if st:
        d = d.filter(F.col("account_status") == st)
    if search:
        d = d.filter(F.col("customer_id").ilike(f"%{search}%") | F.col("customer_name").ilike(f"%{search}%"))
    f = m.customer_features.select("customer_id", "churn_proxy", "sessions_last_4_weeks",
                                   "sessions_change_percent", "tickets_open", "tickets_urgent",
                                   "average_satisfaction_score")
    return (d.join(f, "customer_id", "left").orderBy("customer_id").limit(limit)
            .withColumn("risk_score", risk_score()))


# E18 ----------------------------------------------------------------------------------------
def ref_keys(m) -> DataFrame:
    """Composite citation keys over all records: id:date, id:date:type, theme:x."""
    u = m.fact_usage.select(F.concat_ws(":", "customer_id", F.col("date").cast("string")).alias("ref"),
                            F.lit("usage").alias("kind"))
    s = m.fact_subscription_event.select(
        F.concat_ws(":", "customer_id", F.col("event_date").cast("string"), "event_type").alias("ref"),
        F.lit("subscription_event").alias("kind"))
    t = m.aggregate_theme.select(F.concat(F.lit("theme:"), F.col("theme")).alias("ref"),
                                 F.lit("theme").alias("kind")).distinct()
    return u.unionByName(s).unionByName(t)
