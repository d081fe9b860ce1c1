"""Star schema, per-customer features and segment benchmarks.

Shape of the plan at scale: every fact table is aggregated per ``customer_id``
first (partial aggregation before the shuffle, so a hot customer costs one row
per map task), and only the aggregates are joined. All four aggregates are
hash-partitioned on ``customer_id`` with the same partition count, so the
left joins to the dimension reuse that partitioning instead of reshuffling;
AQE turns small sides into broadcasts at run time. Window bounds and the rating
split are 1-row aggregates used as scalar subqueries (computed once, inlined as
literals), never a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.lexicons import CHURN_STATUSES, EVENT_TYPES, TICKET_CATEGORIES
from churnlens.functions.lexicons import TICKET_PRIORITIES, TICKET_STATUSES


def dimension_customer(clean_customers: DataFrame) -> DataFrame:
    """Canonical attributes + constant revenue_imputed = FALSE."""
    return clean_customers.select(
        "customer_id", "customer_name", "customer_segment", "country", "subscription_plan",
        "monthly_revenue", "account_created_at", "account_status",
        F.lit(False).alias("revenue_imputed"),
    )


# Fact projections
def fact_ticket(clean_tickets: DataFrame) -> DataFrame:
    return clean_tickets.select("ticket_id", "customer_id", "created_at", "subject", "message", "category",
                                "priority", "resolution_time_hours", "status", "satisfaction_score")


def fact_feedback(clean_feedback: DataFrame) -> DataFrame:
    return clean_feedback.select("feedback_id", "customer_id", "created_at", "feedback_text",
                                 "feedback_source", "rating")


def fact_usage(clean_usage: DataFrame) -> DataFrame:
    return clean_usage.select("customer_id", "date", "active_users", "sessions", "feature_usage", "errors",
                              "average_session_duration")


def fact_subscription_event(clean_subs: DataFrame) -> DataFrame:
    return clean_subs.select("customer_id", "event_date", "event_type", "previous_plan", "new_plan",
                             "revenue_change", "_input_row_number")


def usage_windows(fact_usage: DataFrame) -> DataFrame:
    """1 row; last window starts end-27 d, previous window end-55 d."""
    end = F.max("date")
    return fact_usage.agg(end.alias("analysis_end_date"),
                          F.date_sub(end, 27).alias("last_4_weeks_start"),
                          F.date_sub(end, 55).alias("previous_4_weeks_start"))


def rating_split(fact_feedback: DataFrame) -> DataFrame:
    """Midpoint of the feedback time range (microsecond exact)."""
    lo, hi = F.min("created_at"), F.max("created_at")
    lo_us, hi_us = F.unix_micros(lo.cast("timestamp")), F.unix_micros(hi.cast("timestamp"))
    mid = F.timestamp_micros(lo_us + F.floor((hi_us - lo_us) / 2).cast("long")).cast("timestamp_ntz")
    return fact_feedback.agg(mid.alias("rating_split_point"))


def ticket_aggregates(fact_ticket: DataFrame) -> DataFrame:
    """Per-customer counts for every configured category/priority/status."""
    cat, pri, st = F.col("category"), F.col("priority"), F.col("status")
    aggs = [F.count(F.lit(1)).alias("ticket_count"),
            F.count_if(cat.isin([c for c, _ in TICKET_CATEGORIES])).alias("tickets_any_category")]
    aggs += [F.count_if(cat == c).alias(f"tickets_{c}") for c, _ in TICKET_CATEGORIES]
    aggs += [F.count_if(pri == p).alias(f"tickets_{p}") for p, _ in TICKET_PRIORITIES]
    aggs += [F.count_if(st == s).alias(f"tickets_{s}") for s, _ in TICKET_STATUSES]
    aggs += [F.avg("resolution_time_hours").alias("average_resolution_time_hours"),
             F.avg("satisfaction_score").alias("average_satisfaction_score")]
    return fact_ticket.groupBy("customer_id").agg(*aggs)


def usage_aggregates(fact_usage: DataFrame) -> DataFrame:
    """C11: filtered sums over the two windows (NULL when no row falls inside)."""
    # the scalar subquery is referenced once (bound to a column); every other
    # use reads that column, so the window bounds are computed by one job
    end = fact_usage.select(F.max("date")).scalar()
    u = fact_usage.withColumn("_end", end)
    last_start, prev_start = F.date_sub(F.col("_end"), 27), F.date_sub(F.col("_end"), 55)
    d = F.col("date")
    in_last = d >= last_start
    in_prev = (d >= prev_start) & (d < last_start)
    return u.groupBy("customer_id").agg(
        F.sum(F.when(in_last, F.col("sessions"))).alias("sessions_last_4_weeks"),
        F.sum(F.when(in_prev, F.col("sessions"))).alias("sessions_previous_4_weeks"),
        F.sum(F.when(in_last, F.col("active_users"))).alias("active_users_last_4_weeks"),
        F.sum(F.when(in_prev, F.col("active_users"))).alias("active_users_previous_4_weeks"),
        F.sum("errors").alias("errors_total"),
        F.avg("average_session_duration").alias("average_session_duration"),
    )


def feedback_aggregates(fact_feedback: DataFrame) -> DataFrame:
    """Count, average rating, averages either side of the split point."""
    split = rating_split(fact_feedback).select("rating_split_point").scalar()
    f = fact_feedback.withColumn("_split", split)  # one reference to the subquery
    ts, r, split = F.col("created_at"), F.col("rating"), F.col("_split")
    return f.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("feedback_count"),
        F.avg(r).alias("average_rating"),
        F.avg(F.when(ts >= split, r)).alias("rating_last_half"),
        F.avg(F.when(ts < split, r)).alias("rating_prior_half"),
    )


def last_event_type(fact_sub: DataFrame) -> DataFrame:
    """C14: the correlated "latest event" subquery as ``row_number() = 1`` per
    customer ordered by (event_date, input position, event_type) descending —
    a WindowGroupLimit keeps one row per customer per map task before the
    shuffle, and no string-valued aggregation buffer forces a sort aggregate."""
    w = Window.partitionBy("customer_id").orderBy(F.desc("event_date"), F.desc("_input_row_number"),
                                                 F.desc("event_type"))
    return (fact_sub.select("customer_id", "event_date", "_input_row_number", "event_type")
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .select("customer_id", F.col("event_type").alias("last_event_type")))


def subscription_aggregates(fact_sub: DataFrame) -> DataFrame:
    """C13 + C14: event counts, revenue delta, last event date and type.
    The counts are one hash aggregate; both sides are partitioned by
    customer_id, so joining the last event type adds no exchange."""
    et = F.col("event_type")
    aggs = [F.count_if(et == "cancellation").alias("cancellations"),
            F.count_if(et == "downgrade").alias("downgrades"),
            F.count_if(et == "upgrade").alias("upgrades"),
            F.count_if(et == "renewal").alias("renewals"),
            F.count_if(et.isin([e for e, _ in EVENT_TYPES])).alias("total_events"),
            F.sum("revenue_change").alias("revenue_change_sum"),
            F.max("event_date").alias("last_event_date")]
    return fact_sub.groupBy("customer_id").agg(*aggs).join(last_event_type(fact_sub), "customer_id")


def churn_proxy(status=None):
    """Status in the churn list; NULL status -> NULL (``isin`` keeps NULL)."""
    status = F.col("account_status") if status is None else status
    return status.isin([s for s, _ in CHURN_STATUSES])


TICKET_COUNT_COLUMNS = (["ticket_count", "tickets_any_category"]
                        + [f"tickets_{c}" for c, _ in TICKET_CATEGORIES]
                        + [f"tickets_{p}" for p, _ in TICKET_PRIORITIES]
                        + [f"tickets_{s}" for s, _ in TICKET_STATUSES])


def _pct_change(last: str, prev: str):
    p = F.col(prev)
    return (F.col(last) - p) * F.lit(100.0) / F.when(p != 0, p)


def customer_features(dim: DataFrame, tickets: DataFrame, usage: DataFrame, feedback: DataFrame,
                      subs: DataFrame) -> DataFrame:
    """44 columns, one row per customer; counts coalesced to 0, sums not."""
    cust = dim.select("customer_id", "account_status", "customer_segment", "subscription_plan", "monthly_revenue")
    j = (cust.join(ticket_aggregates(tickets), "customer_id", "left")
             .join(usage_aggregates(usage), "customer_id", "left")
             .join(feedback_aggregates(feedback), "customer_id", "left")
             .join(subscription_aggregates(subs), "customer_id", "left"))
    cols = ["customer_id", "account_status", "customer_segment", "subscription_plan", "monthly_revenue",
            churn_proxy().alias("churn_proxy")]
    cols += [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in TICKET_COUNT_COLUMNS]
    cols += ["average_resolution_time_hours", "average_satisfaction_score",
             "sessions_last_4_weeks", "sessions_previous_4_weeks",
             "active_users_last_4_weeks", "active_users_previous_4_weeks",
             _pct_change("sessions_last_4_weeks", "sessions_previous_4_weeks").alias("sessions_change_percent"),
             _pct_change("active_users_last_4_weeks", "active_users_previous_4_weeks")
             .alias("active_users_change_percent"),
             "errors_total", "average_session_duration",
             F.coalesce(F.col("feedback_count"), F.lit(0)).alias("feedback_count"),
             "average_rating", "rating_last_half", "rating_prior_half"]
    cols += [F.coalesce(F.col(c), F.lit(0)).alias(c)
             for c in ("cancellations", "downgrades", "upgrades", "renewals", "total_events")]
    cols += ["revenue_change_sum", "last_event_date", "last_event_type"]
    return j.select(*cols)


def global_stats(customer_base: DataFrame) -> DataFrame:
    """One-row benchmark (customer_base is unique per customer_id)."""
    churn = F.coalesce(F.col("churn_proxy"), F.lit(False))
    n = F.count_distinct("customer_id")
    return customer_base.agg(
        n.alias("global_customers"),
        F.count_distinct(F.when(F.col("monthly_revenue").isNotNull(), F.col("customer_id")))
        .alias("global_revenue_customers"),
        F.sum("monthly_revenue").alias("global_revenue"),
        F.count_if(F.col("ticket_count") > 0).alias("global_customers_with_tickets"),
        F.count_if(churn).alias("global_churn"),
        F.avg("average_resolution_time_hours").alias("global_average_resolution"),
        F.avg("average_satisfaction_score").alias("global_average_satisfaction"),
        (F.count_if(churn) * F.lit(1.0) / F.when(n != 0, n)).alias("global_cancel_rate"),
    )


def segment_base(features: DataFrame, dim: DataFrame) -> DataFrame:
    d = dim.select("customer_id", "customer_segment", "subscription_plan", "account_status", "monthly_revenue")
    f = features.select("customer_id", "ticket_count", "tickets_urgent", "tickets_bug", "tickets_billing",
                        "tickets_open", "average_resolution_time_hours", "average_satisfaction_score",
                        "churn_proxy")
    return f.join(d, "customer_id")


def segment_metrics(features: DataFrame, dim: DataFrame) -> DataFrame:
    """C17: per-segment rows, per-plan rows and the global benchmark from ONE
    grouping-sets aggregation ((segment), (plan), ()) — a single pass over the
    customer base with partial aggregation. The global row is then attached
    to the others with a window over the aggregated result, which holds one
    row per segment and plan (bounded), not per customer.

    customer_base has exactly one row per customer_id (deduplicated dimension
    joined 1:1 to the features), so ``count(DISTINCT customer_id)`` equals the
    row count and is computed as such (no distinct-aggregate expansion)."""
    base = segment_base(features, dim)
    churn = F.coalesce(F.col("churn_proxy"), F.lit(False))
    n = F.count(F.lit(1))
    complaint = (F.col("ticket_count") > 0) & ((F.col("tickets_urgent") > 0) | (F.col("tickets_bug") > 0)
                                               | (F.col("tickets_billing") > 0))
    agg = base.groupingSets(
        [[F.col("customer_segment")], [F.col("subscription_plan")], []], "customer_segment", "subscription_plan"
    ).agg(
        F.grouping("customer_segment").alias("_g_seg"), F.grouping("subscription_plan").alias("_g_plan"),
        n.alias("customers"),
        F.sum("monthly_revenue").alias("revenue"),
        F.count_if(F.col("monthly_revenue").isNotNull()).alias("revenue_customers"),
        F.count_if(F.col("ticket_count") > 0).alias("customers_with_tickets"),
        F.sum("ticket_count").alias("ticket_count"),
        (F.count_if(complaint) * F.lit(1.0) / F.when(n != 0, n)).alias("complaint_rate"),
        F.avg("average_resolution_time_hours").alias("average_resolution_time_hours"),
        F.avg("average_satisfaction_score").alias("average_satisfaction_score"),
        F.count_if(churn).alias("_churn"),
        (F.count_if(churn) * F.lit(1.0) / F.when(n != 0, n)).alias("cancel_rate"),
    )
    is_global = (F.col("_g_seg") == 1) & (F.col("_g_plan") == 1)
    everything = Window.partitionBy()

    def glob(c):
        return F.max(F.when(is_global, F.col(c))).over(everything)

    out = agg.select(
        "*", glob("customers").alias("global_customers"), glob("revenue").alias("global_revenue"),
        glob("average_resolution_time_hours").alias("global_average_resolution"),
        glob("average_satisfaction_score").alias("global_average_satisfaction"),
        glob("_churn").alias("global_churn"))
    gc = F.col("global_customers")
    return out.filter(~is_global).select(
        F.when(F.col("_g_seg") == 0, F.col("customer_segment")).alias("segment"),
        F.when(F.col("_g_plan") == 0, F.col("subscription_plan")).alias("plan"),
        "customers", "revenue", "revenue_customers", "customers_with_tickets", "ticket_count",
        "complaint_rate", "average_resolution_time_hours", "average_satisfaction_score", "cancel_rate",
        "global_customers", "global_revenue", "global_average_resolution", "global_average_satisfaction",
        "global_churn", (F.col("global_churn") * F.lit(1.0) / F.when(gc != 0, gc)).alias("global_cancel_rate"),
    ).orderBy(F.asc_nulls_last("segment"), F.asc_nulls_last("plan"))


def pivot_driver() -> list[tuple[str, str, str]]:
    """B13 rows (column_kind, value, column_name) — see operators/config.py for the frame."""
    rows = [("category", c, "tickets_" + c.replace(" ", "_")) for c, _ in TICKET_CATEGORIES]
    rows += [("priority", p, "tickets_" + p.replace(" ", "_")) for p, _ in TICKET_PRIORITIES]
    rows += [("status", s, "tickets_" + s.replace(" ", "_")) for s, _ in TICKET_STATUSES]
    rows += [("event_type", e, e.replace(" ", "_")) for e, _ in EVENT_TYPES]
    return rows
