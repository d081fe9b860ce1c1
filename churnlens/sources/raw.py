"""Map the driver tables to the five raw customer-insight inputs (with defects).

The mapping is defined in FIXTURES.md section 6. Each function is a pure plan:
narrow projections, one pre-aggregated join for tickets, and duplicates made by
``explode`` of a 1- or 2-element array (no join against a literal table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.sources.tables import Tables


def _padded_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 9, "0"))


def _dup_rev(cond: Column) -> Column:
    """0 for every row, plus a second copy (1) where ``cond`` holds."""
    return F.explode(F.when(cond, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))


def _case(key: Column, mapping: list[tuple[object, str]], default: str) -> Column:
    out = None
    for k, v in mapping:
        out = (F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v)))
    return out.otherwise(F.lit(default))


def raw_customers(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation is a fixed 25-row lookup: broadcasting it is bounded by definition
    n = F.broadcast(t.nation.select("n_nationkey", "n_name"))
    k = F.col("c_custkey")
    df = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).withColumn("rev", _dup_rev(k % 20 == 5))
    created = F.when(k % 50 == 7, F.lit("2024-13-05")).otherwise(
        F.concat(F.lit("2023-"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("-"),
                 F.lpad((1 + k % 28).cast("string"), 2, "0")))
    return df.select(
        _padded_id("CUST-", k).alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        _case(F.col("c_mktsegment"), [("AUTOMOBILE", "Enterprise"), ("BUILDING", "Mid-Market")], "SMB")
        .alias("customer_segment"),
        F.col("n_name").alias("country"),
        _case(k % 4, [(0, "Free"), (1, "Team"), (2, "Business")], "Enterprise").alias("subscription_plan"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("double"))
        .otherwise(F.col("c_acctbal") + F.lit(100.0) * F.col("rev")).alias("monthly_revenue"),
        created.alias("account_created_at"),
        _case(k % 10, [(0, "CANCELED"), (1, "paused"), (2, "Paused"), (3, "ACTIVE")], "active")
        .alias("account_status"),
        (2 * k + F.col("rev")).alias("_input_row_number"),
    )


def raw_tickets(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    # partial aggregation map-side: one row per order leaves each map task
    q = t.lineitem.groupBy("l_orderkey").agg(F.min("l_quantity").alias("q"))
    k = F.col("o_orderkey")
    df = o.join(q, F.col("l_orderkey") == k, "left").withColumn("rev", _dup_rev(k % 25 == 0))
    finished = F.col("o_orderstatus") == "F"
    return df.select(
        _padded_id("TCK-", k).alias("ticket_id"),
        _padded_id("CUST-", F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("Order "), k.cast("string")).alias("subject"),
        F.when(k % 6 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Total "), (k % 97).cast("string"))).alias("message"),
        _case(k % 8, [(0, "billing"), (1, "Bug"), (2, "feature_request"), (3, "general_question"),
                      (4, "Technical_issue"), (5, "onboarding"), (6, "account_access")], "unlisted")
        .alias("category"),
        _case(F.col("o_orderpriority"), [("1-URGENT", "Urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium")],
              "low").alias("priority"),
        F.when(finished, F.when(k % 13 == 0, -F.col("q")).otherwise(F.col("q"))).alias("resolution_time_hours"),
        _case(F.col("o_orderstatus"), [("O", "open"), ("P", "pending")], "resolved").alias("status"),
        F.when(finished, F.lit(1.0) + (k % 5)).alias("satisfaction_score"),
        (2 * k + F.col("rev")).alias("_input_row_number"),
    )


def raw_usage(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    day_offset = (2 * (F.dayofmonth("ts") - 1) + F.col("event_id") % 2).cast("int")
    keyed = e.select(
        _padded_id("CUST-", F.col("user_id")).alias("customer_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), day_offset).alias("date"),
        "event_type", "value",
    )
    # one collect_set of the (few) event types per (customer, day) gives both
    # the distinct count and the minimum in a hash-based aggregate; a plain
    # count_distinct would expand every row into a second aggregation level
    types = F.collect_set("event_type")
    return keyed.groupBy("customer_id", "date").agg(
        types.alias("_types"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).cast("bigint").alias("errors"),
        F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("average_session_duration"),
    ).select("customer_id", "date", F.size("_types").cast("bigint").alias("active_users"), "sessions",
             F.array_min("_types").alias("feature_usage"), "errors", "average_session_duration")


# Feedback text prefixes by doc_id % 9 (FIXTURES.md section 6)
FEEDBACK_PREFIXES = [
    "The invoice was wrong",
    "Search is slow to find results",
    "API integration failed",
    "The dashboard chart looks wrong",
    "Multi-user permissions for the team",
    "Setup docs and onboarding were great",
    "The screen crashes and freezes",
    "Everything is fast, no latency",
    "No idea what to say here",
]


def raw_feedback(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text", "source")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    # a document without an order is feedback of an unknown customer and date
    df = d.join(o, F.col("o_orderkey") == F.col("doc_id"), "left")
    k = F.col("doc_id")
    prefix = _case(k % 9, [(i, p) for i, p in enumerate(FEEDBACK_PREFIXES[:-1])], FEEDBACK_PREFIXES[-1])
    return df.select(
        _padded_id("FDB-", k).alias("feedback_id"),
        _padded_id("CUST-", F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).when(k % 50 == 49, F.lit("?!"))  # nothing to embed
        .otherwise(F.concat(prefix, F.lit(" "), F.coalesce(F.col("text"), F.lit(""))))
        .alias("feedback_text"),
        F.col("source").alias("feedback_source"),
        F.when(k % 9 == 0, F.lit(None).cast("bigint")).otherwise(k % 11).alias("rating"),
    )


# Subscription plans in upgrade order
PLAN_LADDER = ["Free", "Team", "Business", "Enterprise"]


def raw_subs(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag",
                           "l_linestatus", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey")
    df = li.join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    flag = F.col("l_returnflag")
    etype = (F.when(flag == "R", "cancellation").when(flag == "A", "downgrade")
             .when(F.col("l_linestatus") == "O", "upgrade").otherwise("renewal"))
    idx = F.col("l_linenumber") % 4
    new_idx = (F.when(etype == "upgrade", F.least(idx + 1, F.lit(3)))
               .when(etype == "downgrade", F.greatest(idx - 1, F.lit(0)))
               .when(etype == "cancellation", F.lit(0)).otherwise(idx))
    ladder = F.array(*[F.lit(p) for p in PLAN_LADDER])
    return df.select(
        _padded_id("CUST-", F.col("o_custkey")).alias("customer_id"),
        F.col("l_shipdate").cast("date").alias("event_date"),
        etype.alias("event_type"),
        F.element_at(ladder, (idx + 1).cast("int")).alias("previous_plan"),
        F.element_at(ladder, (new_idx + 1).cast("int")).alias("new_plan"),
        (F.col("l_extendedprice") * F.when(flag.isin("R", "A"), -1).otherwise(1)).alias("revenue_change"),
        (10 * F.col("l_orderkey") + F.col("l_linenumber")).alias("_input_row_number"),
    )
