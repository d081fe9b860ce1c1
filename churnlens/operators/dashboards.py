"""Dashboard feeds (K1-K7): KPI cards, top-10 charts, drill-downs, admin counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators import insights


def dash_kpis(m) -> DataFrame:
    """K1: MRR (rounded sum of active revenue), customers, churned, open tickets.
    Two global aggregates, each one row; combined through a scalar subquery."""
    d = m.dimension_customer
    st = F.col("account_status")
    cust = d.agg(
        F.round(F.sum(F.when(st == "active", F.col("monthly_revenue")).cast("decimal(18,2)")), 0)
        .cast("decimal(18,0)").alias("mrr"),
        F.count(F.lit(1)).alias("customers"),
        F.count_if(st.isin("canceled", "paused")).alias("churned"),
    )
    open_t = m.fact_ticket.agg(F.count_if(F.col("status") == "open").alias("n")).select("n").scalar()
    return cust.withColumn("open_tickets", open_t)


def dash_themes_top10(m) -> DataFrame:
    """K2: theme counts, top 10 (theme breaks count ties)."""
    return (m.aggregate_theme.groupBy("theme").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "theme").limit(10))


def dash_paused_top10(m) -> DataFrame:
    """K3: paused customers by revenue, NULLS LAST, 10 (id breaks ties)."""
    return (m.dimension_customer.filter(F.col("account_status") == "paused")
            .select("customer_id", "account_status", "monthly_revenue")
            .orderBy(F.desc_nulls_last("monthly_revenue"), "customer_id").limit(10))


def dash_tickets_by_category(m) -> DataFrame:
    """K4: ticket counts per category, descending."""
    return m.fact_ticket.groupBy("category").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))


# K5: drill-downs; without a customer id they run for every customer at once
def drill_profile(m, customer_id: str | None = None) -> DataFrame:
    d = m.dimension_customer
    return d if customer_id is None else d.filter(F.col("customer_id") == customer_id)


def drill_tickets(m, customer_id: str | None = None, limit: int = 20) -> DataFrame:
    t = m.fact_ticket.select("customer_id", "ticket_id", "created_at", "category", "priority", "status", "subject")
    order = [F.desc("created_at"), F.asc("ticket_id")]
    if customer_id is not None:
        return t.filter(F.col("customer_id") == customer_id).orderBy(*order).limit(limit)
    return insights.top_n_per_key(t, "customer_id", order, limit)


def drill_feedback(m, customer_id: str | None = None, limit: int = 20) -> DataFrame:
    f = m.fact_feedback.select("customer_id", "feedback_id", "created_at", "feedback_text", "rating")
    order = [F.desc("created_at"), F.asc("feedback_id")]
    if customer_id is not None:
        return f.filter(F.col("customer_id") == customer_id).orderBy(*order).limit(limit)
    return insights.top_n_per_key(f, "customer_id", order, limit)


def drill_usage(m, customer_id: str | None = None, limit: int = 60) -> DataFrame:
    u = m.fact_usage.select("customer_id", "date", "sessions", "active_users")
    if customer_id is not None:
        return u.filter(F.col("customer_id") == customer_id).orderBy("date").limit(limit)
    return insights.top_n_per_key(u, "customer_id", [F.asc("date")], limit)


def admin_status(m, vector_meta: DataFrame | None = None, memory: DataFrame | None = None,
                 traces: DataFrame | None = None) -> DataFrame:
    """K6: row counts of the audit, vector meta, memory and trace stores."""
    parts = [insights_count("quality_report", _quality(m))]
    if vector_meta is not None:
        parts.append(insights_count("embedding_meta", vector_meta))
    if memory is not None:
        parts.append(insights_count("agent_memory", memory))
    if traces is not None:
        parts.append(insights_count("traces", traces))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _quality(m) -> DataFrame:
    from churnlens.operators.cleanse import quality_report
    return quality_report(m)


def insights_count(item: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(item).alias("item"), "n")


# K7: chart / table feeds
def series_usage(m) -> DataFrame:
    """Sessions over time per customer; NULL -> 0, date as text."""
    u = insights.usage_trend(m)
    return u.select("customer_id", F.col("date").cast("string").alias("date"),
                    F.coalesce(F.col("sessions"), F.lit(0)).alias("sessions"),
                    F.coalesce(F.col("active_users"), F.lit(0)).alias("active_users"))


def series_themes(m) -> DataFrame:
    t = insights.feedback_themes(m)
    return t.select("theme", F.coalesce(F.col("feedback_count"), F.lit(0)).alias("count")) \
        .orderBy(F.desc("count"), "theme").limit(10)


def table_risk(m) -> DataFrame:
    """Top-10 risk rows; drivers joined with ', ' and cut to 80 characters."""
    r = insights.rank_customer_risk(m, limit=10)
    return r.select("customer_id", "risk_score", F.col("account_status").alias("status"),
                    F.substring(F.array_join("risk_drivers", ", "), 1, 80).alias("drivers"))


def table_usage_change(m) -> DataFrame:
    """The usage change of the first 10 customers; missing numbers are 0."""
    z = F.lit(0)
    u = insights.usage_change(m).orderBy("customer_id").limit(10)
    return u.select("customer_id", F.coalesce("sessions_last_4_weeks", z).alias("last_4_weeks"),
                    F.coalesce("sessions_previous_4_weeks", z).alias("previous_4_weeks"),
                    F.round(F.coalesce("sessions_change_percent", F.lit(0.0)), 1).alias("change_pct"))


def cards_revenue(m, segment: str | None = None) -> DataFrame:
    """KPI cards of the revenue at risk: label and value as shown."""
    r = insights.revenue_at_risk(m, segment)
    cards = F.array(F.struct(F.lit("Revenue at risk").alias("label"), F.concat(
        F.lit("$"), F.format_number(F.bround("revenue_at_risk", 0), 0)).alias("value")),
        F.struct(F.lit("At-risk customers").alias("label"), F.col("at_risk_customers").cast("string").alias("value")))
    return r.select(F.explode(cards).alias("c")).select("c.*")


def table_tickets(m) -> DataFrame:
    """Recent tickets per customer (10), created_at cut to the date's 10 chars."""
    t = insights.customer_tickets(m, limit=10)
    return t.select("customer_id", "ticket_id", F.substring(F.col("created_at").cast("string"), 1, 10)
                    .alias("created_at"), "category", "priority", "status")
