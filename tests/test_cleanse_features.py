"""Cleansing and feature values carried over from the reference's tests."""

from pyspark.sql import functions as F

from churnlens.operators import cleanse


def test_dedup_keeps_last_and_null_revenue(fx):
    rows = {r.customer_id: r for r in fx.dimension_customer.collect()}
    assert rows["CUST-0001"].monthly_revenue == 1100.0
    assert rows["CUST-0002"].monthly_revenue is None
    assert rows["CUST-0001"].account_status == "active"
    assert rows["CUST-0002"].account_status == "canceled"


def test_rating_scale_and_negative_clip(fx):
    fb = {r.feedback_id: r.rating for r in fx.fact_feedback.collect()}
    assert fb["FDB-0002"] == 4.0 and fb["FDB-0001"] == 5.0
    t = {r.ticket_id: r.resolution_time_hours for r in fx.fact_ticket.collect()}
    assert t["TCK-0003"] is None and t["TCK-0001"] == 5.0


def test_usage_windows(fx):
    r = fx.customer_features.filter(F.col("customer_id") == "CUST-0001").first()
    assert (r.sessions_last_4_weeks, r.sessions_previous_4_weeks, r.sessions_change_percent) == (350, 100, 250.0)


def test_row_counts(fx):
    counts = [fx.dimension_customer.count(), fx.fact_ticket.count(), fx.fact_feedback.count(),
              fx.fact_usage.count(), fx.fact_subscription_event.count(), fx.customer_features.count(),
              fx.aggregate_theme.count()]
    assert counts == [3, 3, 3, 4, 2, 3, 3]


def test_churn_proxy_and_cancellations(fx):
    rows = {r.customer_id: (r.churn_proxy, r.cancellations) for r in fx.customer_features.collect()}
    assert rows["CUST-0001"] == (False, 0)
    assert rows["CUST-0002"] == (True, 1)


def test_theme_seed(fx):
    r = fx.aggregate_theme.filter(F.col("feedback_id") == "FDB-0001").first()
    assert (r.theme, r.sentiment, r.source) == ("search", "positive", "rule")


def test_quality_report_counts(fx):
    rep = {(r.rule, r.table_name): r["count"] for r in cleanse.quality_report(fx).collect()}
    assert len(rep) == 19
    assert rep[("deduplicate_customers", "customers")] == 1
    assert rep[("normalize_account_status", "customers")] == 2
    assert rep[("null_revenue_kept", "customers")] == 1
    assert rep[("deduplicate_tickets", "support_tickets")] == 1
    assert rep[("normalize_category", "support_tickets")] == 3
    assert rep[("clip_negative_resolution", "support_tickets")] == 1
    assert rep[("normalize_rating_scale", "customer_feedback")] == 1
    assert rep[("null_feedback_text_kept", "customer_feedback")] == 1
    assert rep[("null_session_duration_kept", "product_usage")] == 1
    assert rep[("pass_through", "subscription_events")] == 2


def test_segment_metrics_shape(fx):
    rows = fx.segment_metrics.collect()
    segs = [r.segment for r in rows if r.segment is not None]
    plans = [r.plan for r in rows if r.plan is not None]
    assert sorted(segs) == ["Enterprise", "Mid-Market", "SMB"]
    assert sorted(plans) == ["Business", "Enterprise", "Team"]
    assert all(r.global_customers == 3 for r in rows)
    # rows come ordered segment NULLS LAST, plan NULLS LAST
    assert rows[-1].segment is None and rows[0].segment is not None
