"""Shared fixtures: one local session and the reference's inline raw rows."""

from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from churnlens.sources.tables import Model  # noqa: E402

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[4]").appName("churnlens-tests")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="churnlens-test-ckpt-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    yield spark


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


class FixtureModel(Model):
    """Model whose raw inputs are the five small CSVs of the reference tests."""

    def __init__(self, spark):
        super().__init__(spark, SF0001)
        c = spark.createDataFrame
        self.__dict__["raw_customers"] = c([
            ("CUST-0001", "Alpha", "Mid-Market", "France", "Business", 1000.0, "2023-01-01", "ACTIVE", 1),
            ("CUST-0001", "Alpha", "Mid-Market", "France", "Business", 1100.0, "2023-01-01", "active", 2),
            ("CUST-0002", "Beta", "SMB", "Germany", "Team", None, "2024-02-02", "CANCELED", 3),
            ("CUST-0003", "Gamma", "Enterprise", "USA", "Enterprise", 2500.0, "2024-03-03", "paused", 4),
        ], "customer_id string, customer_name string, customer_segment string, country string, "
           "subscription_plan string, monthly_revenue double, account_created_at string, account_status string, "
           "_input_row_number bigint")
        self.__dict__["raw_tickets"] = c([
            ("TCK-0001", "CUST-0001", ts("2026-05-01 10:00"), "Bug", "It crashes.", "Bug", "High", 5.0, "resolved",
             4.0, 1),
            ("TCK-0001", "CUST-0001", ts("2026-05-01 10:00"), "Bug", "It crashes.", "Bug", "High", 5.0, "resolved",
             4.0, 2),
            ("TCK-0002", "CUST-0002", ts("2026-05-02 11:00"), "Question", None, "General_question", "low", None,
             "open", None, 3),
            ("TCK-0003", "CUST-0003", ts("2026-05-03 12:00"), "Neg time", "Weird.", "billing", "medium", -5.0,
             "resolved", 3.0, 4),
        ], "ticket_id string, customer_id string, created_at timestamp_ntz, subject string, message string, "
           "category string, priority string, resolution_time_hours double, status string, "
           "satisfaction_score double, _input_row_number bigint")
        self.__dict__["raw_feedback"] = c([
            ("FDB-0001", "CUST-0001", ts("2026-05-10 09:00"), "Love the search feature", "support_chat", 5),
            ("FDB-0002", "CUST-0002", ts("2026-05-11 09:00"), None, "email", 8),
            ("FDB-0003", "CUST-0003", ts("2026-05-12 09:00"), "Okay", "app_store_review", 3),
        ], "feedback_id string, customer_id string, created_at timestamp_ntz, feedback_text string, "
           "feedback_source string, rating bigint")
        self.__dict__["raw_usage"] = c([
            ("CUST-0001", d("2026-05-25"), 10, 100, "search", 1, 8.0),
            ("CUST-0001", d("2026-06-20"), 12, 150, "dashboards", 0, 9.0),
            ("CUST-0001", d("2026-06-25"), 15, 200, "reports", 2, None),
            ("CUST-0002", d("2026-05-25"), 5, 50, "api", 0, 4.0),
        ], "customer_id string, date date, active_users bigint, sessions bigint, feature_usage string, "
           "errors bigint, average_session_duration double")
        self.__dict__["raw_subs"] = c([
            ("CUST-0001", d("2026-07-01"), "upgrade", "Business", "Enterprise", 500.0, 1),
            ("CUST-0002", d("2026-07-02"), "cancellation", "Team", "Free", -200.0, 2),
        ], "customer_id string, event_date date, event_type string, previous_plan string, new_plan string, "
           "revenue_change double, _input_row_number bigint")


@pytest.fixture(scope="session")
def fx(spark):
    return FixtureModel(spark)


def one_col(spark, values, name="text", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")
