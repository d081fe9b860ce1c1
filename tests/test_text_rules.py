"""Theme and sentiment lexicons (cases of the reference's unit tests)."""

from pyspark.sql import functions as F

from churnlens.operators.text_rules import sentiment_rule_enriched, theme_rule_enriched

THEMES = [
    ("The invoice was wrong", "billing"), ("The screen crashes and freezes", "product_quality"),
    ("Search is slow to find results", "search"), ("API integration failed", "integrations"),
    ("The dashboard chart looks wrong", "reporting"), ("Multi-user permissions for the team", "collaboration"),
    ("Setup docs and onboarding were great", "onboarding"), ("Mobile app on android", "mobile"),
    ("Everything is fast, no latency", "performance"), ("No idea what to say here", "other"), (None, "other"),
    ("It crashes on export", "integrations"), ("The dashboard crashes on load", "reporting"),
]
SENTIMENT = [
    ("Love the search feature", 2.0, "positive"), ("The invoice was terrible", 4.0, "negative"),
    ("It crashes constantly", None, "negative"), ("The search feature", 5.0, "positive"),
    ("The search feature", 1.0, "negative"), ("The search feature", 3.0, "neutral"), (None, 3.0, "neutral"),
    (None, None, "neutral"), ("Great API docs but slow support", 4.0, "mixed"),
]


def test_themes(spark):
    df = spark.createDataFrame(THEMES, "text string, expected string")
    out = df.select(theme_rule_enriched(F.col("text")).alias("got"), "expected").collect()
    assert [r.got for r in out] == [r.expected for r in out]


def test_sentiment(spark):
    df = spark.createDataFrame(SENTIMENT, "text string, rating double, expected string")
    out = df.select(sentiment_rule_enriched(F.col("text"), F.col("rating")).alias("got"), "expected").collect()
    assert [r.got for r in out] == [r.expected for r in out]
