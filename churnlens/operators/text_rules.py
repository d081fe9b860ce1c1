"""Feedback themes and sentiment (C3-C7) as native Column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.lexicons import (SENTIMENT_NEGATIVE, SENTIMENT_POSITIVE, SENTIMENT_SQL_NEGATIVE,
                                          SENTIMENT_SQL_POSITIVE, THEMES_ENRICHED, THEMES_SQL)
from churnlens.functions.rules import first_match, matches


def theme_rule_sql(text: Column) -> Column:
    """First lexicon hit on lower(text); NULL text falls through to 'other'."""
    return first_match(F.lower(text), THEMES_SQL, "other")


def sentiment_rule_sql(text: Column) -> Column:
    """C4: positive words first, then negative, else neutral."""
    return _sentiment_sql(F.lower(text))


def _sentiment_sql(low: Column) -> Column:
    return (F.when(matches(low, SENTIMENT_SQL_POSITIVE), "positive")
            .when(matches(low, SENTIMENT_SQL_NEGATIVE), "negative").otherwise("neutral"))


def theme_rule_enriched(text: Column, low: Column | None = None) -> Column:
    """Same lexicon with 'itemized' in billing; empty/NULL -> other. ``low``: the text in lower case, if at hand."""
    low = F.lower(text) if low is None else low
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("other")).otherwise(first_match(low, THEMES_ENRICHED, "other"))


def sentiment_rule_enriched(text: Column, rating: Column, low: Column | None = None) -> Column:
    """Keywords first (pos only / neg only / both -> mixed); else the rating
    (<=2 negative, >=4 positive, else neutral); NULL rating -> neutral."""
    low = F.lower(text) if low is None else low
    has_text = F.coalesce(text, F.lit("")) != ""
    pos = has_text & matches(low, SENTIMENT_POSITIVE)
    neg = has_text & matches(low, SENTIMENT_NEGATIVE)
    by_rating = (F.when(rating.isNull(), "neutral").when(rating <= 2, "negative")
                 .when(rating >= 4, "positive").otherwise("neutral"))
    return (F.when(pos & ~neg, "positive").when(neg & ~pos, "negative").when(pos & neg, "mixed")
            .otherwise(by_rating))


def theme_rule_sql_table(fact_feedback: DataFrame) -> DataFrame:
    """aggregate_theme seed (source='rule') from the SQL lexicon."""
    low = F.col("_low")
    rows = fact_feedback.select("feedback_id", "customer_id", "created_at", F.col("feedback_text").alias("text"),
                                F.lower("feedback_text").alias("_low"))
    return rows.select("feedback_id", "customer_id", "created_at", "text", first_match(low, THEMES_SQL, "other").alias("theme"),
                       _sentiment_sql(low).alias("sentiment"), F.lit("rule").alias("source"))


def theme_rule_enriched_table(fact_feedback: DataFrame) -> DataFrame:
    """Enrichment pass (source='rule') from the larger lexicon."""
    text, low = F.col("text"), F.col("_low")
    # lower-cased once, in a projection of its own: ten patterns read it
    rows = fact_feedback.select("feedback_id", "customer_id", "created_at", F.col("feedback_text").alias("text"), "rating",
                                F.lower("feedback_text").alias("_low"))
    return rows.select("feedback_id", "customer_id", "created_at", "text", theme_rule_enriched(text, low).alias("theme"),
                       sentiment_rule_enriched(text, F.col("rating"), low).alias("sentiment"), F.lit("rule").alias("source"))


def theme_overlay_refresh(existing: DataFrame, fresh_rule_rows: DataFrame) -> DataFrame:
    """Replace source='rule' rows, keep the others (e.g. 'llm' overlays).
    Written partitioned by ``source`` this is a single-partition overwrite."""
    return existing.filter(F.col("source") != "rule").unionByName(fresh_rule_rows)
