"""Compile the fixed lexicons into native Column expressions (no Python UDFs).

Every rule is a chain of ``when``/``rlike``/``contains`` evaluated inside whole-
stage codegen, so a rule costs the same per row on 60 rows or 60 billion.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_characters(pattern: str) -> set[str]:
    """The characters that a match can start with. A pattern starts with a plain character, or with a
    group of alternatives that each do."""
    starts = pattern[1:pattern.index(")")].split("|") if pattern.startswith("(") else [pattern]
    if not all(s and (s[0].isalnum() or s[0] in "<>#@ ") for s in starts):
        raise ValueError(f"no plain first character: {pattern}")
    return {c for s in starts for c in (s[0].lower(), s[0].upper())}


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found in ``text``. A group of plain words is looked for word by word, which passes over a
    long text many times faster than the alternatives tried at each character; other patterns are tried only at
    characters that an alternative starts with."""
    words = pattern[1:-1].split("|")
    if pattern == f"({'|'.join(words)})" and all(re.fullmatch("[a-z -]+", w) for w in words):
        return reduce(Column.__or__, [text.contains(w) for w in words])
    return text.rlike(f"(?=[{''.join(sorted(first_characters(pattern)))}])(?:{pattern})")


def first_match(text: Column, lexicon: list[tuple[str, str]], default: str) -> Column:
    """First pattern that matches ``text`` names the label; NULL text -> default."""
    out = None
    for label, pattern in lexicon:
        cond = matches(text, pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def count_contained(text: Column, words: list[str]) -> Column:
    """Number of keywords that occur as substrings (no word boundaries).

    One higher-order ``filter`` over a literal array keeps the expression tree
    small however long the list is (a chain of additions would be inlined and
    canonicalised again at every reference)."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w)))


# ---------------------------------------------------------------------------
# Risk score (E3) and drivers
# ---------------------------------------------------------------------------
# Composite risk weights
RISK_WEIGHTS = {
    "churn_proxy": 30.0,
    "sessions_decline": 25.0,
    "tickets_open": 15.0,
    "tickets_urgent": 15.0,
    "low_satisfaction": 10.0,
    "no_recent_usage": 5.0,
}


def _capped_half(c: Column) -> Column:
    return F.least(F.coalesce(c, F.lit(0)).cast("long"), F.lit(2)) / 2.0


def risk_score(churn: Column = None, change: Column = None, open_: Column = None, urgent: Column = None,
               sat: Column = None, last4: Column = None) -> Column:
    """0..100 score; all terms are multiples of 2.5 so round(…, 1) is exact."""
    churn = F.col("churn_proxy") if churn is None else churn
    change = F.col("sessions_change_percent") if change is None else change
    open_ = F.col("tickets_open") if open_ is None else open_
    urgent = F.col("tickets_urgent") if urgent is None else urgent
    sat = F.col("average_satisfaction_score") if sat is None else sat
    last4 = F.col("sessions_last_4_weeks") if last4 is None else last4
    w = RISK_WEIGHTS
    score = (F.when(F.coalesce(churn, F.lit(False)), w["churn_proxy"]).otherwise(0.0)
             + F.when(change < -20.0, w["sessions_decline"]).otherwise(0.0)
             + w["tickets_open"] * _capped_half(open_)
             + w["tickets_urgent"] * _capped_half(urgent)
             + F.when(sat < 3.0, w["low_satisfaction"]).otherwise(0.0)
             + F.when(last4.isNull() | (last4 == 0), w["no_recent_usage"]).otherwise(0.0))
    return F.round(F.least(score, F.lit(100.0)), 1)


def risk_drivers(status: Column = None) -> Column:
    """Reasons in fixed order. A NULL satisfaction counts as low here (but adds
    no score), as in the reference. Percent is formatted with half-even
    rounding like Python's ``format(x, '.0f')``."""
    status = F.col("account_status") if status is None else status
    change = F.col("sessions_change_percent")
    open_ = F.col("tickets_open")
    urgent = F.col("tickets_urgent")
    sat = F.col("average_satisfaction_score")
    last4 = F.col("sessions_last_4_weeks")
    pct = F.bround(change, 0).cast("long").cast("string")
    items = F.array(
        F.when(F.coalesce(F.col("churn_proxy"), F.lit(False)), F.concat(F.lit("status="), status)),
        F.when(change < -20.0, F.concat(F.lit("sessions "), pct, F.lit("% vs prior 4wk"))),
        F.when(F.coalesce(open_, F.lit(0)) != 0, F.concat(open_.cast("string"), F.lit(" open tickets"))),
        F.when(F.coalesce(urgent, F.lit(0)) != 0, F.concat(urgent.cast("string"), F.lit(" urgent tickets"))),
        F.when(F.coalesce(sat, F.lit(0.0)) < 3.0, F.lit("low avg satisfaction (<3)")),
        F.when(last4.isNull() | (last4 == 0), F.lit("no usage in last 4 weeks")),
    )
    return F.filter(items, lambda x: x.isNotNull())
