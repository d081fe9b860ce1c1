"""Key-value memory and conversation windows.

The memory store is an append-only log ``(key, value, updated_at)``; "insert
or replace" is the latest row per key, computed with ``max_by`` (partial
aggregation, so a hot key is reduced map-side). Session windows are bounded
per conversation with ``row_number() <= n`` (WindowGroupLimit before the
shuffle), so no conversation is ever collected whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_MESSAGES = 20
PROMPT_TURNS = 6
SUMMARY_KEY = "last_session"


def memory_log(conversations: DataFrame) -> DataFrame:
    """Writes derived from the conversation log: every assistant turn stores
    its text under the conversation's key; the turn orders the writes."""
    c = conversations.filter(F.col("role") == "assistant")
    return c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("key"),
                    F.col("text").alias("value"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                     + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("updated_at"))


def upsert_latest(log: DataFrame) -> DataFrame:
    """One row per key, the latest write wins (ties: larger value).
    ``row_number() = 1`` per key: a WindowGroupLimit keeps one row per key per
    map task before the shuffle, so a hot key does not pile up in one task."""
    w = Window.partitionBy("key").orderBy(F.desc("updated_at"), F.desc("value"))
    return (log.select("key", "value", "updated_at").withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def read(memory: DataFrame, keys: DataFrame) -> DataFrame:
    """I2 batch form: each requested key with its value, NULL when absent."""
    return keys.join(memory, "key", "left").select("key", "value", "updated_at")


def list_all(memory: DataFrame) -> DataFrame:
    """All entries, newest first."""
    return memory.orderBy(F.desc("updated_at"), "key")


def _session(conversations: DataFrame) -> DataFrame:
    # session memory holds the user and assistant messages
    return conversations.filter(F.col("role").isin("user", "assistant"))


def session_window(conversations: DataFrame, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """I4: the last ``max_messages`` messages of every conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (_session(conversations).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= max_messages).drop("_rn"))


def session_prompt_window(conversations: DataFrame, turns: int = PROMPT_TURNS) -> DataFrame:
    """Last ``turns`` messages as 'role: content' lines, oldest first."""
    last = session_window(conversations, turns)
    return last.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))),
        lambda s: s["line"]), "\n").alias("conversation"))


def session_summary(conversations: DataFrame) -> DataFrame:
    """I6: 'questions=N; last_question=<first 200 chars>' per conversation."""
    s = _session(conversations)
    user = F.col("role") == "user"
    last_q = F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn")))
    return s.groupBy("conv_id").agg(F.count_if(user).alias("n"), last_q.alias("q")).select(
        "conv_id", F.lit(SUMMARY_KEY).alias("key"),
        F.concat(F.lit("questions="), F.col("n").cast("string"), F.lit("; last_question="),
                 F.substring(F.coalesce(F.col("q"), F.lit("")), 1, 200)).alias("value"))
