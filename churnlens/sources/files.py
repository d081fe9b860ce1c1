"""File sources and sinks.

Every write goes below a base folder the caller passes; on a cluster that is
the shared folder named by ``spark.checkpoint.dir`` (see session.scratch_path),
never a machine-local temp folder. Writes are whole-job commits: a lost
executor retries its tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Explicit schemas of the five raw CSV inputs: inference is a full extra scan
# at scale and is not stable across files.
RAW_CSV_SCHEMAS = {
    "customers": ("customer_id string, customer_name string, customer_segment string, country string, "
                  "subscription_plan string, monthly_revenue double, account_created_at string, "
                  "account_status string"),
    "support_tickets": ("ticket_id string, customer_id string, created_at timestamp_ntz, subject string, "
                        "message string, category string, priority string, resolution_time_hours double, "
                        "status string, satisfaction_score double"),
    "product_usage": ("customer_id string, date date, active_users bigint, sessions bigint, feature_usage string, "
                      "errors bigint, average_session_duration double"),
    "customer_feedback": ("feedback_id string, customer_id string, created_at timestamp_ntz, feedback_text string, "
                          "feedback_source string, rating bigint"),
    "subscription_events": ("customer_id string, event_date date, event_type string, previous_plan string, "
                            "new_plan string, revenue_change double"),
}
# inputs with free text, which may hold line breaks inside quotes
TEXTUAL = ("support_tickets", "customer_feedback")
# inputs whose cleansing depends on the order of their rows
ORDERED = ("customers", "support_tickets", "subscription_events")


def read_raw_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A1, A2: headered CSV with an explicit schema (no inference). Inputs whose row
    order matters get ``_input_row_number``, a struct that orders as the rows stand: file,
    start of the split in it, and a number that rises within the split."""
    rows = (spark.read.schema(RAW_CSV_SCHEMAS[name]).option("header", True).option("multiLine", name in TEXTUAL).option("escape", '"')
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("mode", "FAILFAST").csv(path))
    if name not in ORDERED:
        return rows
    return rows.select("*", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row")).alias("_input_row_number"))


def write_csv(df: DataFrame, path: str) -> str:
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def overwrite_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """A4: idempotent rebuild that replaces the whole table. The new files are written
    beside the old table and take its place only once the write has succeeded, so a failed
    rebuild leaves the old table, and partitions that the new data lack are gone. The old table is moved aside and
    removed last: a crash between the two moves loses nothing, but leaves no table at ``path``. Tables that
    are served while they are rebuilt are snapshots instead (snapshots.py)."""
    new = unique_path(path.rstrip("/") + "-next", "v")
    w = df.write.partitionBy(*partition_by) if partition_by else df.write
    w.parquet(new)
    fs, target = _file_system(df.sparkSession, path)
    _, fresh = _file_system(df.sparkSession, new)
    old = None
    if fs.exists(target):
        _, old = _file_system(df.sparkSession, unique_path(path.rstrip("/") + "-previous", "v"))
        fs.mkdirs(old.getParent())
        if not fs.rename(target, old):
            raise OSError(f"{path} could not be moved aside")
    if not fs.rename(fresh, target):
        if old is not None:
            fs.rename(old, target)
        raise OSError(f"{new} could not take the place of {path}")
    if old is not None:
        fs.delete(old, True)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def append_rows(df: DataFrame, path: str) -> str:
    """A5: append one batch (vector + hash in the same rows) in one job commit."""
    df.write.mode("append").parquet(path)
    return path


def write_report_json(df: DataFrame, path: str) -> str:
    """The evaluation report as JSON lines (one file per task)."""
    df.write.mode("overwrite").json(path)
    return path


REPORT_QUESTION = ("conv_id bigint, turn bigint, passed_metrics int, total_metrics int, passed boolean, "
                   "metrics map<string, struct<passed: boolean, score: double, detail: string>>")


def write_report(overall: DataFrame, questions: DataFrame, path: str) -> str:
    """The whole report: ``overall`` (one row) and ``questions`` (a row each, metrics nested by name)."""
    write_report_json(questions, f"{path}/questions")
    write_report_json(overall, f"{path}/overall")
    return path


def unique_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
