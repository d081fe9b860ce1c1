"""The batch build (the reference's build path): raw inputs -> clean tables ->
star schema -> features, segment benchmarks, themes and the vector store,
each written once as parquet. Serving queries then read these tables.

Customer tables are range-partitioned and sorted by ``customer_id`` and time, so
parquet min/max statistics let per-customer drill-downs skip files and row groups, and one
customer's rows can fill several files. Range partitioning samples its input, so a table is
derived once into a staging folder and clustered from the written files.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import scratch_path
from churnlens.sources import files
from churnlens.sources.snapshots import WHOLE, Snapshots
from churnlens.sources.tables import WAREHOUSE_CONF, WAREHOUSE_SOURCE_CONF, WAREHOUSE_TABLES, Model, source_mark

CLUSTER = {"fact_ticket": ("customer_id", "created_at", "ticket_id"),
           "fact_feedback": ("customer_id", "created_at", "feedback_id"),
           "fact_usage": ("customer_id", "date"), "fact_subscription_event": ("customer_id", "event_date"),
           "customer_features": ("customer_id",), "dimension_customer": ("customer_id",),
           "aggregate_theme": ("customer_id", "feedback_id")}


# build order: each stage reads the tables the previous stages wrote, so no
# table is derived twice and every stage's lineage starts at parquet files
STAGES = (
    ("clean_customers", "audit_customers", "clean_tickets", "audit_tickets", "audit_feedback"),
    ("dimension_customer", "fact_ticket", "fact_feedback", "fact_usage", "fact_subscription_event"),
    ("aggregate_theme", "customer_features", "vector_store", "questions", "answers"),
    ("segment_metrics",),
)


# tables whose rows come from several sources: each is a part that is rebuilt alone, and parts of sources
# that the build doesn't know stay
SOURCES = {"aggregate_theme": ("rule", "llm")}


def _write(df: DataFrame, path: str, name: str) -> None:
    table = Snapshots(df.sparkSession, f"{path}/{name}")
    for source in SOURCES.get(name, (WHOLE,)):
        rows = df if source == WHOLE else df.where(F.col("source") == source)
        if name in CLUSTER:
            staged = files.unique_path(f"{path}/_staged", name)
            files.overwrite_table(rows, staged)
            keys = CLUSTER[name]
            written = df.sparkSession.read.parquet(staged)
            table.replace_part(written.repartitionByRange(*keys).sortWithinPartitions(*keys), source)
            files.remove(df.sparkSession, staged)
        else:
            table.replace_part(rows, source)


def build_warehouse(spark: SparkSession, sf_dir: str, path: str | None = None, register: bool = True) -> str:
    path = path or files.unique_path(scratch_path(spark, "warehouse"), "build")
    done: tuple[str, ...] = ()
    source = source_mark(spark, sf_dir)
    for stage in STAGES:
        m = Model(spark, sf_dir, warehouse=path, tables=done)

        plans = {}
        for name in stage:  # plans are built here, on one thread
            plans[name] = getattr(m, name)
        # the tables of one stage are independent: submit their jobs together
        # so small jobs share the executors instead of queueing one by one
        with ThreadPoolExecutor(max_workers=len(stage)) as pool:
            futures = [pool.submit(_write, df, path, name) for name, df in plans.items()]
            for f in futures:
                f.result()
        done = done + stage
    assert set(done) == set(WAREHOUSE_TABLES)
    if register:
        spark.conf.set(WAREHOUSE_CONF, path)
        spark.conf.set(WAREHOUSE_SOURCE_CONF, source)
    return path
