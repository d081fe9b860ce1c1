"""Driver tables: one parquet file per table under an sf directory."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from churnlens.sources.snapshots import Snapshots

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Lazy accessors; a DataFrame is only a plan, so column pruning and
    predicate pushdown reach the parquet scan for whatever a query selects."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)


WAREHOUSE_CONF = "churnlens.warehouse"
WAREHOUSE_SOURCE_CONF = "churnlens.warehouse.source"
# tables the build job materialises (plans/build.py); read back as parquet
WAREHOUSE_TABLES = ("clean_customers", "audit_customers", "clean_tickets", "audit_tickets", "audit_feedback",
                    "dimension_customer",
                    "fact_ticket",
                    "fact_feedback", "fact_usage", "fact_subscription_event", "aggregate_theme",
                    "customer_features", "segment_metrics", "vector_store", "questions", "answers")


def source_mark(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the source folder: its total size and number of files, and name, size and time of each table in it.

    One summary and one listing of the folder itself, however many files its tables hold; a table's
    folder changes its time when a file in it is added, removed or replaced.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = sf_dir.rstrip("/")
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    whole = fs.getContentSummary(root)
    seen = [f"{whole.getLength()} {whole.getFileCount()} {whole.getDirectoryCount()}"]
    seen += sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(root))
    return f"{folder} {hashlib.sha256(chr(10).join(seen).encode()).hexdigest()}"


def warehouse_for(spark: SparkSession, sf_dir: str) -> str | None:
    """The registered warehouse path, if it was built from ``sf_dir`` as it is now."""
    path = spark.conf.get(WAREHOUSE_CONF, None)
    src = spark.conf.get(WAREHOUSE_SOURCE_CONF, None)
    return path if path and src and src == source_mark(spark, sf_dir) else None


class Model:
    """All derived frames of one run (raw -> clean -> star -> aggregates).

    Every property is a plan built once per Model; nothing is collected. With
    ``warehouse`` the materialised tables are read from parquet instead.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, warehouse: str | None = None,
                 tables: tuple[str, ...] = WAREHOUSE_TABLES):
        self.spark = spark
        self.t = Tables(spark, sf_dir)
        self.warehouse = warehouse if tables == WAREHOUSE_TABLES else None
        self._stored = {name: f"{warehouse.rstrip('/')}/{name}" for name in tables} if warehouse else {}

    def __getattribute__(self, name: str):
        # a materialised table is read (once, lazily) instead of derived again
        stored = object.__getattribute__(self, "__dict__").get("_stored", {})
        if name in stored:
            cache = object.__getattribute__(self, "__dict__")
            if name not in cache:
                cache[name] = Snapshots(object.__getattribute__(self, "spark"), stored[name]).read()
            return cache[name]
        return object.__getattribute__(self, name)

    @cached_property
    def turns(self) -> DataFrame:
        """The conversations, and the questions of the customers' log."""
        from churnlens.sources.logs import turn_log
        return turn_log(self.t)

    @cached_property
    def questions(self) -> DataFrame:
        """User turns, classified, routed and tagged with the requested metric (H1-H8) —
        shared by H, F2, G11 and J."""
        from churnlens.operators.intents import tag_questions
        return tag_questions(self.turns)

    @cached_property
    def answers(self) -> DataFrame:
        """Structured answers (JSON text): the customers' log, and assistant/system turns shaped as answers."""
        from churnlens.operators.evaluation import answers
        from churnlens.sources.logs import answer_log
        return answers(self.t.conversations).unionByName(answer_log(self.t))

    @cached_property
    def calls(self) -> DataFrame:
        """Tool calls with their arguments: those of the questions' nodes, and the customers' log."""
        from churnlens.operators.evaluation import tool_calls
        from churnlens.sources.logs import call_log
        return tool_calls(self.questions).unionByName(call_log(self.t))

    @cached_property
    def vector_store(self) -> DataFrame:
        """Latest-per-record chunk vectors (built by the warehouse job)."""
        from churnlens.operators import vectors
        chunks = vectors.with_hash(vectors.chunks_all(self))
        return vectors.store_rows(vectors.embed(chunks, embedded_at="2024-03-01"))

    # -- raw inputs (with defects), mapped from the driver tables ------------
    @cached_property
    def raw_customers(self) -> DataFrame:
        from churnlens.sources.raw import raw_customers
        return raw_customers(self.t)

    @cached_property
    def raw_tickets(self) -> DataFrame:
        from churnlens.sources.raw import raw_tickets
        return raw_tickets(self.t)

    @cached_property
    def raw_usage(self) -> DataFrame:
        from churnlens.sources.raw import raw_usage
        return raw_usage(self.t)

    @cached_property
    def raw_feedback(self) -> DataFrame:
        from churnlens.sources.raw import raw_feedback
        return raw_feedback(self.t)

    @cached_property
    def raw_subs(self) -> DataFrame:
        from churnlens.sources.raw import raw_subs
        return raw_subs(self.t)

    # -- clean tables ----------------------------------------------------------
    @cached_property
    def clean_customers(self) -> DataFrame:
        from churnlens.operators.cleanse import clean_customers
        return clean_customers(self.raw_customers)

    @cached_property
    def audit_customers(self) -> DataFrame:
        from churnlens.operators.cleanse import staging_audit_customers
        return staging_audit_customers(self.raw_customers)

    @cached_property
    def audit_feedback(self) -> DataFrame:
        from churnlens.operators.cleanse import staging_audit_feedback
        return staging_audit_feedback(self.raw_feedback)

    @cached_property
    def clean_tickets(self) -> DataFrame:
        from churnlens.operators.cleanse import clean_tickets
        return clean_tickets(self.raw_tickets)

    @cached_property
    def audit_tickets(self) -> DataFrame:
        from churnlens.operators.cleanse import staging_audit_tickets
        return staging_audit_tickets(self.raw_tickets)

    @cached_property
    def clean_feedback(self) -> DataFrame:
        from churnlens.operators.cleanse import clean_feedback
        return clean_feedback(self.raw_feedback)

    @cached_property
    def clean_usage(self) -> DataFrame:
        from churnlens.operators.cleanse import clean_pass_through_usage
        return clean_pass_through_usage(self.raw_usage)

    @cached_property
    def clean_subs(self) -> DataFrame:
        from churnlens.operators.cleanse import clean_pass_through_subs
        return clean_pass_through_subs(self.raw_subs)

    # -- star schema -------------------------------------------------------------
    @cached_property
    def dimension_customer(self) -> DataFrame:
        from churnlens.operators.features import dimension_customer
        return dimension_customer(self.clean_customers)

    @cached_property
    def fact_ticket(self) -> DataFrame:
        from churnlens.operators.features import fact_ticket
        return fact_ticket(self.clean_tickets)

    @cached_property
    def fact_feedback(self) -> DataFrame:
        from churnlens.operators.features import fact_feedback
        return fact_feedback(self.clean_feedback)

    @cached_property
    def fact_usage(self) -> DataFrame:
        from churnlens.operators.features import fact_usage
        return fact_usage(self.clean_usage)

    @cached_property
    def fact_subscription_event(self) -> DataFrame:
        from churnlens.operators.features import fact_subscription_event
        return fact_subscription_event(self.clean_subs)

    @cached_property
    def theme_seed(self) -> DataFrame:
        """The rule rows that cleansing makes."""
        from churnlens.operators.text_rules import theme_rule_sql_table
        return theme_rule_sql_table(self.fact_feedback)

    @cached_property
    def theme_overlays(self) -> DataFrame:
        from churnlens.sources.logs import theme_overlays
        return theme_overlays(self.t, self.fact_feedback)

    @cached_property
    def aggregate_theme(self) -> DataFrame:
        """The served themes: the seed with its rule rows refreshed by the enrichment, other sources kept."""
        from churnlens.operators.text_rules import theme_overlay_refresh, theme_rule_enriched_table
        return theme_overlay_refresh(self.theme_seed.unionByName(self.theme_overlays),
                                     theme_rule_enriched_table(self.fact_feedback))

    @cached_property
    def customer_features(self) -> DataFrame:
        from churnlens.operators.features import customer_features
        return customer_features(self.dimension_customer, self.fact_ticket, self.fact_usage,
                                 self.fact_feedback, self.fact_subscription_event)

    @cached_property
    def segment_metrics(self) -> DataFrame:
        from churnlens.operators.features import segment_metrics
        return segment_metrics(self.customer_features, self.dimension_customer)
