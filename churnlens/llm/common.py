"""Helpers shared by the operators: input tables, shared folders, stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir

# What the contracts call white space and words
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_name(start: str) -> str:
    """``start`` with a new id behind it."""
    return f"{start}{uuid.uuid4().hex[:12]}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that the cluster names."""
    return shared_name(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-")


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that :func:`stored` writes inside, at the end; what is kept must be complete by then."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage (a lost executor costs no recomputation), fixes row ids
    made by monotonically_increasing_id, and gives the planner the true size, so
    that it broadcasts the table only while it is below the session's threshold.
    """
    path = shared_folder(df.sparkSession, name)
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it if ``docs`` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _plain_scan(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a Parquet file: a scan under nothing but projections and filters."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    hidden = plan.metadataOutput()
    return (plan.nodeName() == "LogicalRelation" and not hidden.isEmpty()
            and "row_index" in hidden.head().dataType().simpleString())


def row_keyed(docs: DataFrame, name: str, key: str) -> DataFrame:
    """``docs`` with ``key``, a struct that names each row the same in every scan.

    It is the row's file and its place in the file, however scans split and pack files, so steps that
    meet again on it need no second copy of the documents. Documents that are not a plain scan are
    written first, once.
    """
    if not _plain_scan(docs):
        docs = stored(docs, name)
    at = docs.metadataColumn("_metadata")
    return docs.select("*", F.struct(at["file_path"].alias("file"), at["row_index"].alias("row")).alias(key))


def nested(docs: DataFrame, name: str) -> DataFrame:
    """``doc``, a struct of all columns of ``docs``, and ``key`` of :func:`row_keyed`.

    Whatever the columns are called, none meets the names that an operator adds beside them.
    """
    key = free_name(docs, "key")
    rows = row_keyed(docs, name, key)
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("key"))


def unnested(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from ``doc``, some of them replaced."""
    return rows.select(*[changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark resolves it, for readers and writers beside Spark."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
