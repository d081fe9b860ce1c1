"""Streaming variants: incremental embedding sync and memory log."""

import datetime as dt
import os
import tempfile

from churnlens.streaming import incremental


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def test_embedding_sync_stream(spark):
    base = tempfile.mkdtemp(prefix="stream-embed-")
    src, store, ckpt = (os.path.join(base, x) for x in ("chunks", "store", "ckpt"))
    t = dt.datetime(2024, 1, 1)
    _write(spark, [("feedback", "FDB-1", "CUST-1", t, "love the search", "{}"),
                   ("ticket", "TCK-1", "CUST-1", t, "Bug | crash", "{}")], incremental.CHUNK_SCHEMA, src)
    incremental.start_embedding_sync(spark, src, store, ckpt).awaitTermination()
    assert spark.read.parquet(store).count() == 2
    # a second file: one unchanged chunk (skipped by hash) and one new chunk
    _write(spark, [("feedback", "FDB-1", "CUST-1", t, "love the search", "{}"),
                   ("ticket", "TCK-2", "CUST-2", t, "Question", "{}")], incremental.CHUNK_SCHEMA, src)
    incremental.start_embedding_sync(spark, src, store, ckpt).awaitTermination()
    ids = sorted(r.record_id for r in spark.read.parquet(store).collect())
    assert ids == ["FDB-1", "TCK-1", "TCK-2"]


def test_memory_log_stream(spark):
    base = tempfile.mkdtemp(prefix="stream-mem-")
    src, log, ckpt = (os.path.join(base, x) for x in ("writes", "log", "ckpt"))
    _write(spark, [("k", "v1", dt.datetime(2024, 1, 1))], incremental.MEMORY_SCHEMA, src)
    incremental.start_memory_log(spark, src, log, ckpt).awaitTermination()
    _write(spark, [("k", "v2", dt.datetime(2024, 1, 2)), ("j", "x", dt.datetime(2024, 1, 1))],
           incremental.MEMORY_SCHEMA, src)
    incremental.start_memory_log(spark, src, log, ckpt).awaitTermination()
    got = {r.key: r.value for r in incremental.memory_view(spark, log).collect()}
    assert got == {"k": "v2", "j": "x"}


def test_a_batch_reads_only_the_store_partitions_of_its_hashes(spark, tmp_path):
    from pyspark.sql import functions as F

    from churnlens.operators import vectors
    t = dt.datetime(2024, 1, 1)
    src, store = str(tmp_path / "chunks"), str(tmp_path / "store")
    _write(spark, [("ticket", f"TCK-{i}", "CUST-1", t, f"printer {i} on fire", "{}") for i in range(60)], incremental.CHUNK_SCHEMA, src)
    incremental.start_embedding_sync(spark, src, store, str(tmp_path / "checkpoint")).awaitTermination()
    held = spark.read.parquet(store)
    one = vectors.with_hash(spark.createDataFrame([("ticket", "TCK-7", "CUST-1", t, "printer 7 on fire", "{}"),
                                                   ("ticket", "TCK-x", "CUST-1", t, "a new one", "{}")], incremental.CHUNK_SCHEMA))
    delta = vectors.sync_delta(one, held)
    assert [r.record_id for r in delta.collect()] == ["TCK-x"]
    plan = delta._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert vectors.HASH_PART in filters
    parts = one.select(F.collect_set(vectors.hash_part())).first()[0]
    assert held.where(F.col(vectors.HASH_PART).isin(parts)).count() < held.count() / 4
