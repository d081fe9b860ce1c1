"""Incremental variants on Structured Streaming (an extra: the reference runs
these steps as batch jobs only).

* :func:`start_embedding_sync` — new chunk files stream in; each micro-batch
  embeds only chunks whose source hash is not stored yet (D5) and appends the
  vectors with their hashes in one commit (A5).
* :func:`start_memory_log` — memory writes stream into an append-only log;
  :func:`memory_view` is the latest value per key (I1).

Both sinks are idempotent per micro-batch: each batch of each query has a folder of
its own, which a replay writes again, so a restarted query neither loses nor
duplicates rows. Paths must be on shared storage
(below ``spark.checkpoint.dir`` on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from churnlens.operators import memory as mem
from churnlens.operators import vectors

CHUNK_SCHEMA = ("record_type string, record_id string, customer_id string, created_at timestamp_ntz, "
                "text string, metadata string")
MEMORY_SCHEMA = "key string, value string, updated_at timestamp_ntz"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def _own_folder(batch: DataFrame, root: str, batch_id: int) -> tuple[str, str]:
    """(query id, folder of this micro-batch). Batch numbers start anew with each query, so
    the id of the query, which its checkpoint keeps, is part of the key."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return query, f"{root.rstrip('/')}/query_id={query}/batch_id={batch_id}"


def start_embedding_sync(spark: SparkSession, chunk_dir: str, store_dir: str, checkpoint_dir: str,
                         available_now: bool = True, dim: int = vectors.DEFAULT_DIM) -> StreamingQuery:
    chunks = spark.readStream.schema(CHUNK_SCHEMA).parquet(chunk_dir)

    def sync(batch: DataFrame, batch_id: int) -> None:
        query, folder = _own_folder(batch, store_dir, batch_id)
        store = None
        if _exists(spark, store_dir):
            # a replay writes its folder again, so what it wrote before doesn't count as stored
            store = spark.read.parquet(store_dir).where(
                ~((F.col("query_id") == query) & (F.col("batch_id") == batch_id)))
        delta = vectors.sync_delta(vectors.with_hash(batch).dropDuplicates(["source_hash"]), store)
        rows = vectors.store_rows(vectors.embed(delta, dim=dim)).withColumn(vectors.HASH_PART, vectors.hash_part())
        # one file per partition of the hash, whatever the number of tasks
        rows.repartition(vectors.HASH_PART).write.mode("overwrite").partitionBy(vectors.HASH_PART).parquet(folder)

    w = chunks.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_memory_log(spark: SparkSession, writes_dir: str, log_dir: str, checkpoint_dir: str,
                     available_now: bool = True) -> StreamingQuery:
    writes = spark.readStream.schema(MEMORY_SCHEMA).parquet(writes_dir)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_own_folder(batch, log_dir, batch_id)[1])

    w = writes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def memory_view(spark: SparkSession, log_dir: str) -> DataFrame:
    """I1 over the streamed log: latest value per key."""
    return mem.upsert_latest(spark.read.parquet(log_dir).select("key", "value", "updated_at"))
