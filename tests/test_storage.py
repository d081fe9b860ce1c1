"""Files, tables and streams: what a rebuild, a replay or a new checkpoint must not lose."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from churnlens.operators import vectors
from churnlens.session import CHECKPOINT_KEY, ensure_checkpoint_dir
from churnlens.sources import files
from churnlens.streaming import incremental


def folder(name):
    return os.path.join(tempfile.mkdtemp(prefix="storage-"), name)


def test_raw_csv_without_a_sequence_column(spark):
    path = folder("customers.csv")
    with open(path, "w") as f:
        f.write("customer_id,customer_name,customer_segment,country,subscription_plan,monthly_revenue,account_created_at,"
                "account_status\nC1,Alpha,SMB,France,Team,10.5,2024-01-02,ACTIVE\nC2,Beta,SMB,France,Team,,2024-13-02,paused\n"
                "C1,Alpha,SMB,France,Team,11.5,2024-01-02,active\n")
    rows = files.read_raw_csv(spark, path, "customers").orderBy(F.desc("_input_row_number")).collect()
    assert [(r.customer_id, r.monthly_revenue) for r in rows] == [("C1", 11.5), ("C2", None), ("C1", 10.5)]


def test_five_tables_come_back_as_written(spark, fx):
    for name, attr in (("customers", "raw_customers"), ("support_tickets", "raw_tickets"), ("product_usage", "raw_usage"),
                       ("customer_feedback", "raw_feedback"), ("subscription_events", "raw_subs")):
        rows = getattr(fx, attr).drop("_input_row_number")
        text = [c for c in ("message", "feedback_text") if c in rows.columns]
        rows = rows.withColumns({c: F.concat(F.col(c), F.lit(' said "so",\n and left \\ ')) for c in text})
        path = files.write_csv(rows, folder(name))
        got = files.read_raw_csv(spark, path, name).drop("_input_row_number")
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


def test_a_value_that_is_no_number_is_refused(spark):
    path = folder("usage.csv")
    with open(path, "w") as f:
        f.write("customer_id,date,active_users,sessions,feature_usage,errors,average_session_duration\nC1,2024-01-02,many,1,x,0,1.0\n")
    with pytest.raises(Exception, match="many|MALFORMED|FAILED"):
        files.read_raw_csv(spark, path, "product_usage").collect()


def test_overwrite_replaces_the_whole_table(spark):
    path = folder("t")
    files.overwrite_table(spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string"), path, ["p"])
    files.overwrite_table(spark.createDataFrame([(3, "a")], "x int, p string"), path, ["p"])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(3, "a")]
    bad = spark.createDataFrame([(1, "a")], "x int, p string").withColumn("x", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        files.overwrite_table(bad, path, ["p"])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(3, "a")]


def test_a_new_checkpoint_loses_no_rows_and_a_replay_doubles_none(spark):
    base = tempfile.mkdtemp(prefix="storage-stream-")
    log = f"{base}/log"
    for i in range(2):
        spark.createDataFrame([(f"k{i}", "v", dt.datetime(2024, 1, 1))], incremental.MEMORY_SCHEMA).write.parquet(f"{base}/in{i}")
        incremental.start_memory_log(spark, f"{base}/in{i}", log, f"{base}/checkpoint{i}").awaitTermination()
    assert {r.key for r in incremental.memory_view(spark, log).collect()} == {"k0", "k1"}
    commits = f"{base}/checkpoint1/commits"
    for name in os.listdir(commits):  # the last batch counts as not done: the next start runs it again
        os.rename(f"{commits}/{name}", f"{base}/{name}")
    incremental.start_memory_log(spark, f"{base}/in1", log, f"{base}/checkpoint1").awaitTermination()
    assert spark.read.parquet(log).count() == 2


def test_one_hash_twice_in_a_batch_is_stored_once(spark):
    base = tempfile.mkdtemp(prefix="storage-embed-")
    row = ("ticket", "T1", "C1", dt.datetime(2024, 1, 1), "printer on fire", "{}")
    spark.createDataFrame([row, row], incremental.CHUNK_SCHEMA).write.parquet(f"{base}/in")
    incremental.start_embedding_sync(spark, f"{base}/in", f"{base}/store", f"{base}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{base}/store").count() == 1


def test_a_model_embeds_and_its_store_is_searched(spark, fx):
    def encode(texts):
        if any("crashes" in t for t in texts) and len(texts) == 1:
            raise RuntimeError("no memory")
        return [[float("search" in t.lower()), 1.0, float(len(t) % 3)] for t in texts]
    chunks = vectors.with_hash(vectors.chunks_all(fx)).repartition(5, "record_id")
    embedded = vectors.embed_with_model(chunks, encode, 3, "toy")
    failed = [r for r in embedded.collect() if not r.embedded_ok]
    assert all(r.embedding is None and "no memory" in r.embed_error for r in failed)
    got = vectors.retrieve(vectors.store_rows(embedded), [1.0, 0.0, 0.0], k=2).collect()
    assert got[0].record_id == "FDB-0001"
    with pytest.raises(TypeError):
        vectors.retrieve(vectors.store_rows(embedded), "a text")


def test_many_queries_go_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)]
    df = spark.createDataFrame([*rows, (300, None), (301, [0.0, 0.0, 0.0])], "id int, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(rows * 1, "label int, centroid array<double>").union(
        spark.createDataFrame([(i + 1000, v) for i, v in rows] * 1, "label int, centroid array<double>"))
    got = vectors.nearest_to_queries(df, queries, "label", 3, "id").collect()
    assert len(got) == 1800
    best = {r.query_key: r for r in got if r["rank"] == 1}
    assert all(abs(r.score - 1) < 1e-12 and r.id == r.query_key % 1000 % 35 for r in best.values())


def test_long_texts_embed_in_linear_time(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([("r", text)], "record_id string, text string")
    row = vectors.embed(df, embedded_at="2024-01-01").first()
    assert len(row.embedding) == vectors.DEFAULT_DIM and abs(sum(v * v for v in row.embedding.values()) - 1) < 1e-9


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {CHECKPOINT_KEY: None}
    with pytest.raises(ValueError, match="share"):
        ensure_checkpoint_dir(Session())
