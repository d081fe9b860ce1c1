"""Chunking, incremental embedding, vector retrieval and rerank.

Embedding: the default vectorizer is a hashed bag of words computed over
Arrow batches (lower-case tokens, md5 bucket into ``dim`` slots, counts,
L2-normalised) and stored sparse as ``map<int,double>``. It is deterministic,
needs no model download and runs inside the executors; a learned model plugs
in through :func:`embed_with_model`, an Arrow ``pandas_udf`` that hands the model
at most 64 texts a call.

Retrieval of one query takes its vector as a one-row scalar subquery (evaluated
once, shipped to every task as a constant), and each stored vector is scored by a map
lookup (sparse) or ``zip_with`` + ``aggregate`` (dense); many queries go through
:func:`nearest_to_queries` in blocks. Top-k uses ``orderBy().limit(k)``; per-group top-k uses
``row_number() <= k`` which Spark plans with a partial WindowGroupLimit before
the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

DEFAULT_DIM = 1024
EMBED_BATCH = 64
MODEL_NAME = "hashed-bow-md5"
TOKEN_SPLIT = "[^a-z0-9]+"


# -- D1-D4: chunks ---------------------------------------------------------------------------
def chunks_feedback(fact_feedback: DataFrame) -> DataFrame:
    """One chunk per feedback row with non-blank text; metadata struct."""
    f = fact_feedback.filter(F.col("feedback_text").isNotNull() & (F.trim("feedback_text") != ""))
    meta = F.struct(F.col("feedback_id"), F.col("customer_id"),
                    F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
                    F.col("rating").cast("string").alias("rating"), F.col("feedback_source").alias("source"))
    return f.select(F.lit("feedback").alias("record_type"), F.col("feedback_id").alias("record_id"),
                    "customer_id", "created_at", F.col("feedback_text").alias("text"), meta.alias("metadata"))


def chunks_ticket(fact_ticket: DataFrame) -> DataFrame:
    """text = subject, or 'subject | message' when there is a message."""
    t = fact_ticket.filter(F.col("subject").isNotNull() & (F.trim("subject") != ""))
    meta = F.struct(F.col("ticket_id"), F.col("customer_id"),
                    F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
                    F.col("category"), F.col("priority"), F.col("status"),
                    F.col("satisfaction_score").cast("string").alias("satisfaction"))
    return t.select(F.lit("ticket").alias("record_type"), F.col("ticket_id").alias("record_id"), "customer_id",
                    "created_at", F.concat_ws(" | ", "subject", "message").alias("text"), meta.alias("metadata"))


def chunks_all(m) -> DataFrame:
    """D3: feedback chunks ++ ticket chunks (metadata as JSON text)."""
    f = chunks_feedback(m.fact_feedback).withColumn("metadata", F.to_json("metadata"))
    t = chunks_ticket(m.fact_ticket).withColumn("metadata", F.to_json("metadata"))
    return f.unionByName(t)


def source_hash(record_type: Column, record_id: Column, text: Column) -> Column:
    """sha256 hex of 'type|id|text' — the cache key."""
    return F.sha2(F.concat_ws("|", record_type, record_id, text), 256)


def with_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("source_hash", source_hash(F.col("record_type"), F.col("record_id"), F.col("text")))


# -- D7: vectorizer -------------------------------------------------------------------------
def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


#: bytes that are no part of a token become blanks, as TOKEN_SPLIT has it
BLANKED = bytes(c if chr(c).isascii() and (chr(c).isdigit() or chr(c).islower()) else 32 for c in range(256))


def unit_counts(text: Column, dim: int) -> Column:
    """``map<int,double>`` of a text: how many of its tokens fall into a bucket, scaled to length 1; NULL without tokens.

    The tokens of an Arrow batch are split and numbered together and each different one is hashed once; the optimizer
    leaves the vector a column of its own, however often it is named. The tasks need nothing of this package."""
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string()).fill_null("")
        _, ends, data = texts.buffers()
        blanked = pa.py_buffer((data.to_pybytes() if data else b"").translate(BLANKED))
        found = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), ends, blanked, offset=texts.offset))
        rows = np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
        words = found.flatten().dictionary_encode()
        each = words.dictionary.cast(pa.binary()).to_pylist()
        # the first 4 bytes of a hash; a text that begins or ends with a blank has empty words there
        hashed = np.frombuffer(b"".join([hashlib.md5(w).digest() for w in each]), ">u4")[::4] % dim
        hashed = np.where(np.array([len(w) > 0 for w in each], bool), hashed.astype(np.int64), -1)
        buckets = hashed[words.indices.to_numpy(zero_copy_only=False)]
        keys, counts = np.unique((rows * dim + buckets)[buckets >= 0], return_counts=True)
        rows, buckets = np.divmod(keys, dim)
        norms = np.sqrt(np.bincount(rows, counts.astype(float) ** 2, len(texts)))
        sizes = np.bincount(rows, minlength=len(texts))
        return pa.MapArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(buckets, pa.int32()),
                                       pa.array(counts / norms[rows], pa.float64()), mask=pa.array(sizes == 0))
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "map<int,double>")(F.lower(text))


def embed(chunks: DataFrame, dim: int = DEFAULT_DIM, embedded_at: str | Column | None = None) -> DataFrame:
    """D7 default path: vector, model, dimension and time on the chunk row.
    The vector and its source hash stay in the same row (see A5)."""
    at = (F.lit(embedded_at).cast("timestamp_ntz") if isinstance(embedded_at, str)
          else (embedded_at if embedded_at is not None else F.current_timestamp().cast("timestamp_ntz")))
    vec = unit_counts(F.col("text"), dim)
    # ``embedded_ok`` is the cheap equivalent of "vector is not NULL" (a text
    # with at least one token); filters use it so the optimizer never inlines
    # the vector expression into a pushed-down predicate
    ok = F.lower(F.col("text")).rlike("[a-z0-9]")
    return chunks.select("*", vec.alias("embedding"), F.coalesce(ok, F.lit(False)).alias("embedded_ok"),
                    F.lit(MODEL_NAME).alias("model"), F.lit(dim).alias("dimension"), at.alias("embedded_at"))


def embed_with_model(chunks: DataFrame, encode, dim: int, model: str) -> DataFrame:
    """D7 plug point: ``encode(list[str]) -> list[list[float]]`` (any local model)
    gets at most 64 texts a call. A call that raises leaves NULL vectors, counted as
    failed and retried by the next run; ``embed_error`` says why."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vecs: list = []
            errors: list = []
            for i in range(0, len(texts), EMBED_BATCH):
                part = texts.iloc[i:i + EMBED_BATCH].tolist()
                try:
                    got = [[float(x) for x in v] for v in encode(part)]
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                    vecs, errors = vecs + got, errors + [None] * len(part)
                except Exception as e:  # noqa: BLE001 - whatever the model raises is reported in its rows
                    vecs, errors = vecs + [None] * len(part), errors + [f"{type(e).__name__}: {e}"] * len(part)
            yield pd.DataFrame({"embedding": vecs, "embed_error": errors})
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    encoded = F.pandas_udf(run, "embedding array<float>, embed_error string")
    out = chunks.withColumn("_e", encoded(F.col("text")))
    return out.select(*chunks.columns, F.col("_e.embedding").alias("embedding"), F.col("_e.embed_error").alias("embed_error"),
                      F.lit(model).alias("model"), F.lit(dim).alias("dimension"),
                      F.current_timestamp().cast("timestamp_ntz").alias("embedded_at"),
                      F.col("_e.embedding").isNotNull().alias("embedded_ok"))


#: the start of the source hash: 4096 partitions of a large store
HASH_PART = "hash_part"


def hash_part() -> Column:
    return F.substring("source_hash", 1, 3)


# -- D5, D6: incremental sync ---------------------------------------------------------------
def sync_delta(chunks: DataFrame, store: DataFrame | None, force: bool = False) -> DataFrame:
    """Chunks whose hash is not stored yet (``force`` takes all). A left
    anti join on the hash: the store side is shuffled (or broadcast by AQE when
    small) once; nothing is collected into a Python set. Of a store that is partitioned by HASH_PART only the
    partitions are read whose hashes occur among the chunks, so a small batch reads a small part of it."""
    c = with_hash(chunks) if "source_hash" not in chunks.columns else chunks
    if force or store is None:
        return c
    if HASH_PART in store.columns:
        # there are 4096 of them at most
        found = [r[0] for r in c.select(hash_part().alias("p")).distinct().collect()]
        store = store.where(F.col(HASH_PART).isin(found))
    return c.join(store.select("source_hash").distinct(), "source_hash", "left_anti")


def sync_counts(chunks: DataFrame, store: DataFrame | None, embedded_delta: DataFrame) -> DataFrame:
    """Embedded / skipped / failed in one row (failed = NULL vector)."""
    c = with_hash(chunks) if "source_hash" not in chunks.columns else chunks
    total = c.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    d = embedded_delta.agg(F.count_if(F.col("embedded_ok")).alias("embedded"),
                           F.count_if(~F.col("embedded_ok")).alias("failed"))
    return d.select("embedded", (total - F.col("embedded") - F.col("failed")).alias("skipped"), "failed")


def store_rows(embedded: DataFrame) -> DataFrame:
    """A5 row shape: the vector and its meta (hash, model, dimension, time)
    in ONE row, so one append commit writes both or neither. Failed chunks
    (no vector) are not stored and will be retried next run."""
    return embedded.filter(F.col("embedded_ok")).select(
        "record_type", "record_id", "customer_id", "created_at", "text", "metadata", "embedding", "model",
        "dimension", "embedded_at", "source_hash")


# -- D8-D11: retrieval ----------------------------------------------------------------------
def sparse_dot(q: Column, v: Column) -> Column:
    """Sum over the query's entries; a missing vector scores 0. The vector is named twice, so the optimizer
    leaves it a column of its own: inlined into the lambda it would be made again for each entry."""
    dot = F.aggregate(F.map_entries(q), F.lit(0.0),
                      lambda acc, e: acc + e["value"] * F.coalesce(F.element_at(v, e["key"]), F.lit(0.0)))
    return F.when(v.isNotNull(), dot).otherwise(F.lit(0.0))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense arrays in double; NULL (not NaN) for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    den = na * nb
    return F.when(den != 0, dot / den)


def apply_filters(store: DataFrame, filters: dict | None) -> DataFrame:
    """Customer, record type, created_from (>=), created_to (<=) — applied
    before scoring so they prune the scan."""
    f = filters or {}
    if f.get("customer_id"):
        store = store.filter(F.col("customer_id") == f["customer_id"])
    if f.get("record_type"):
        store = store.filter(F.col("record_type") == f["record_type"])
    if f.get("created_from"):
        store = store.filter(F.col("created_at") >= F.lit(f["created_from"]).cast("timestamp_ntz"))
    if f.get("created_to"):
        store = store.filter(F.col("created_at") <= F.lit(f["created_to"]).cast("timestamp_ntz"))
    return store


def query_vector(spark, text: str, dim: int = DEFAULT_DIM) -> Column:
    """The query's embedding as a scalar subquery (computed once per query)."""
    one = spark.range(1).select(F.lit(text).alias("text"))
    return embed(one, dim).select("embedding").scalar()


def retrieve(store: DataFrame, query: str | list[float], k: int = 20, filters: dict | None = None,
             dim: int = DEFAULT_DIM, one_row_per_record: bool = False) -> DataFrame:
    """D8 over the chunk store: top k by cosine; ties by record type and id. Fewer
    than k rows when filters cut the set.

    A store of sparse unit vectors (maps) takes the query's text; a store of a model's
    dense vectors (arrays) takes the query's vector from the same model.

    An append-only store may hold several versions of a record, so the newest
    is picked first (a shuffle of the narrow scored rows). A store that holds
    one row per record (the materialised latest view) skips that step: the
    plan is then scan -> score -> bounded top-k, with no shuffle at all."""
    dense = isinstance(store.schema["embedding"].dataType, ArrayType)
    if dense == isinstance(query, str):
        raise TypeError("a dense store takes a query vector, a sparse one a query text")
    # bind the scalar subquery to a column first: higher-order functions may
    # only reference attributes, and the subquery is still evaluated once
    q = F.array(*[F.lit(float(x)) for x in query]) if dense else query_vector(store.sparkSession, query, dim)
    score = (dense_cosine if dense else sparse_dot)(F.col("_q") if not dense else q, F.col("embedding"))
    s = apply_filters(store, filters)
    s = (s if dense else s.withColumn("_q", q)).select(
        "record_type", "record_id", "customer_id", "created_at", "text", "metadata", "embedded_at", "source_hash",
        score.alias("score"))
    # newest version per record after scoring: the vectors are dropped before
    # the shuffle (filters are on per-record attributes, so filtering first
    # gives the same records as filtering the latest versions)
    if not one_row_per_record:
        s = latest_only(s)
    return s.orderBy(F.desc_nulls_last("score"), "record_type", "record_id").limit(k).drop(
        "embedded_at", "source_hash")


def token_overlap(query: str, text: Column) -> Column:
    """Default re-scorer: share of the query's distinct tokens found in the text."""
    qt = F.array_distinct(tokens(F.lit(query)))
    return F.when(F.size(qt) > 0, F.size(F.array_intersect(qt, F.array_distinct(tokens(text)))) / F.size(qt))


def rerank(candidates: DataFrame, query: str, k: int = 20, scorer=None) -> DataFrame:
    """Re-score the <= k candidates, keep min(k, 20) in relevance order.
    A scorer that yields NULL falls back to cosine order (fail-soft)."""
    score = (scorer or token_overlap)(query, F.col("text"))
    top_n = min(k, 20)
    c = candidates.withColumn("rerank_score", score)
    # at most k (<= a few dozen) rows: ordering them needs no partitioning
    w = Window.orderBy(F.desc_nulls_last("rerank_score"), F.desc_nulls_last("score"), "record_type", "record_id")
    return c.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top_n)


def source_refs(results: DataFrame) -> DataFrame:
    """D11: 'record_type:record_id' per result."""
    return results.select(F.concat_ws(":", "record_type", "record_id").alias("source_ref"), "*")


# -- D8/D9 over dense vectors: nearest vectors to each label's centroid -----------------------
#: queries that are sent to all tasks at a time: 4096 vectors of 1,000 numbers are 32 MB
QUERY_BLOCK = 4096


def label_centroids(vectors: DataFrame, key: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per key with pyspark.ml's Summarizer (a partial aggregate:
    no explode of vector elements, one row per key per map task)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = vectors.select(key, array_to_vector(F.col(vec)).alias("_v"))
    return v.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(
        key, vector_to_array("_m").alias("centroid"))


def _unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of unit vectors (missing components 0), and which rows have a direction."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None:
            out[i, :len(v)] = v
    norm = np.sqrt((out ** 2).sum(axis=1))
    has = np.array([v is not None for v in vectors], bool) & (norm > 0)
    out[has] /= norm[has, None]
    return out, has


def _nearest(keys: list, queries: list, k: int):
    """The k best of a whole partition per query; ties go to the smaller id, rows without a score come last."""
    q, q_has = _unit_rows(queries)

    def best(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.stack([np.lexsort((i, -s))[:k] for s, i in zip(scores, ids, strict=True)])
        return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = None
        for batch in batches:
            if batch.empty:
                continue
            v, v_has = _unit_rows(batch["vec"].tolist())
            width = max(q.shape[1], v.shape[1])
            left, right = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
            scores = np.where(q_has[:, None] & v_has[None, :], left @ right.T, -np.inf)
            ids = np.broadcast_to(batch["id"].to_numpy(), scores.shape)
            if top is not None:
                scores, ids = np.concatenate([top[0], scores], 1), np.concatenate([top[1], ids], 1)
            top = best(scores, ids)
        if top is not None:
            n = top[0].shape[1]
            yield pd.DataFrame({"query_key": [x for x in keys for _ in range(n)], "id": top[1].ravel(),
                                "score": [None if np.isinf(s) else float(s) for s in top[0].ravel()]})
    return run


def nearest_to_queries(vectors: DataFrame, queries: DataFrame, qkey: str, k: int, id_col: str,
                       vec: str = "embedding") -> DataFrame:
    """Top-k vectors per query by cosine (NULL, and last, for a zero or missing vector).

    Queries go to the tasks QUERY_BLOCK at a time, which bounds what is broadcast; each block is a pass over the vectors
    where they stand. A task hands on its k best per query, so no vector crosses an exchange and at most k
    narrow rows per query and task do."""
    qtype, idtype = queries.schema[qkey].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    schema = f"query_key {qtype}, id {idtype}, score double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    near = vectors.sparkSession.createDataFrame([], schema)
    asked = iter(queries.select(F.col(qkey).alias("qk"), F.col("centroid").alias("qv")).toLocalIterator())
    while block := list(islice(asked, QUERY_BLOCK)):
        search = _nearest([r.qk for r in block], [r.qv for r in block], k)
        near = near.unionByName(rows.mapInPandas(search, schema))
    w = Window.partitionBy("query_key").orderBy(F.desc_nulls_last("score"), F.asc("id"))
    return near.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select(
        "query_key", F.col("id").alias(id_col), "score", "rank")


def vector_store_view(embeddings: DataFrame) -> DataFrame:
    """The driver's ``embeddings`` table seen as a vector store: record type
    from label parity, customer from vec_id, a creation time from vec_id."""
    return embeddings.select(
        F.when(F.col("label") % 2 == 0, "feedback").otherwise("ticket").alias("record_type"),
        F.col("vec_id").cast("string").alias("record_id"), F.col("vec_id"),
        F.concat(F.lit("CUST-"), F.lpad((F.col("vec_id") % 150).cast("string"), 9, "0")).alias("customer_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("vec_id").cast("int")))
        .alias("created_at"),
        "label", "embedding")


# -- D12, D13: store views ------------------------------------------------------------------
def store_stats(store: DataFrame) -> DataFrame:
    """Rows per model and dimension with the latest embedding time."""
    return store.groupBy("model", "dimension").agg(F.max("embedded_at").alias("latest_embedded_at"),
                                                  F.count(F.lit(1)).alias("rows"))


def latest_only(df: DataFrame) -> DataFrame:
    """Newest row per record (ties: larger hash). A ``row_number() = 1`` filter:
    Spark plans a WindowGroupLimit before the shuffle, so each map task ships
    at most one row per record, and no wide struct aggregation buffer is built."""
    w = Window.partitionBy("record_type", "record_id").orderBy(F.desc("embedded_at"), F.desc("source_hash"))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def latest_per_record(store: DataFrame) -> DataFrame:
    """The newest vector per (record_type, record_id); an append-only
    store keeps stale vectors of changed records and forced re-embeds."""
    return latest_only(store)
