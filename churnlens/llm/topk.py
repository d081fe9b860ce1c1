"""Exact top-k inner products by columnar branch-and-bound (operator 9).

Candidates are held in blocks, one array per dimension (vertical layout). For
a block of queries the products are added up over a few dimensions at a time; after each
step what the remaining dimensions can still add is bounded by the product of the
remaining lengths (Cauchy-Schwarz), and only candidates whose bound reaches the query's
k-th best score so far survive into the next, compacted step. The order of the
dimensions puts the heaviest first. All arithmetic is on integers.

Queries go to the tasks a pass at a time, ``PASS_QUERIES`` of them, which bounds what is sent; candidates stay where
they stand. A task keeps the k best of each query over all of its blocks, and the k-th of them is the bound
that the next block has to reach. So a task hands on at most k narrow rows per query, and no vector crosses an exchange.

Rows: vectors that are null or hold null or non-finite components take no part, nor do
rows without vec_id. Each other row is a candidate of every query but itself, rows that share a vec_id too; such
query rows are queries each. Ties go to the smaller vec_id, then to the row first stored. A missing component of a shorter
vector counts as 0; empty vectors score 0. Components whose floor(256 * x) leaves 64 bits count as the largest or smallest
64-bit integer; ranks within a block are by exact sums, and a score that leaves 64 bits is returned as, and ties with, the
largest or smallest. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import common

BLOCK_ROWS = 4096
QUERY_ROWS = 512
PASS_QUERIES = 4096
STEP = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, row (a number of its own) and v, the components as floor(scale * x), of the vectors that take part; stored."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    vectors = table.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    return common.stored(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"),
                                        F.monotonically_increasing_id().alias("row")), "topk-vectors")


def _pack(rows: int):
    """Blocks of vectors as binary: ids, row numbers, and the components dimension by dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, list]] = []

        def block(part):
            dims = max((len(v) for _, _, v in part), default=0)
            columns = np.zeros((dims, len(part)), "<i8")
            for i, (_, _, v) in enumerate(part):
                columns[:len(v), i] = v
            ids, numbers = (np.array([r[i] for r in part], "<i8") for i in (0, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([len(part)], pa.int32()), pa.array([dims], pa.int32()),
                 *[pa.array([x.tobytes()], pa.binary()) for x in (ids, numbers, columns)]],
                names=["n", "dims", "ids", "rows", "columns"])
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("vec_id", "row", "v")), strict=True)
            while len(held) >= rows:
                yield block(held[:rows])
                held = held[rows:]
        if held:
            yield block(held)
    return run


BLOCK = "n int, dims int, ids binary, rows binary, columns binary"


def _arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r.ids, "<i8"), np.frombuffer(r.rows, "<i8"), np.frombuffer(r.columns, "<i8").reshape(r.dims, r.n)


def best_in_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int,
                  step: int = STEP, q_rows: np.ndarray | None = None, c_rows: np.ndarray | None = None,
                  floors: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, numbers of the candidates, scores): the k best candidates of each query.

    ``q`` and ``c`` are (dimensions, vectors). Rows tell vectors apart (the ids, if none are given); ties go to the
    smaller id, then row. Candidates below a query's floor may be left out.
    """
    q_rows, c_rows = (ids if rows is None else rows for ids, rows in ((q_ids, q_rows), (c_ids, c_rows)))
    dims = max(len(q), len(c))
    q, c = (np.vstack([x, np.zeros((dims - len(x), x.shape[1]), x.dtype)]) for x in (q, c))
    biggest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dims, 1)
    if biggest >= 2.0 ** 62:  # products that could leave 64 bits are formed on Python's integers
        q, c = q.astype(object), c.astype(object)
        step = max(dims, 1)
    else:
        heavy = np.argsort(-(c.astype(float) ** 2).sum(axis=1), kind="stable")
        q, c = q[heavy], c[heavy]
    # lengths of what is left from each dimension on; a hair above, to stay an upper bound
    q_left, c_left = (np.sqrt(np.vstack([np.cumsum((x[::-1].astype(float)) ** 2, axis=0)[::-1],
                                         np.zeros((1, x.shape[1]))])) * (1 + 1e-9) for x in (q, c))
    exact_floats = biggest < 2.0 ** 52
    first = (c[:step].T.astype(float) @ q[:step].astype(float)).astype("<i8") if exact_floats else c[:step].T @ q[:step]
    for j in range(q.shape[1]):
        others = np.flatnonzero(c_rows != q_rows[j])
        if not len(others):
            continue
        part = first[others, j]
        done = min(step, dims)
        least = floors[j] if floors is not None else None
        if done < dims and len(others) > k:
            # full scores of the most promising k give the first bound to beat
            lead = np.argpartition(-part, k - 1)[:k]
            own = (part[lead] + c[done:, others[lead]].T @ q[done:, j]).min()
            least = own if least is None else max(own, least)
        while done < dims:
            if least is not None:
                alive = part + q_left[done, j] * c_left[done, others] >= least
                others, part = others[alive], part[alive]
            to = min(done + step, dims)
            part = part + c[done:to, others].T @ q[done:to, j]
            done = to
        if len(part) > k:
            cut = np.partition(part, len(part) - k)[len(part) - k]
            near = np.flatnonzero(part >= cut)
        else:
            near = np.arange(len(part))
        order = near[np.lexsort((c_rows[others[near]], c_ids[others[near]], -part[near]))][:k]
        found = part[order]
        if found.dtype == object:
            found = np.array([min(max(int(x), LEAST), MOST) for x in found], "<i8")
        yield j, others[order], found.astype("<i8")


def _search(queries: list[tuple], k: int):
    """The k best of a task for each query of the blocks ``queries``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list] = [[None] * len(ids) for ids, _, _ in queries]
        for batch in batches:
            for r in batch.itertuples(index=False):
                c_ids, c_rows, c = _arrays(r)
                for (q_ids, q_rows, q), held in zip(queries, best, strict=True):
                    floors = [int(h[2][-1]) if h is not None and len(h[2]) == k else None for h in held]
                    for j, at, scores in best_in_block(q_ids, q, c_ids, c, k, STEP, q_rows, c_rows, floors):
                        new = (c_ids[at], c_rows[at], scores)
                        if held[j] is not None:
                            new = tuple(np.concatenate(x) for x in zip(held[j], new, strict=True))
                        order = np.lexsort((new[1], new[0], ~new[2]))[:k]  # ~: the smallest integer has no negative
                        held[j] = tuple(x[order] for x in new)
        for (q_ids, q_rows, _), held in zip(queries, best, strict=True):
            n = [0 if h is None else len(h[0]) for h in held]
            if sum(n):
                parts = [np.concatenate([h[i] for h in held if h is not None]) for i in range(3)]
                yield pd.DataFrame({"query_id": np.repeat(q_ids, n), "query_row": np.repeat(q_rows, n),
                                    "vec_id": parts[0], "row": parts[1], "score": parts[2]})
    return run


FOUND = "query_id bigint, query_row bigint, vec_id bigint, row bigint, score bigint"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each of ``queries`` (both: vec_id, row, v)."""
    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        n = max(-(-rows.count() // size), 1)
        return common.stored(rows.repartition(n, "row").mapInArrow(_pack(size), BLOCK), name)
    c, q = blocks(vectors, BLOCK_ROWS, "topk-blocks"), blocks(queries, QUERY_ROWS, "topk-queries")
    found = vectors.sparkSession.createDataFrame([], FOUND)
    asked = q.toLocalIterator()
    while one := list(islice(asked, PASS_QUERIES // QUERY_ROWS)):
        pass_ = c.mapInPandas(_search([_arrays(r) for r in one], k), FOUND)
        found = found.unionByName(common.stored(pass_, "topk-found"))
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))
