"""Exact nearest neighbours of a stated query set by a block matrix join with int8 product tiles."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postmart.llm.common import Scratch

#: Rows of a block of queries and of a block of candidates; a tile is their product.
QUERY_ROWS, CANDIDATE_ROWS = 256, 4096
#: Queries whose best are kept in a task before they are handed on.
HELD = 20_000


def usable(column: str) -> Column:
    """Vectors that take part: not NULL, not zero, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(column, finite) & F.exists(column, lambda x: x != 0), F.lit(False))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Vectors of one length packed into blocks: (dim, n, ids, data)."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int | None, np.ndarray]]] = {}

        def block(dim: int, part: list) -> pa.RecordBatch:
            ids = np.array([i for i, _ in part], "<i8").tobytes()
            data = np.stack([v for _, v in part]).tobytes()
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(part)], pa.int32()), "ids": pa.array([ids], pa.binary()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            vectors = batch.column("vector")
            flat, ends = np.asarray(vectors.flatten(), "<f8"), np.cumsum(vectors.value_lengths().to_numpy())
            for i, v in zip(batch.column("id").to_pylist(), np.split(flat, ends[:-1]), strict=True):
                part = held.setdefault(len(v), [])
                part.append((i, v))
                if len(part) == size:
                    yield block(len(v), held.pop(len(v)))
        for dim, part in held.items():
            yield block(dim, part)

    return rows.mapInArrow(pack, "dim int, n int, ids binary, data binary")


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(int8 values, scale, length of each row's rounding error)."""
    scale = float(np.abs(x).max()) / 127 or 1.0
    q = np.rint(x / scale).astype(np.int8)
    return q, scale, np.linalg.norm(x - scale * q, axis=1)


def tile_best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k nearest candidates of the tile, nearest first, ties to the smaller id.

    The product of the int8 tiles is exact (in float, below 2^24 in single precision) and gives distances
    between rounded vectors; the true ones differ by the two rounding errors at most.  A candidate whose
    lower bound is above the k-th smallest upper bound cannot be among the k; the others are computed from
    the original vectors in double precision."""
    (qi, qs, qe), (vi, vs, ve) = quantise(q), quantise(v)
    kind = np.float32 if 127 * 127 * q.shape[1] < 2**24 else np.float64
    a, b = qi.astype(kind), vi.astype(kind)
    product = (a @ b.T).astype(np.float64)
    square = (qs * qs) * (a.astype(float) ** 2).sum(1)[:, None] + (vs * vs) * (b.astype(float) ** 2).sum(1) - 2 * qs * vs * product
    about = np.sqrt(np.maximum(square, 0))
    slack = (qe[:, None] + ve) + 1e-9 * (1 + about)
    upper, lower = about + slack, about - slack
    again = len(np.unique(vid)) < len(vid)
    for row, own in enumerate(qid):
        others = np.flatnonzero(vid != own)
        if not len(others):
            continue
        bound = upper[row, others]
        if again:  # rows that repeat an id count once
            bound = np.array(list({i: u for u, i in sorted(zip(bound, vid[others], strict=True), reverse=True)}.values()))
        limit = np.partition(bound, k - 1)[k - 1] if len(bound) > k else np.inf
        near = others[lower[row, others] <= limit]
        total = np.zeros(len(near))
        for d in range(q.shape[1]):
            total += (q[row, d] - v[near, d]) ** 2
        best: dict[int, float] = {}
        for score, i in zip(np.sqrt(total).tolist(), vid[near].tolist(), strict=True):
            best[i] = min(score, best.get(i, score))
        yield int(own), heapq.nsmallest(k, ((s, i) for i, s in best.items()))


def nearest(
    vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score): for each row that satisfies ``queries`` its k nearest other rows by
    Euclidean distance, all of them if there are fewer; nearest first, ties to the smaller id.  Exact.

    Vectors and queries are packed into blocks.  Each block of candidates has a key of its own, to which every
    block of queries is sent, so a task reads one block of each at a time and the tiles spread over all
    tasks.  A task keeps the best of its tiles in heaps; what is shuffled is k rows for each query and task.

    Vectors that are NULL, zero or hold a NULL or non-finite component take no part, nor do rows without
    an id; only vectors of the query's length are compared.  Rows that repeat an id are one candidate (the
    nearest of them counts) and never their own query's.  An empty table gives no rows; further columns
    are ignored."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col))
    narrow = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = rows.where(queries).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    candidates = scratch.store(_blocks(narrow, CANDIDATE_ROWS).withColumn("lane", F.monotonically_increasing_id()), "candidates")
    queried = scratch.store(_blocks(asked.repartition(F.pmod(F.xxhash64("id"), F.lit(64))), QUERY_ROWS), "queries")
    lanes = candidates.select("dim", "lane")
    sent = queried.select("dim", F.col("ids").alias("qids"), F.col("data").alias("qdata")).join(lanes, "dim")
    tiles = sent.drop("dim").join(candidates.withColumnRenamed("ids", "vids").withColumnRenamed("data", "vdata"), "lane")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}

        def flush() -> pa.RecordBatch:
            found = [(q, i, s) for q, best in heaps.items() for s, i in best]
            heaps.clear()
            columns = list(zip(*found, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "id", "score"])

        for batch in batches:
            for tile in batch.to_pylist():
                qid, vid = np.frombuffer(tile["qids"], "<i8"), np.frombuffer(tile["vids"], "<i8")
                q, v = (np.frombuffer(tile[c], "<f8").reshape(-1, tile["dim"]) for c in ("qdata", "vdata"))
                for own, best in tile_best(qid, q, vid, v, k):
                    merged: dict[int, float] = {}
                    for s, i in [*heaps.get(own, []), *best]:
                        merged[i] = min(s, merged.get(i, s))
                    heaps[own] = heapq.nsmallest(k, ((s, i) for i, s in merged.items()))
                if len(heaps) > HELD:
                    yield flush()
        yield flush()

    found = tiles.select("dim", "qids", "qdata", "vids", "vdata").mapInArrow(search, "query_id bigint, id bigint, score double")
    once = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    ranked = once.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")


SQL = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_count(embedding) = len(embedding) AND isfinite(list_min(embedding)) AND isfinite(list_max(embedding))
    AND (list_min(embedding) <> 0 OR list_max(embedding) <> 0)
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, min(list_distance(q.v, c.v)) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
