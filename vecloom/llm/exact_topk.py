"""Exact top-k inner products: vectors in order of descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

The rotation comes from the vectors' second moments, summed in Spark (d x d numbers). Vectors are range-partitioned
by descending length into buckets. The longest vectors of all (a fixed number) give each query a floor, its
k-th best score among them; a query is sent only to buckets whose longest vector can reach its floor. In a bucket, tiles of
descending length are scored on the leading rotated coordinates; the rest is bounded by the product of the
residual lengths, and only pairs whose bound reaches the floor are scored exactly, in integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from . import vectors as shared
from .vectors import best, by_cell, finite, lists, matrix, one_for_each_id, with_parts

#: Vectors of a bucket, aimed at; the number of longest vectors that give floors; vectors and queries of a tile.
BUCKET, SCOUTS, TILE, QUERIES = 65_536, 2_048, 1_024, 256
#: Bytes that the longest vectors take at most on the driver.
SCOUT_BYTES = 16 << 20


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products a @ b.T: in doubles where these are exact, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def search_bucket(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, rotation: np.ndarray, head: int, k: int):
    """(query row, vector row, score) of each query's k best of a bucket that reach its floor."""
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    ids, vectors, length = ids[order], vectors[order], length[order]
    lead = vectors.astype(np.float64) @ rotation[:, :head]
    rest = np.sqrt(np.maximum(length**2 - (lead**2).sum(1), 0))
    q = queries.astype(np.float64)
    q_length = np.sqrt((q**2).sum(1))
    q_lead = q @ rotation[:, :head]
    q_rest = np.sqrt(np.maximum(q_length**2 - (q_lead**2).sum(1), 0))
    floor = floors.astype(np.float64)
    got_q, got_v, got_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(ids), TILE):
        slack = 1 + 1e-9 * q_length * length[i]  # what rounding can take off a bound
        alive = np.flatnonzero(q_length * length[i] + slack >= floor)
        if not len(alive):
            break
        t = slice(i, i + TILE)
        bound = q_lead[alive] @ lead[t].T + q_rest[alive, None] * rest[None, t] + slack[alive, None]
        row, col = np.nonzero(bound >= floor[alive, None])
        if len(row) * 8 > bound.size:
            score = _dot(queries[alive], vectors[t])[row, col]
        else:
            parts = [(queries[alive[row[p : p + 65_536]]] * vectors[i + col[p : p + 65_536]]).sum(1) for p in range(0, len(row), 65_536)]
            score = np.concatenate([np.zeros(0, np.int64), *parts])
        keep = (score >= floor[alive[row]]) & (ids[i + col] != query_ids[alive[row]])
        got_q = np.concatenate([got_q, alive[row[keep]]])
        got_v = np.concatenate([got_v, i + col[keep]])
        got_s = np.concatenate([got_s, score[keep]])
        top = best(got_q, got_s, ids[got_v], k)
        got_q, got_v, got_s = got_q[top], got_v[top], got_s[top]
        n = np.bincount(got_q, minlength=len(q))
        last = np.cumsum(n) - 1
        full = n >= k
        floor[full] = np.maximum(floor[full], got_s[last[full]])
    return got_q, order[got_v], got_s


def top_k(vectors: DataFrame, queries: Column, k: int = 10, buckets: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query with all other vectors.

    vectors has id and vec (array<long>); queries is a condition on id. Ties go to smaller ids. One row stands for
    each id (one_for_each_id says which); ids that are null take no part; fewer than k candidates give fewer rows.
    Scores beyond 63 bits wrap. The driver holds d x d sums, one row for each bucket, and SCOUTS vectors."""
    spark = vectors.sparkSession
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows, d = one_for_each_id(vectors, "vectors")
    n = rows.count()
    count = buckets or max(min(48, -(-n // 1024)), -(-n // BUCKET), 1)
    dealt = rows.withColumn("length", length).repartitionByRange(count, F.desc("length"), F.xxhash64("id"))
    dealt = materialize(dealt.withColumn("cell", F.spark_partition_id()), "buckets")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column("vec"), d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], ["i", "v"])

    sums = dealt.select("vec").mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect() if n else []
    second = np.zeros(d * d)
    for r in sums:
        second[r["i"]] = r["v"]
    rotation = np.linalg.eigh(second.reshape(d, d))[1][:, ::-1] if d else np.zeros((0, 0))
    head = max(1, d // 4)
    reach = {r["cell"]: r["longest"] for r in dealt.groupBy("cell").agg(F.max("length").alias("longest")).collect()}
    cells = np.array(sorted(reach), np.int64)
    longest = np.array([reach[c] for c in cells.tolist()])
    top = dealt.orderBy(F.desc("length"), "id").limit(max(min(SCOUTS, SCOUT_BYTES // (8 * max(d, 1))), k + 1)).select("id", "vec").collect()
    parts = max(1, -(-dealt.where(queries).count() // shared.QUERY_PART))
    scouts = spark.sparkContext.broadcast((np.array([r["id"] for r in top], np.int64), np.array([r["vec"] for r in top], np.int64).reshape(len(top), d)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scout_ids, scout = scouts.value
        for batch in batches:
            ids, x = batch.column("id").to_numpy(), matrix(batch.column("vec"), d, np.int64)
            for i in range(0, len(ids), QUERIES):
                own, q = ids[i : i + QUERIES], x[i : i + QUERIES]
                score = _dot(q, scout).astype(np.float64)
                score[own[:, None] == scout_ids[None, :]] = -np.inf
                floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(own), -np.inf)
                size = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                row, to = np.nonzero(size[:, None] * longest[None, :] * (1 + 1e-9) + 1 >= floor[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(cells[to] * parts + own[row] % parts), pa.array(own[row]), lists(q[row]), pa.array(floor[row])], ["cell", "id", "vec", "floor"])

    def search(ids, x, query_ids, q, floors):
        for i in range(0, len(query_ids), QUERIES):
            part = slice(i, i + QUERIES)
            a, b, s = search_bucket(ids, x, query_ids[part], q[part], floors[part], rotation, head, k)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[part][a]), pa.array(ids[b]), pa.array(s)], ["query_id", "vec_id", "score"])

    asked = dealt.where(queries).select("id", "vec").mapInArrow(route, "cell long, id long, vec array<long>, floor double")
    stream = with_parts(dealt.withColumn("cell", F.col("cell").cast("long")), parts).select("cell", F.lit(0).alias("role"), "id", "vec", F.lit(0.0).alias("floor")).union(asked.select("cell", F.lit(1).alias("role"), "id", "vec", "floor"))
    found = stream.repartition("cell").sortWithinPartitions("cell", "role").mapInArrow(by_cell(search, d, np.int64), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_embeddings(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """top_k of quantized embeddings; queries are the rows whose vec_id is divisible by `every`."""
    rows = embeddings.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), quantized(F.col("embedding")).alias("vec"))
    return top_k(rows, F.col("id") % every == 0, k)
