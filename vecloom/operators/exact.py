"""Exact k-NN joins: each point with its k nearest others, or queries with their k nearest base points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import emit
from vecloom.operators.blocks import Block, batch, block_count, every, join_blocks


#: Queries that meet a block in one task, aimed at.
QUERY_PART = 131_072


def nearest_in_block(k: int, skip_self: bool):
    """A matrix product chooses, with room for its rounding; direct differences rank."""
    held: list[Block] = []  # the block of the batch before, made ready

    def kernel(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray):
        if not held or held[0].x is not x:
            held[:] = [Block(ids, x)]
        row, col, d2 = held[0].nearest(query_ids, q, k, skip_self)
        yield batch(id=query_ids[row], nbr=ids[col], d2=d2)

    return kernel


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """(id, rank from 1, nbr, d2): each id's k smallest by (d2, nbr). Spark limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "nbr"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def with_self(ranked: DataFrame, points: DataFrame, metric: str) -> DataFrame:
    """(id, rank, nbr, dist) with each point itself at rank 0."""
    own = points.select("id", F.lit(0).cast("long").alias("rank"), F.col("id").alias("nbr"), F.lit(0.0).alias("dist"))
    return own.union(ranked.select("id", F.col("rank").cast("long"), "nbr", emit(F.col("d2"), metric).alias("dist")))


def knn_pairs(base: DataFrame, queries: DataFrame, n: int, k: int, skip_self: bool, kernel=None, column: str = "vec") -> DataFrame:
    """(id, rank, nbr, d2). Every query meets every block of base: the work of an exact join, without a cross join of rows.

    kernel and column: what else than vectors to compare, as join_blocks takes it.

    A block stands once for each part of the queries, so that a task has a bounded number of either."""
    parts = max(1, -(-(n if queries is base else queries.count()) // QUERY_PART))
    blocks = max(block_count(n), min(base.sparkSession.sparkContext.defaultParallelism, -(-n // 1024)))
    placed = base.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", column)
    asked = queries.select(every(blocks), "id", column)
    if parts > 1:
        placed = placed.select((F.col("block") * parts).alias("first"), "id", column).select("first", every(parts), "id", column).withColumn("block", F.col("first") + F.col("block")).drop("first")
        asked = asked.withColumn("block", F.col("block") * parts + F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)))
    return top_k(join_blocks(placed, asked, kernel or nearest_in_block(k, skip_self), "id long, nbr long, d2 double", (column, column)), k)


def self_knn(points: DataFrame, n: int, k: int, metric: str = "euclidean") -> DataFrame:
    """(id, rank 0..k, nbr, dist): the point itself first, then its k nearest others by (distance, id)."""
    return with_self(knn_pairs(points, points, n, k, True), points, metric)


def query_knn(base: DataFrame, queries: DataFrame, n: int, k: int, metric: str = "euclidean") -> DataFrame:
    """(id, rank 1..k, nbr, dist): base points nearest to held-out queries."""
    return knn_pairs(base, queries, n, k, False).select("id", F.col("rank").cast("long").alias("rank"), "nbr", emit(F.col("d2"), metric).alias("dist"))
