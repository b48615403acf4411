"""Inverted lists: points by their nearest coarse centroid; queries probe the nearest lists.

With product codes a list stores a few bytes a point: its residual to the list's centre, cut into sub-vectors, each
named by its nearest codebook entry. A task decodes a list's codes once, compares its queries' residuals with them, and
only the nearest by codes are ranked by their vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vectors import largest_divisor
from vecloom.operators.blocks import Block, batch, every, join_blocks, matrix, packed
from vecloom.operators.exact import nearest_in_block, top_k, with_self
from vecloom.operators.partition import nearest_groups, nearest_leader
from vecloom.operators.search import score
from vecloom.session import bucketed, bucketed_at
from vecloom.sources.vectors import subsample

#: Centroids are trained on at most so many rows, of at most so many bytes.
TRAINING_ROWS, TRAINING_BYTES = 65_536, 128 << 20
#: Entries of a codebook.
ENTRIES = 256
#: Queries that meet a list in one task, aimed at; a list stands once for each part of them.
QUERY_PART = 131_072


def lloyd(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """k means of a bounded sample; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_leader(x, c)
        order = np.argsort(own, kind="stable")
        n = np.bincount(own, minlength=len(c))
        at = np.cumsum(n) - n
        c[n > 0] = np.add.reduceat(x[order], at[n > 0], axis=0) / n[n > 0, None]
    return c


def product_codebooks(x: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """(parts, up to ENTRIES, d / parts): centroids of each sub-vector."""
    return np.array([lloyd(sub, ENTRIES, 5, seed + i) for i, sub in enumerate(np.split(x, parts, axis=1))])


def product_codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """n x parts bytes: each sub-vector's nearest entry of its codebook, the first of equals."""
    return np.stack([nearest_leader(sub, b) for sub, b in zip(np.split(x, len(books), axis=1), books, strict=True)], axis=1).astype(np.uint8)


def encode(residuals: DataFrame, books: np.ndarray) -> DataFrame:
    """(block, id, code binary) of (block, id, vec): one byte for each codebook."""
    shared = residuals.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(block=b.column("block"), id=b.column("id"), code=packed(product_codes(matrix(b.column("vec")), shared.value)))

    return residuals.select("block", "id", "vec").mapInArrow(run, "block long, id long, code binary")


def nearest_by_codes(books: np.ndarray, k: int, skip_self: bool):
    """A kernel of join_blocks: codes of a list against residual queries; ties to smaller ids.

    The list's codes are decoded once for all batches of queries, and one matrix product compares them: a table of
    distances for each query would be looked up once for each part of each pair."""
    held: list = []

    def kernel(ids: np.ndarray, code: np.ndarray, query_ids: np.ndarray, q: np.ndarray):
        if not held or held[0] is not code:
            held[:] = [code, Block(ids, np.concatenate([book[code[:, j]] for j, book in enumerate(books)], axis=1))]
        row, col, d2 = held[1].nearest(query_ids, q, k, skip_self)
        yield batch(id=query_ids[row], nbr=ids[col], d2=d2)

    return kernel


@dataclass
class IvfIndex:
    """lists: (block, id, vec), or with books (block, id, code), bucketed by block; centres: one for each block; points: what ranks at last."""

    points: DataFrame
    lists: DataFrame
    centres: np.ndarray
    books: np.ndarray | None
    buckets: int

    @classmethod
    def build(cls, points: DataFrame, d: int, nlist: int = 64, pq_m: int | None = None, seed: int = 0, centres: np.ndarray | None = None, books: np.ndarray | None = None) -> IvfIndex:
        """Centroids and codebooks are trained on a bounded sample unless given; every point is listed."""
        spark = points.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if centres is None or pq_m and books is None:
            rows = min(TRAINING_ROWS, max(TRAINING_BYTES // (8 * d), 1))
            x = matrix(subsample(points, rows, seed).select("vec").toArrow().column("vec").combine_chunks())
            centres = lloyd(x, nlist, seed=seed) if centres is None else centres
            if pq_m and books is None:
                books = product_codebooks(x - centres[nearest_leader(x, centres)], largest_divisor(d, pq_m), seed)
        lists = nearest_groups(points, centres, 1, residual=books is not None)
        if books is not None:
            lists = encode(lists, books)
        return cls(points, bucketed(lists, "lists", "block", buckets), centres, books, buckets)

    def candidates(self, queries: DataFrame, k: int, nprobe: int, skip_self: bool) -> DataFrame:
        """(id, rank, nbr, d2): each query's k nearest of its `nprobe` nearest lists, by codes where there are codes."""
        asked = nearest_groups(queries, self.centres, nprobe, residual=self.books is not None)
        kernel = nearest_in_block(k, skip_self) if self.books is None else nearest_by_codes(self.books, k, skip_self)
        of = ("vec" if self.books is None else "code", "vec")
        parts = max(1, -(-queries.count() * min(nprobe, len(self.centres)) // (len(self.centres) * QUERY_PART)))
        lists = self.lists.withColumnRenamed("block", "list").select(every(parts), "list", "id", of[0])
        lists = lists.withColumn("block", F.col("list") * parts + F.col("block")).drop("list")
        asked = asked.withColumn("block", F.col("block") * parts + F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)))
        return top_k(join_blocks(lists, asked, kernel, "id long, nbr long, d2 double", of), k)

    def search(self, queries: DataFrame, k: int, nprobe: int = 16, wide: int = 4, skip_self: bool = False) -> DataFrame:
        """(id, rank from 1, nbr, d2): the candidates, `wide` times k by codes, ranked by their vectors."""
        found = self.candidates(queries, k if self.books is None else wide * k, nprobe, skip_self).select("id", "nbr").distinct()
        a, b = queries.select("id", F.col("vec").alias("a")), self.points.select(F.col("id").alias("nbr"), "vec")
        if queries is self.points:
            return top_k(score(found, self.points), k)
        from vecloom.functions.vectors import sq_l2

        return top_k(found.join(a, "id").join(b, "nbr").select("id", "nbr", sq_l2(F.col("a"), F.col("vec")).alias("d2")), k)

    def share(self, queries: DataFrame, nprobe: int) -> float:
        """The share of all (query, point) pairs that a search scores."""
        sizes = self.lists.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        asked = nearest_groups(queries, self.centres, nprobe).groupBy("block").agg(F.count(F.lit(1)).alias("q"))
        done = sizes.join(asked, "block").agg(F.sum(F.col("n") * F.col("q")).alias("s")).first()["s"] or 0
        return done / (self.points.count() * queries.count())

    def save(self, path: str) -> None:
        """Lists and points in buckets, centres and books as rows."""
        spark = self.points.sparkSession
        bucketed(self.lists, "lists", "block", self.buckets, f"{path}/lists", "overwrite")
        bucketed(self.points, "points", "id", self.buckets, f"{path}/points", "overwrite")
        rows = [("centres", i, v.tolist()) for i, v in enumerate(self.centres)]
        rows += [] if self.books is None else [(f"book{j}", i, v.tolist()) for j, book in enumerate(self.books) for i, v in enumerate(book)]
        spark.createDataFrame(rows, "kind string, at int, vec array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        line = json.dumps({"buckets": self.buckets, "books": 0 if self.books is None else len(self.books)})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        own = json.loads(spark.read.text(f"{path}/params").first()["value"])
        rows = spark.read.parquet(f"{path}/centres").orderBy("kind", "at").collect()
        of = lambda kind: np.array([r["vec"] for r in rows if r["kind"] == kind])
        books = np.array([of(f"book{j}") for j in range(own["books"])]) if own["books"] else None
        tables = (bucketed_at(spark, f"{path}/{name}", name, key, own["buckets"]) for name, key in (("points", "id"), ("lists", "block")))
        return cls(*tables, of("centres"), books, own["buckets"])


def self_knn(points: DataFrame, n: int, d: int, k: int, metric: str = "euclidean", nlist: int = 64, nprobe: int = 16, pq_m: int | None = None, wide: int = 4, seed: int = 0) -> DataFrame:
    """(id, rank, nbr, dist): lists by equi-join, candidates by the lists' vectors or product codes, ranked again exactly."""
    index = IvfIndex.build(points, d, min(nlist, n), pq_m, seed)
    return with_self(index.search(points, k, nprobe, wide, True), points, metric)
