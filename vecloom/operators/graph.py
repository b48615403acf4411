"""Edges: diversity pruning, symmetrisation, degrees, and the entry point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import sq_l2
from vecloom.operators.blocks import batch


def kept_by_diversity(d2: np.ndarray, x: np.ndarray, alpha: float, r: int) -> list[int]:
    """Of candidates in order of distance: keep one unless a kept one is nearer to it by the factor alpha; at most r."""
    kept: list[int] = []
    for z in range(len(d2)):
        if len(kept) == r:
            break
        if not kept or not (alpha * alpha * ((x[kept] - x[z]) ** 2).sum(1) < d2[z]).any():
            kept.append(z)
    return kept


def robust_prune(candidates: DataFrame, points: DataFrame, alpha: float = 1.2, r: int = 64) -> DataFrame:
    """(src, dst, norm) of candidates (src, dst, norm): greedy from the nearest on, ties by id.

    Candidate lists are bounded (a reservoir's l_max); they travel as one array for each source, with the
    candidates' vectors joined in by id, and are pruned in Arrow batches."""
    with_vec = candidates.join(points.select(F.col("id").alias("dst"), "vec"), "dst")
    lists = with_vec.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("norm", "dst", "vec"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, dst, norm = [], [], []
            for s, own in zip(b.column("src").to_pylist(), b.column("c"), strict=True):
                items = own.values
                d2 = items.field("norm").to_numpy(zero_copy_only=False)
                ids = items.field("dst").to_numpy(zero_copy_only=False)
                x = items.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(d2), -1)
                for z in kept_by_diversity(d2, x, alpha, r):
                    src.append(s)
                    dst.append(int(ids[z]))
                    norm.append(float(d2[z]))
            yield batch(src=pa.array(src, pa.int64()), dst=pa.array(dst, pa.int64()), norm=pa.array(norm, pa.float64()))

    return lists.mapInArrow(run, "src long, dst long, norm double")


def symmetrize(edges: DataFrame, points: DataFrame, r: int, d: int | None = None) -> DataFrame:
    """(src, dst): edges and their reverses, without loops and repeats; of over r the r nearest, ties by id."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    a, b = points.select(F.col("id").alias("src"), F.col("vec").alias("a")), points.select(F.col("id").alias("dst"), F.col("vec").alias("b"))
    scored = both.join(a, "src").join(b, "dst").select("src", "dst", sq_l2(F.col("a"), F.col("b"), d).alias("d2"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= r).select("src", "dst", "d2")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def medoid(points: DataFrame, d: int) -> DataFrame:
    """(id, d2): the point nearest to the mean of all, ties to smaller ids. Means are d sums, one row."""
    mean = points.agg(F.array(*(F.avg(F.get("vec", F.lit(i))) for i in range(d))).alias("mean")).first()["mean"]
    scored = points.select("id", sq_l2(F.col("vec"), F.array(*map(F.lit, mean)), d).alias("d2"))
    return scored.agg(F.min(F.struct("d2", "id")).alias("m")).select(F.col("m.id").alias("id"), F.col("m.d2").alias("d2"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dsts): neighbours in ascending order."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("dsts"))
