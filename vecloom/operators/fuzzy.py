"""Connectivities of a k-NN graph: distances become weights of a fuzzy set for each point, and the sets' union is symmetric.

The scale of a point is such that its weights add up to log2(k + 1), as in uniform manifold approximation (McInnes and
others 2018); it is found by a fixed number of bisections, for a batch of points at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.blocks import batch
from vecloom.session import checkpointed

#: Fixed value: a scale is at least this share of a mean distance.
LEAST_SCALE = 1e-3


def bisect_scales(dist: np.ndarray, rho: np.ndarray, target: float, steps: int) -> np.ndarray:
    """For each row of distances (padded with infinity): the scale s at which sum exp(-max(d - rho, 0) / s) is nearest the target after `steps` halvings."""
    lo, hi, mid = np.zeros(len(dist)), np.full(len(dist), np.inf), np.ones(len(dist))
    gap = np.maximum(dist - rho[:, None], 0)
    for _ in range(steps):
        above = np.exp(-gap / mid[:, None]).sum(1) > target
        hi, lo = np.where(above, mid, hi), np.where(above, lo, mid)
        mid = np.where(np.isinf(hi), mid * 2, (lo + hi) / 2)
    return mid


def scales(knn: DataFrame, k: int, steps: int = 64) -> DataFrame:
    """(id, rho, sigma) of knn (id, rank, nbr, dist): the least positive distance, and the scale.

    A point all of whose neighbours are at distance 0 has rho 0, and LEAST_SCALE of the mean distance of all points as its
    least scale; others have that share of their own mean, the point itself counted at 0."""
    others = checkpointed(knn.where("nbr <> id").select("id", "nbr", "dist"), "others")  # read for the mean and for the lists
    mean = others.agg((F.sum("dist") / (F.count(F.lit(1)) * (k + 1) / k)).alias("mean")).first()["mean"] or 0.0
    lists = others.groupBy("id").agg(F.array_sort(F.collect_list("dist")).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("d").value_lengths().to_numpy()
            flat = b.column("d").flatten().to_numpy()
            dist = np.full((len(n), n.max(initial=1)), np.inf)
            dist[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
            rho = np.where(dist > 0, dist, np.inf).min(1)
            rho = np.where(np.isinf(rho), 0.0, rho)
            sigma = bisect_scales(dist, rho, np.log2(k + 1), steps)
            own = np.where(np.isinf(dist), 0.0, dist).sum(1) / (n + 1)
            sigma = np.maximum(sigma, LEAST_SCALE * np.where(rho > 0, own, mean))
            yield batch(id=b.column("id"), rho=rho, sigma=sigma)

    return lists.mapInArrow(run, "id long, rho double, sigma double")


def connectivities(knn: DataFrame, k: int, steps: int = 64) -> DataFrame:
    """(row, col, weight) of a self-kNN: a + b - a b of the two directions' weights; both (i, j) and (j, i) are given, the points themselves are not."""
    knn = checkpointed(knn.where("nbr <> id").select("id", "nbr", "dist"), "others")
    own = knn.join(scales(knn, k, steps), "id")
    gap = F.col("dist") - F.col("rho")
    weight = F.when((gap <= 0) | (F.col("sigma") == 0), F.lit(1.0)).otherwise(F.exp(-gap / F.col("sigma")))
    one = own.select(F.col("id").alias("row"), F.col("nbr").alias("col"), weight.alias("a"), F.lit(0.0).alias("b"))
    other = one.select(F.col("col").alias("row"), F.col("row").alias("col"), F.lit(0.0).alias("a"), F.col("a").alias("b"))
    met = one.unionAll(other).groupBy("row", "col").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return met.select("row", "col", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight")).where("weight > 0")
