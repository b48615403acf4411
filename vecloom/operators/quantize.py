"""Scalar quantisation to 8 bits, and exact ranking of what it finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.blocks import batch, matrix, packed
from vecloom.operators.exact import knn_pairs, nearest_in_block, top_k, with_self
from vecloom.operators.search import score
from vecloom.session import checkpointed


def ranges(points: DataFrame) -> DataFrame:
    """(pos, lo, step): each dimension's least value and a 255th of its spread, 1 where it is flat."""
    at = points.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return at.select("pos", "lo", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 255).otherwise(F.lit(1.0)).alias("step"))


def encode(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, codes array<int>): round((x - lo) / step), halves away from zero, held to 0..255. spans has a row for each dimension."""
    rows = spans.orderBy("pos").collect()
    lo, step = (F.array(*(F.lit(float(r[c])) for r in rows)) for c in ("lo", "step"))
    code = F.transform("vec", lambda x, i: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round((x - F.get(lo, i)) / F.get(step, i)))).cast("int"))
    return points.select("id", code.alias("codes"))


def decoded(codes: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, vec): codes times steps. Squared distances between these are the step-weighted distances of the codes."""
    rows = spans.orderBy("pos").collect()
    step = F.array(*(F.lit(float(r["step"])) for r in rows))
    return codes.select("id", F.transform("codes", lambda c, i: c * F.get(step, i)).alias("vec"))


def encode_packed(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, code binary): the same codes, a byte a dimension."""
    rows = spans.orderBy("pos").collect()
    lo, step = (np.array([r[c] for r in rows]) for c in ("lo", "step"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(id=b.column("id"), code=packed(code_array(matrix(b.column("vec")), lo, step)))

    return points.select("id", "vec").mapInArrow(run, "id long, code binary")


def nearest_by_codes(step: np.ndarray, k: int, skip_self: bool):
    """A kernel of join_blocks for codes on either side: the step-weighted distances, which are those of codes times steps."""
    inner = nearest_in_block(k, skip_self)
    held: list[np.ndarray] = []

    def kernel(ids: np.ndarray, code: np.ndarray, query_ids: np.ndarray, q: np.ndarray):
        if not held or held[0] is not code:
            held[:] = [code, code * step]
        return inner(ids, held[1], query_ids, q * step)

    return kernel


def knn_rerank(points: DataFrame, n: int, k: int, metric: str = "euclidean", wide: int = 2) -> DataFrame:
    """(id, rank, nbr, dist): wide * k neighbours by codes, ranked again by exact distances. A byte a dimension is shuffled for the codes, not a double."""
    spans = checkpointed(ranges(points), "spans")
    step = np.array([r["step"] for r in spans.orderBy("pos").collect()])
    coarse = encode_packed(points, spans)
    pairs = knn_pairs(coarse, coarse, n, wide * k, True, nearest_by_codes(step, wide * k, True), "code").select("id", "nbr")
    return with_self(top_k(score(pairs, points), k), points, metric)


def code_array(x: np.ndarray, lo: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Codes of an n x d array: the same rule for kernels."""
    return np.clip(np.floor((x - lo) / step + 0.5), 0, 255).astype(np.uint8)
