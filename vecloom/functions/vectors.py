"""Distances, norms, rounding and quantisation as Column expressions; numpy kernels for the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Accepted names, without regard to case.
METRICS = {"l2": "euclidean", "euclidean": "euclidean", "euclidian": "euclidean", "cosine": "cosine", "angular": "cosine"}
#: Vectors up to this many dimensions get an unrolled expression, which whole-stage code generation compiles.
UNROLL = 128


def parse_metric(name: str) -> str:
    """'euclidean' or 'cosine'; anything else is a ValueError."""
    try:
        return METRICS[name.lower()]
    except (KeyError, AttributeError):
        raise ValueError(f"unsupported metric: {name!r}") from None


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def sq_norm(vec: Column) -> Column:
    """Sum of squares."""
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)


def dot(a: Column, b: Column, d: int | None = None) -> Column:
    """Inner product; unrolled where the dimension is given and small."""
    if d is not None and d <= UNROLL:
        return sum((F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(1, d)), F.get(a, F.lit(0)) * F.get(b, F.lit(0)))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_l2(a: Column, b: Column, d: int | None = None) -> Column:
    """Squared Euclidean distance; unrolled where the dimension is given and small."""
    if d is not None and d <= UNROLL:
        terms = [F.get(a, F.lit(i)) - F.get(b, F.lit(i)) for i in range(d)]
        return sum((t * t for t in terms[1:]), terms[0] * terms[0])
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalize(vec: Column) -> Column:
    """Scaled to unit length; a zero vector stays as it is."""
    n = F.sqrt(sq_norm(vec))
    return F.when(n > 0, F.transform(vec, lambda x: x / n)).otherwise(vec)


def emit(d2: Column, metric: str) -> Column:
    """The distance that is shown for a squared distance: its root, or half of it for unit vectors under cosine."""
    d2 = F.greatest(d2, F.lit(0.0))
    return F.sqrt(d2) if metric == "euclidean" else d2 * 0.5


def bf16(x: Column) -> Column:
    """Rounded to 8 significant bits, halves to even; zero and null stay."""
    q = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 7)
    return F.when(x == 0, x).otherwise(F.bround(x / q) * q)


def bf16_array(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.exp2(np.floor(np.log2(np.abs(x))) - 7)
        return np.where(x == 0, x, np.round(x / q) * q)


def largest_divisor(d: int, cap: int) -> int:
    """The largest divisor of d that is at most cap: how many sub-vectors product quantisation cuts d into."""
    return next(m for m in range(min(d, cap), 0, -1) if d % m == 0)


def register(spark: SparkSession) -> None:
    """SQL functions l2_sq, l2_dist, cosine_dist, dot_product and unit_vector over arrays of doubles."""
    for name, arguments, body in (
        ("l2_sq", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
        ("l2_dist", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
        ("dot_product", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
    norm = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
    inner = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine_dist(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE "
        f"RETURN 1 - {inner} / (coalesce(nullif({norm.format('a')}, 0), 1) * coalesce(nullif({norm.format('b')}, 0), 1))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION unit_vector(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> "
        f"RETURN transform(a, x -> x / coalesce(nullif({norm.format('a')}, 0), 1))"
    )


def direct_sq_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in doubles, without the cancellation of the product form."""
    return ((a - b) ** 2).sum(1)


def product_sq_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs from one matrix product, held to zero from below: for choosing, not for showing."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)
