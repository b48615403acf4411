"""Vectors in: preparation, checks, samples, sparse cells, and the synthetic generators that tests use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import vectors as V


def from_table(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "euclidean") -> DataFrame:
    """(id long, vec array<double>); unit vectors under cosine. Only these two columns are read."""
    vec = V.as_doubles(F.col(vec_col))
    return df.select(F.col(id_col).cast("long").alias("id"), (V.normalize(vec) if V.parse_metric(metric) == "cosine" else vec).alias("vec"))


def from_array(spark: SparkSession, x, metric: str = "euclidean") -> DataFrame:
    """Rows of an n x d array-like, ids by position; for inputs that the driver holds anyway."""
    x = np.ascontiguousarray(x, np.float32)
    if x.ndim != 2 or not x.size:
        raise ValueError("a non-empty two-dimensional array is needed")
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    return from_table(df, metric=metric)


def profile(points: DataFrame) -> DataFrame:
    """One row: n, n_null, min_dim, max_dim, n_bad (rows with null, NaN or infinite elements)."""
    inf = F.lit(float("inf"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return points.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("vec").isNull()).alias("n_null"),
        F.min(F.size("vec")).cast("long").alias("min_dim"),
        F.max(F.size("vec")).cast("long").alias("max_dim"),
        F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("n_bad"),
    )


def validate(points: DataFrame, dim: int | None = None) -> tuple[int, int]:
    """(rows, dimension); ValueError for an empty table, null or non-finite vectors, and unequal dimensions."""
    p = profile(points).first()
    if not p["n"]:
        raise ValueError("no vectors")
    if p["n_null"] or p["n_bad"]:
        raise ValueError(f"{p['n_null']} null vectors, {p['n_bad']} with null, NaN or infinite elements")
    if p["min_dim"] != p["max_dim"] or not p["max_dim"]:
        raise ValueError(f"dimensions differ: {p['min_dim']} to {p['max_dim']}")
    if dim is not None and dim != p["max_dim"]:
        raise ValueError(f"dimension {p['max_dim']} where {dim} is needed")
    return p["n"], p["max_dim"]


def hash_order(id_col: Column, seed: int = 0) -> Column:
    """An arithmetic hash of all 64 bits in 0..2^32-1 that other SQL engines compute alike: what random choices are ordered by.

    The products stay within 63 bits: 2^31 * 2654435761 + 2^32 * 668265261 < 2^63."""
    low, high = F.pmod(id_col, F.lit(2147483648)) * F.lit(2654435761), F.shiftright(id_col.cast("long"), 31) * F.lit(668265261)
    return F.pmod(low + high + F.lit(seed % 4294967296), F.lit(4294967296))


def subsample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The n rows of the lowest hash: a choice without replacement that depends on ids and seed only."""
    return points.orderBy(hash_order(F.col("id"), seed), "id").limit(n)


def sparse_cells(df: DataFrame, cell: str, gene: str, expr: str) -> DataFrame:
    """(cell, gene, expr) in long form from list columns gene and expr; values that are not positive are padding."""
    pair = F.explode(F.filter(F.arrays_zip(F.col(gene).alias("g"), F.col(expr).alias("e")), lambda p: p["e"] > 0))
    return df.select(F.col(cell).alias("cell"), pair.alias("p")).select("cell", F.col("p.g").alias("gene"), F.col("p.e").cast("double").alias("expr"))


# ---- synthetic data --------------------------------------------------------------------------------


def gaussian_clusters(n: int, d: int, clusters: int | None = None, scale: float = 6.0, seed: int = 0) -> np.ndarray:
    """Unit noise around random centres of standard deviation `scale`; one centre for each 5,000 rows, at least 8."""
    rng = np.random.default_rng(seed)
    k = clusters or max(8, n // 5000)
    centres = rng.standard_normal((k, d)) * scale
    return (centres[rng.integers(0, k, n)] + rng.standard_normal((n, d))).astype(np.float32)


#: The generator's multiplier and increment.
LCG_MULTIPLIER, LCG_INCREMENT = 6364136223846793005, 1442695040888963407


_U = np.uint64
_MASK = 2**64 - 1


def _jump(state: int, steps: int) -> int:
    """The generator's state so many steps on, in log(steps) squarings of its step."""
    a, c, mul, add = LCG_MULTIPLIER, LCG_INCREMENT, 1, 0
    while steps:
        if steps & 1:
            mul, add = mul * a & _MASK, (add * a + c) & _MASK
        a, c = a * a & _MASK, (a + 1) * c & _MASK
        steps >>= 1
    return (state * mul + add) & _MASK


def lcg(first: int, n: int, seed: int) -> np.ndarray:
    """Elements first..first + n - 1 of a 64-bit linear congruential sequence: its high 31 bits, as fractions in [0, 1).

    Element i is a^(i+1) seed + c (1 + a + ... + a^i) modulo 2^64, so a section needs no other one."""
    mul = np.full(n, LCG_MULTIPLIER, _U)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(mul, out=mul)
        sums = np.ones(n, _U)
        np.cumsum(mul[:-1], out=sums[1:])
        sums[1:] += _U(1)
        state = mul * _U(_jump(seed & _MASK, first)) + sums * _U(LCG_INCREMENT)
    return (state >> _U(33)).astype(np.float64) / 2**31


def _lcg(n: int, seed: int) -> np.ndarray:
    return lcg(0, n, seed)


def lcg_uniform(n: int, d: int, seed: int = 7) -> np.ndarray:
    return (2 * _lcg(n * d, seed) - 1).astype(np.float32).reshape(n, d)


def lcg_gaussian(n: int, d: int, seed: int = 1) -> np.ndarray:
    """Box-Muller over pairs of the sequence."""
    u = _lcg(2 * n * d, seed).reshape(2, -1)
    return _box_muller(u[0], u[1]).astype(np.float32).reshape(n, d)


def _box_muller(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(-2 * np.log(np.maximum(u, 1e-12))) * np.cos(2 * np.pi * v)


def generated(spark: SparkSession, n: int, d: int, kind: str = "uniform", seed: int = 7, rows: int = 16_384) -> DataFrame:
    """(vec_id, embedding array<float>) of lcg_uniform or lcg_gaussian: each task makes its own section of the sequence, `rows` vectors at a time, and the driver none."""
    if kind not in ("uniform", "gaussian"):
        raise ValueError(f"unknown kind: {kind!r}")
    parts = -(-n // rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column("id").to_pylist():
                a, z = part * rows, min(part * rows + rows, n)
                size = (z - a) * d
                if kind == "uniform":
                    x = 2 * lcg(a * d, size, seed) - 1
                else:
                    x = _box_muller(lcg(a * d, size, seed), lcg(n * d + a * d, size, seed))
                flat = pa.array(x.astype(np.float32))
                vec = pa.ListArray.from_arrays(pa.array(np.arange(z - a + 1, dtype=np.int32) * d), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, z)), vec], ["vec_id", "embedding"])

    return spark.range(0, parts, 1, max(1, min(parts, 4096))).mapInArrow(run, "vec_id long, embedding array<float>")
