"""Candidate edges: pairs within leaves, residual codes of random hyperplanes, and the bounded reservoir of each point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import bf16, bf16_array
from vecloom.operators.blocks import QUERIES, Block, batch, join_blocks, matrix, vectors

#: Rows of a leaf that one task takes whole.
LEAF_ROWS = 16_384


def hyperplanes(m: int, d: int, seed: int = 0) -> np.ndarray:
    """m x d Gaussian normals; at most 16, so that a code fits 16 bits."""
    if not 1 <= m <= 16:
        raise ValueError("m must be in 1..16")
    return np.random.default_rng(seed).standard_normal((m, d))


def sketch(points: DataFrame, planes: np.ndarray) -> DataFrame:
    """Adds sketch (array<double>): the products with the hyperplanes, one matrix product for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, vectors(matrix(b.column("vec")) @ planes.T)], [*b.schema.names, "sketch"])

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("sketch", T.ArrayType(T.DoubleType()))]))


def residual_code(sketch_from: Column, sketch_to: Column, m: int) -> Column:
    """Bit i is 1 where the step from one point to the other is on the positive side of hyperplane i."""
    bit = lambda i: F.when(F.get(sketch_to, F.lit(i)) - F.get(sketch_from, F.lit(i)) >= 0, 1 << i).otherwise(0)
    return sum((bit(i) for i in range(1, m)), bit(0)).cast("int")


def _nearest_pairs(planes: np.ndarray, cap: int):
    """A kernel of (src, dst, code, norm): each query's `cap` nearest of a block's others, with residual codes."""
    weights = 1 << np.arange(len(planes))
    held: list = []  # the block of the batch before, made ready, and its sketches

    def kernel(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not held or held[0].x is not x:
            held[:] = [Block(ids, x), x @ planes.T]
        row, col, d2 = held[0].nearest(query_ids, q, cap, True)
        code = ((held[1][col] - (q @ planes.T)[row]) >= 0) @ weights
        yield batch(src=query_ids[row], dst=ids[col], code=code.astype(np.int32), norm=d2)

    return kernel


def _nearest_of_codes(table: pa.Table) -> pa.Table:
    """Of pairs of one leaf the nearest of each (src, code), ties to smaller ids."""
    src, dst, code, norm = (table.column(c).to_numpy() for c in ("src", "dst", "code", "norm"))
    order = np.lexsort((dst, norm, code, src))
    s, c = src[order], code[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
    return table.take(pa.array(order[new]))


def leaf_pairs(leaves: DataFrame, planes: np.ndarray, cap: int, keep_codes: bool = True, norm_mode: str = "exact") -> DataFrame:
    """(src, dst, code, norm): within each leaf of (leaf_id, id, vec) every point's `cap` nearest others, with residual code and squared distance.

    A leaf of at most LEAF_ROWS rows is one group of a grouped Arrow function. A larger one is cut into blocks of about so
    many, which all of its points meet, and what a point found in each is merged; the driver sees a row for each of these
    leaves. With keep_codes only the nearest of each (point, code) leaves the task (of large leaves: the merge), which is
    the reservoir's reduction done before the shuffle; norm_mode is the reservoir's."""
    kernel = _nearest_pairs(planes, cap)
    form = pa.schema({"src": pa.int64(), "dst": pa.int64(), "code": pa.int32(), "norm": pa.float64()})
    schema = "src long, dst long, code int, norm double"

    def run(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), matrix(table.column("vec").combine_chunks())
        found = [b for i in range(0, len(ids), QUERIES) for b in kernel(ids, x, ids[i : i + QUERIES], x[i : i + QUERIES])]
        out = pa.Table.from_batches(found, form)
        if norm_mode == "bf16":
            out = out.set_column(3, "norm", pa.array(bf16_array(out.column("norm").to_numpy())))
        return _nearest_of_codes(out) if keep_codes else out

    rows = leaves.select("leaf_id", "id", "vec")
    sizes = leaves.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LEAF_ROWS).collect()
    if not sizes:
        return rows.groupBy("leaf_id").applyInArrow(run, schema)
    places, first = [], 0
    for r in sizes:
        parts = -(-r["size"] // LEAF_ROWS)
        places.append((r["leaf_id"], first, parts))
        first += parts
    large = leaves.sparkSession.createDataFrame(places, "leaf_id long, first long, parts long")
    small = rows.join(F.broadcast(large), "leaf_id", "left_anti").groupBy("leaf_id").applyInArrow(run, schema)
    cut = rows.join(F.broadcast(large), "leaf_id")
    base = cut.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "id", "vec")
    asked = cut.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("block"), "id", "vec")
    met = join_blocks(base, asked, kernel, schema, named=True)
    named = large.select("leaf_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("block"))
    met = met.join(F.broadcast(named), "block")
    place = F.row_number().over(Window.partitionBy("leaf_id", "src").orderBy("norm", "dst"))
    near = met.withColumn("place", place).where(F.col("place") <= cap)
    near = near.select("leaf_id", "src", "dst", "code", (bf16(F.col("norm")) if norm_mode == "bf16" else F.col("norm")).alias("norm"))
    if keep_codes:
        place = F.row_number().over(Window.partitionBy("leaf_id", "src", "code").orderBy("norm", "dst"))
        near = near.withColumn("place", place).where("place = 1")
    return small.unionByName(near.select("src", "dst", "code", "norm"))


def reservoir(candidates: DataFrame, l_max: int, norm_mode: str = "bf16") -> DataFrame:
    """(src, dst, code, norm): of each (src, code) the nearest, ties to smaller ids, and of these each src's l_max nearest.

    The result does not depend on the order in which candidates come: it is a minimum for each code, partially
    aggregated before the shuffle, and a limited window. bf16 compares distances rounded to 8 bits."""
    norm = bf16(F.col("norm")) if norm_mode == "bf16" else F.col("norm")
    best = candidates.select("src", "dst", "code", norm.alias("norm")).groupBy("src", "code").agg(F.min(F.struct("norm", "dst")).alias("b"))
    best = best.select("src", F.col("b.dst").alias("dst"), "code", F.col("b.norm").alias("norm"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("norm", "dst"))
    return best.withColumn("rank", rank).where(F.col("rank") <= l_max).drop("rank")


def drain(slots: DataFrame) -> DataFrame:
    """(src, slots): each reservoir as an array of (norm, dst), nearest first."""
    return slots.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("norm", "dst"))).alias("slots"))
