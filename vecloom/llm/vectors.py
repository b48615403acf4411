"""What the two vector searches share: valid vectors, packed Arrow columns, streams of candidates and queries by cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def finite(vector: Column) -> Column:
    """Not null, not empty, and no element null, NaN or infinite."""
    inf = F.lit(float("inf"))
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


def one_for_each_id(rows: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """Rows (id, vec) written once, one for each id (of repeated ids the greatest vector), and their dimension.

    The dimension is the most frequent one, the larger at a tie; other vectors take no part."""
    kept = materialize(rows.where("id is not null").groupBy("id").agg(F.max("vec").alias("vec")), tag)
    top = kept.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return kept.where(F.size("vec") == d), d


def matrix(column: pa.Array, d: int, kind=np.float64) -> np.ndarray:
    """A list column without nulls as n x d."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), d)


def lists(x: np.ndarray) -> pa.Array:
    """n x d as a list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(x).ravel()))


def by_cell(search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], d: int, kind):
    """Runs search(ids, vectors, query ids, query vectors, floors) over batches sorted by (cell, role): candidates first, then queries.

    A cell's candidates are held together, its queries pass in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            role = batch.column("role").to_numpy()
            ids = batch.column("id").to_numpy()
            floor = batch.column("floor").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("vec"), d, kind)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell) | np.diff(role)) + 1, [len(cell)]])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if cell[i] != now:
                    now, held = cell[i], []
                if role[i] == 0:
                    held.append((ids[i:j], x[i:j]))
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(c) for c in zip(*held, strict=True))]
                    yield from search(*held[0], ids[i:j], x[i:j], floor[i:j])

    return run


#: Queries that meet a cell's candidates in one task, aimed at; a cell that more of them visit stands once for each part of them.
QUERY_PART = 65_536


def with_parts(candidates: DataFrame, parts: int) -> DataFrame:
    """Each row of candidates (cell, ...) once for each part of the queries: cell becomes cell * parts + part."""
    if parts == 1:
        return candidates
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    return candidates.withColumn("part", every).withColumn("cell", F.col("cell") * F.lit(parts) + F.col("part")).drop("part")


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of each owner's k highest scores, ties to smaller ids, in the order (owner, score descending, id)."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]
