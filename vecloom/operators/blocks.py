"""Block joins: candidates meet queries by block in one Arrow stream, candidates first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of candidates, aimed at.
BLOCK = 32_768
#: Queries that one matrix product takes.
QUERIES = 256
#: Pairs whose differences are taken at once.
PAIRS = 1 << 17


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths, without nulls, as n x d doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def codes(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths, without nulls, as n x bytes."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4) if n else np.zeros(1, np.int32)
    raw = np.frombuffer(column.buffers()[2], np.uint8, at[-1] - at[0], at[0]) if at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw.reshape(n, -1) if n else np.zeros((0, 0), np.uint8)


def packed(x: np.ndarray) -> pa.Array:
    """The other way round: rows of bytes as a binary column."""
    n, m = x.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * m), pa.py_buffer(np.ascontiguousarray(x, np.uint8))])


def vectors(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def every(n: int) -> Column:
    """Explodes a row to blocks 0..n-1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block")


def block_count(n: int) -> int:
    return max(1, -(-n // BLOCK))


#: Columns that a block join carries, and how a task reads them.
CARRIED = {"vec": ("array<double>", matrix), "code": ("binary", codes)}


def join_blocks(base: DataFrame, queries: DataFrame, kernel: Callable[..., Iterator[pa.RecordBatch]], schema: str, of: tuple[str, str] = ("vec", "vec"), named: bool = False) -> DataFrame:
    """kernel(ids, vectors, query ids, query vectors) for each block of base and each batch of queries.

    base and queries have (block, id) and a column each, named by `of`: vec, or code for rows of bytes; a query stands
    once for each block it goes to. A task holds one block of candidates at a time, and queries pass in Arrow batches,
    so its memory does not grow with the data. named: the rows get their block as a last column, too."""
    carried = list(dict.fromkeys(of))

    def side(df: DataFrame, role: int) -> DataFrame:
        own = (F.col(c) if c == of[role] else F.lit(None).cast(CARRIED[c][0]).alias(c) for c in carried)
        return df.select("block", F.lit(role).alias("role"), "id", *own)

    stream = side(base, 0).union(side(queries, 1)).repartition("block").sortWithinPartitions("block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            block, role, ids = (b.column(c).to_numpy() for c in ("block", "role", "id"))
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0) | (np.diff(role) != 0)) + 1, [len(block)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                column = of[role[i]]
                x = CARRIED[column][1](b.column(column).slice(i, j - i))
                if block[i] != now:
                    now, held = block[i], []
                if role[i] == 0:
                    held.append((ids[i:j], x))
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(c) for c in zip(*held, strict=True))]
                    for p in range(0, j - i, QUERIES):
                        for out in kernel(*held[0], ids[i + p : min(i + p + QUERIES, j)], x[p : p + QUERIES]):
                            yield out.append_column("block", pa.array(np.full(out.num_rows, now))) if named else out

    return stream.mapInArrow(run, f"{schema}, block long" if named else schema)


def smallest(owner: np.ndarray, d2: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of each owner's k smallest distances, ties to smaller ids, in the order (owner, distance, id)."""
    order = np.lexsort((ids, d2, owner))
    own = owner[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


class Block:
    """Rows of a block made ready once, for many batches of queries: single precision chooses, direct differences of doubles rank.

    Rows are centred on their mean, and half of their squared norm is one more column, so that one matrix product gives
    half of each squared distance, less the query's own share. Room for its rounding is left on either side of the
    k-th, so that what is chosen holds all of the true nearest; where single precision chooses too many, doubles choose."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.mean = x.mean(0)
        self.half = ((x - self.mean) ** 2).sum(1) / 2
        self.ready: dict[type, np.ndarray] = {}

    def _rows(self, kind: type) -> np.ndarray:
        if kind not in self.ready:
            self.ready[kind] = np.ascontiguousarray(np.column_stack([self.mean - self.x, self.half]).astype(kind).T)
        return self.ready[kind]

    def _chosen(self, c: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray] | None, kind: type) -> tuple[np.ndarray, np.ndarray] | None:
        """(row, col) of centred queries: all that may be among each one's k nearest; None where the kind of number is too narrow for them."""
        size = (c * c).sum(1) + 2 * self.half.max()
        if not size.max() < np.finfo(kind).max / 1e6 and kind is np.float32:
            return None
        half = np.column_stack([c, np.ones(len(c))]).astype(kind) @ self._rows(kind)
        if same is not None:
            half[same] = np.inf
        room = 2 * np.finfo(kind).eps * (c.shape[1] + 8) * size + np.finfo(kind).tiny
        some = half[:, : max(4 * k, half.shape[1] // 8)]  # the k-th of some is no nearer than the k-th of all
        most = min(k, some.shape[1]) - 1
        bound = np.minimum(np.partition(some, most, axis=1)[:, most] + room, np.finfo(kind).max)
        row, col = np.divmod(np.flatnonzero(half <= bound.astype(kind)[:, None]), half.shape[1])
        if len(row) > 64 * k * len(c) and kind is np.float32:
            return None
        value = half[row, col]
        n = np.bincount(row, minlength=len(c))
        kth = np.full(len(c), np.inf)
        at = np.lexsort((value, row))
        kth[n >= k] = value[at[(np.cumsum(n) - n + k - 1)[n >= k]]]
        keep = value <= (kth + room)[row]
        return row[keep], col[keep]

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, col, d2): each query's k nearest, ties to smaller ids, in the order (row, distance, id)."""
        same = None
        if skip_self:
            cols = np.flatnonzero(np.isin(self.ids, query_ids))
            a, b = np.nonzero(query_ids[:, None] == self.ids[cols][None, :])
            same = (a, cols[b])
        c = q - self.mean
        chosen = self._chosen(c, k, same, np.float32)
        row, col = self._chosen(c, k, same, np.float64) if chosen is None else chosen
        d2 = np.empty(len(row))
        for i in range(0, len(row), PAIRS):
            part = q[row[i : i + PAIRS]] - self.x[col[i : i + PAIRS]]
            d2[i : i + PAIRS] = (part**2).sum(1)
        top = smallest(row, d2, self.ids[col], k)
        return row[top], col[top], d2[top]
