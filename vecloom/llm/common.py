"""Helpers that the corpus operators share: the shared folder, Arrow text buffers, word hashes, components."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; its temporaries are a few dozen times that.
SLICE_BYTES = 2 << 20


# ---- shared folder -------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset in local mode (tests), a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "vecloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """pyarrow file system and path of a URI of the shared folder (file, hdfs, s3, gs, or a plain path)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks) -> int:
    """Write chunks of bytes under a name that a repeated task attempt replaces whole; the size."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    temp, size = f"{path}.{uuid.uuid4().hex[:8]}.tmp", 0
    with store.open_output_stream(temp) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(temp, path)
    return size


#: A key that more than this share of all rows have is dealt out by join_dealt to so many tasks; there are at most 1 / HOT such keys.
HOT, SALTS = 1 / 512, 64


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], crowd: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each of the keys; the rows of left whose keys are in crowd (at most 1 / HOT rows) go to SALTS tasks."""
    named = F.broadcast(crowd.select(*keys, F.lit(True).alias("__hot")))
    rest = [c for c in left.columns if c not in keys]
    place = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rest), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    dealt = left.join(named, keys, "left").withColumn("__salt", place).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    spread = right.join(named, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return dealt.join(spread, [*keys, "__salt"], how).drop("__salt")


# ---- Arrow text ----------------------------------------------------------------------------------


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and its n + 1 offsets into them."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


# ---- words and 64-bit hashes ---------------------------------------------------------------------

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = np.array(x, dtype=_U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


# fixed values: public multipliers of 64-bit mixing
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(1)
def byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def lower_table() -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_table() -> np.ndarray:
    """True at 0x20 and 0x09 to 0x0D."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


_LOWER, _SPACE = lower_table(), space_table()
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), base, _U)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if n <= 1 << 20:
            _powers[base] = have
    return have[:n]


def hash_words(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _LOWER, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words `[^\\x20\\x09-\\x0D]+` of A-Z-lowered texts: 64-bit hashes, each text's count, byte starts and lengths.

    Other tables of 256 entries change what bytes are hashed as and which of them part words."""
    n, none = len(offsets) - 1, np.zeros(0, np.int64)
    if not len(raw):
        return np.zeros(0, _U), np.zeros(n, np.int64), none, none
    solid = ~space[raw]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    inner = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(raw))]
    head[inner] = solid[inner]  # no word crosses from one text to the next
    where = np.flatnonzero(solid)
    starts = np.flatnonzero(head)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(n, np.int64), none, none
    first = np.searchsorted(where, starts)
    lengths = np.diff(first, append=len(where))
    position = np.arange(len(where)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(byte_table()[fold[raw[where]]] * powers(int(lengths.max()))[position], first)
        h = mix(h + lengths.astype(_U))
    counts = np.diff(np.searchsorted(starts, offsets))
    return h, counts.astype(np.int64), starts, lengths


def ranges_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., `lengths[0]` of them, then those of starts[1], and so on."""
    ends = np.cumsum(lengths)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    return out + np.repeat(starts - ends + lengths, lengths)


def numbered(h: np.ndarray, folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers of words, equal for equal words alone: hashes h propose what is equal, and the bytes of `folded` are compared."""
    ids, _ = pd.factorize(h)
    ids = ids.astype(np.int64)
    first = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    first[ids[::-1]] = np.arange(len(ids))[::-1]
    like = first[ids]
    if (lengths == lengths[like]).all():
        at = ranges_of(starts, lengths)
        if np.array_equal(folded[at], folded[at + np.repeat(starts[like] - starts, lengths)]):
            return ids
    known: dict[bytes, int] = {}
    words = (folded[a : a + m].tobytes() for a, m in zip(starts.tolist(), lengths.tolist(), strict=True))
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


# ---- connected components ------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links a[i] - b[i]: (node, smallest node of its component), roots left out."""
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    odd = label != np.arange(len(nodes))
    return nodes[odd], nodes[label[odd]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): logarithmically many shuffles,
    each round written to the shared folder. Links, like components, never leave the executors."""

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links"
    )
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(low).distinct(), "links")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
