"""Vectors in array files: .npy by ranges of rows on the executors, in and out; HDF5 where h5py is installed."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.operators.blocks import batch, vectors
from vecloom.session import checkpointed

#: Rows that one task reads at a time.
ROWS = 16_384


def _ranges(spark: SparkSession, n: int, read) -> DataFrame:
    """(vec_id, embedding) of rows 0..n-1; read(a, b) gives rows a..b-1 on an executor."""
    parts = -(-n // ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column("id").to_pylist():
                a, z = part * ROWS, min(part * ROWS + ROWS, n)
                yield batch(vec_id=np.arange(a, z), embedding=vectors(read(a, z)))

    return spark.range(parts).repartition(max(1, min(parts, 4096))).mapInArrow(run, "vec_id long, embedding array<double>")


def from_npy(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """The first `rows` rows of an n x d array that all executors can open at path; it is mapped into memory, not loaded.

    path is one .npy file or a folder that to_npy has finished; vec_id is the row's place."""
    if os.path.isdir(path) and not os.path.exists(os.path.join(path, "_SUCCESS")):
        raise ValueError(f"{path} is not a finished folder of arrays")
    names = sorted(n for n in os.listdir(path) if n.endswith(".npy")) if os.path.isdir(path) else [""]
    paths = [os.path.join(path, n) if n else path for n in names]
    shapes = [np.load(p, mmap_mode="r").shape for p in paths]
    if any(len(s) != 2 for s in shapes) or len({s[1] for s in shapes}) > 1:
        raise ValueError("two-dimensional arrays of one width are needed")
    first = np.cumsum([0, *(s[0] for s in shapes)])

    def read(a: int, z: int) -> np.ndarray:
        i, j = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, z)
        return np.concatenate([np.load(paths[k], mmap_mode="r")[max(a - first[k], 0) : z - first[k]] for k in range(i, j)])

    return _ranges(spark, int(first[-1]) if rows is None else min(int(first[-1]), rows), read)


def to_npy(df: DataFrame, folder: str, dtype: str = "float32") -> int:
    """Writes the column embedding in order of vec_id as .npy files of one new folder that all executors can open; the rows written.

    Every task writes its range of ids, a file for each Arrow batch; a file appears whole or not at all, so a task can
    be run again. Rows of an equal vec_id are ordered by their vectors' hash, null ids come first. Null vectors or
    ones of different lengths raise; from_npy then refuses the folder. An empty table gives a folder without arrays."""
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(b for b in batches if b.num_rows):
            column = b.column("embedding")
            if column.null_count or len(pc.unique(pc.list_value_length(column))) > 1:
                raise ValueError("vectors of one length are needed")
            x = column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(b.num_rows, -1)
            started = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(started, "wb") as f:
                np.save(f, x)
            os.replace(started, os.path.join(folder, f"part-{part:08d}-{k:08d}.npy"))
            yield batch(rows=np.array([b.num_rows]), width=np.array([x.shape[1]]))

    order = ["vec_id", F.xxhash64("embedding")]
    rows = df.select("vec_id", "embedding").repartitionByRange(*order).sortWithinPartitions(*order).select("embedding")
    done = rows.mapInArrow(run, "rows long, width long").agg(F.sum("rows").alias("n"), F.min("width").alias("least"), F.max("width").alias("most")).first()
    if done["least"] != done["most"]:
        raise ValueError("vectors of one length are needed")
    open(os.path.join(folder, "_SUCCESS"), "wb").close()
    return done["n"] or 0


def _ranked(df: DataFrame, key: list[str], tag: str) -> tuple[DataFrame, dict[int, int]]:
    """df in ranges of key, written once with `part` and `place` (within the part, from 0), and how many rows stand before each part.

    One pass orders and counts, a second has each part's start: the driver sees a count for each part."""
    parts = df.repartitionByRange(*key).withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1
    rows = checkpointed(checkpointed(parts, f"{tag}-ranges").withColumn("place", place.cast("long")), tag)
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    return rows, before


def _start(before: dict[int, int]) -> Column:
    """The rows before this row's part, from at most as many values as there are parts."""
    starts = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)) if before else F.create_map().cast("map<bigint,bigint>")
    return F.element_at(starts, F.col("part").cast("long"))


def to_csr_npy(knn: DataFrame, folder: str) -> int:
    """Writes data, indices and indptr of a self-kNN (id, rank, nbr, dist) as .npy files of a new folder that all executors can open; the entries written.

    Rows and columns are positions of sorted ids, entries in order of rank, as sinks.to_csr has them on the driver. Positions
    and starts of rows come from prefix sums over ranges of ids, so no task and no driver holds the graph; a
    file appears whole or not at all. from_csr_npy refuses a folder that was not finished. Ids have a row of rank 0 each."""
    os.makedirs(folder)
    ids, first = _ranked(knn.where("rank = 0").select("id"), ["id"], "csr-ids")
    ids = checkpointed(ids.select("id", (_start(first) + F.col("place")).alias("at")), "csr-positions")
    entries = knn.join(ids.withColumnRenamed("at", "row"), "id").join(ids.select(F.col("id").alias("nbr"), F.col("at").alias("col")), "nbr")
    rows, before = _ranked(entries.select("row", "rank", "col", "dist"), ["row", "rank"], "csr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in batches:
            part, place = b.column("part").to_numpy(), b.column("place").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                own = slice(i, j)
                head = np.flatnonzero(b.column("rank").to_numpy()[own] == 0)  # each row begins with itself
                for kind, x in (("data", b.column("dist").to_numpy()[own]), ("indices", b.column("col").to_numpy()[own]), ("indptr", place[own][head])):
                    started = os.path.join(folder, f".{uuid.uuid4().hex}")
                    with open(started, "wb") as f:
                        np.save(f, x)
                    os.replace(started, os.path.join(folder, f"{kind}-{part[i]:08d}-{k:08d}.npy"))
                k += 1
            yield batch(rows=np.array([len(part)]))

    placed = rows.withColumn("place", _start(before) + F.col("place")).repartition("part").sortWithinPartitions("part", "place")
    n = placed.select("part", "place", "rank", "col", "dist").mapInArrow(run, "rows long").agg(F.sum("rows").alias("n")).first()["n"] or 0
    np.save(os.path.join(folder, "indptr-end.npy"), np.array([n]))
    open(os.path.join(folder, "_SUCCESS"), "wb").close()
    return n


def from_csr_npy(folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, indices, indptr) of a folder that to_csr_npy has finished, for clients that hold a graph in memory."""
    if not os.path.exists(os.path.join(folder, "_SUCCESS")):
        raise ValueError(f"{folder} is not a finished folder of arrays")
    kinds = (sorted(x for x in os.listdir(folder) if x.startswith(f"{kind}-")) for kind in ("data", "indices", "indptr"))
    return tuple(np.concatenate([np.load(os.path.join(folder, x)) for x in names]) if names else np.zeros(0) for names in kinds)


def from_hdf5(spark: SparkSession, path: str, dataset: str = "train", rows: int | None = None) -> DataFrame:
    """The first `rows` rows of a dataset of an HDF5 file that all executors can open; needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py; convert the file to Parquet or .npy") from e
    with h5py.File(path, "r") as f:
        n = f[dataset].shape[0]

    def read(a: int, z: int) -> np.ndarray:
        import h5py

        with h5py.File(path, "r") as f:
            return f[dataset][a:z]

    return _ranges(spark, min(n, rows or n), read)
