"""Results out: coordinate form, arrays for each point, CSR arrays, and JSON records merged by key."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.session import checkpointed

#: Folder key of the versions that upsert_json writes.
VERSION = "record_version"


def to_coo(knn: DataFrame) -> DataFrame:
    """(row, col, value, rank) of (id, rank, nbr, dist): k + 1 explicit entries a row, the point itself first at 0."""
    return knn.select(F.col("id").alias("row"), F.col("nbr").alias("col"), F.col("dist").alias("value"), "rank")


def to_arrays(knn: DataFrame) -> DataFrame:
    """(id, indices, distances), nearest first."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "nbr", "dist")))
    return knn.groupBy("id").agg(rows.alias("r")).select("id", F.col("r.nbr").alias("indices"), F.col("r.dist").alias("distances"))


def to_csr(knn: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, indices, indptr) of a graph that the caller knows to fit the driver; rows and columns by position of sorted ids."""
    rows = knn.select("id", "rank", "nbr", "dist").toPandas().sort_values(["id", "rank"])
    ids, start = np.unique(rows["id"].to_numpy(), return_index=True)
    return rows["dist"].to_numpy(), np.searchsorted(ids, rows["nbr"].to_numpy()), np.append(start, len(rows))


def padded(knn: DataFrame, k: int, self_edges: bool = True) -> DataFrame:
    """Every id filled up to ranks 0..k: with (itself, 0) in self-kNN, else with its last neighbour (ranks 1..k)."""
    knn = checkpointed(knn.select("id", "rank", "nbr", "dist"), "knn")  # read twice
    last = knn.groupBy("id").agg(F.max_by(F.struct("nbr", "dist"), "rank").alias("last"))
    grid = last.select("id", "last", F.explode(F.sequence(F.lit(0 if self_edges else 1), F.lit(k))).alias("rank"))
    fill = F.struct(F.col("id").alias("nbr"), F.lit(0.0).alias("dist")) if self_edges else F.col("last")
    return grid.join(knn, ["id", "rank"], "left").select("id", "rank", F.coalesce("nbr", fill["nbr"]).alias("nbr"), F.coalesce("dist", fill["dist"]).alias("dist"))


def merge_records(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new brings, and new; in order of the keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(*keys)


def _versions(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    try:
        found = spark.read.json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, None
    last = found.agg(F.max(VERSION).alias("n")).first()["n"]
    return last, found.where(F.col(VERSION) == last).drop(VERSION)


def read_json_records(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of the last version at path; None if there is none."""
    return _versions(spark, path)[1]


def upsert_json(new: DataFrame, path: str, keys: list[str]) -> int:
    """Merges new into the JSON records at path by keys, as a new version beside the last, and returns its number.

    Nothing that is read is overwritten: a job that dies leaves the last version as it is, and of two that write at
    once the later fails. Old columns take the types of new ones of the same name; columns on one side only are
    null on the other. If there are no records on either side nothing is written (-1)."""
    if VERSION in new.columns:
        raise ValueError(f"the column name {VERSION} is taken")
    last, old = _versions(new.sparkSession, path)
    if old is None and new.isEmpty():
        return last
    if old is not None:
        kinds = dict(new.dtypes)
        old = old.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in old.columns))
        new = merge_records(old, new, keys)
    new.write.json(f"{path}/{VERSION}={last + 1}")
    return last + 1
