"""Session helpers: executors get the package that the driver runs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each Spark application; its Python tasks import it."""
    sc = spark.sparkContext
    if getattr(sc, "_vecloom_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="vecloom-"), "vecloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    sc.addPyFile(path)
    sc._vecloom_shipped = True
    return spark


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder: spark.checkpoint.dir, or a local one where it is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "vecloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df written once to the shared folder, in folders by column `by` if given, and read back: lost executors cost no recomputation of what came before."""
    path = shared_path(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, key: str, buckets: int, path: str | None = None, mode: str = "error") -> DataFrame:
    """df as a table of `buckets` sorted buckets by key, one file each, in the shared folder or at path: what joins or groups by key reads it without an exchange."""
    spark = df.sparkSession
    name = f"vecloom_{tag}_{uuid.uuid4().hex[:12]}"
    rows = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    rows.format("parquet").option("path", path or shared_path(spark, tag)).mode(mode).saveAsTable(name)
    return spark.table(name)


def bucketed_at(spark: SparkSession, path: str, tag: str, key: str, buckets: int) -> DataFrame:
    """The table that bucketed() wrote to path, also in a session that does not know it yet."""
    name = f"vecloom_{tag}_{uuid.uuid4().hex[:12]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
