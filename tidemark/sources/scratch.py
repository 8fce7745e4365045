"""Scratch tables in the folder that the cluster names in ``spark.checkpoint.dir``.

It is shared by the driver and all executors, so a table written there cuts lineage and outlives a lost executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; where the session names none, a new local one (tests and local mode only)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the session's JVM ends."""
    path = f"{scratch_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these tables, once nothing reads them any more."""
    for table in tables:
        spark, path = table.sparkSession, table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no plan needs any more; it does so when the driver's JVM collects its garbage."""
    spark._jvm.System.gc()
