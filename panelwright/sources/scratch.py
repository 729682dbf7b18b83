"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of a local session. A cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_panelwright_dir", None)
        if base is None:
            base = spark._panelwright_dir = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows as a written table: what follows neither plans nor computes them again, and outlives lost executors.

    With by, a folder for each value, so that a filter on them reads that one alone.
    """
    path = new_folder(rows.sparkSession, name)
    if by:
        rows.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    else:
        rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that written wrote; nothing may read them any more."""
    for rows in tables:
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(rows._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
