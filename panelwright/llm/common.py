"""Helpers shared by the corpus operators: table reads, bounds of broadcasts, id joins; scratch tables are written by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.scratch import discard, new_folder, written

new_path, stage = new_folder, written

#: Most rows of a side that may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 500_000
#: Most bytes of its strings.
BROADCAST_BYTES = 32 << 20
#: Rows and bytes of one Arrow batch; texts can be long, so a batch stays small.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings of the Arrow operators: small batches bound a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: name, with underscores in front as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its rows and the bytes of its strings are within the bounds, else unchanged.

    Without strings, rows may give the count.
    """
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    if rows is None or wide:
        sizes = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c in wide]
        rows, *held = df.agg(F.count("*"), *sizes).first()
        if sum(held) > BROADCAST_BYTES:
            return df
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_lists(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """texts(id, h, ...) with the columns of lists(id, h, ...), which may be wide.

    Lists are never broadcast, only their keys are, if they are few; so the shuffle gets
    the texts that have a list and no others.
    """
    lists = lists.withColumnsRenamed({"id": "__id", "h": "__h"})
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
    keys = lists.select("__id", "__h")
    bounded = small(keys)
    if bounded is not keys:
        texts = texts.join(bounded, same, "left_semi")
    return texts.join(lists, same).drop("__id", "__h")
