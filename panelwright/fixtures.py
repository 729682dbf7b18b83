"""Panels derived from the star-schema tables, and the graph of their sensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_SID = 100_000


def _sid(idx) -> F.Column:
    return (idx + FIRST_SID).cast("string")


def hourly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """readings(ts, sid, speed) from events: an hour and a tenth of the users each."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    cells = events.groupBy(ts.alias("ts"), (F.col("user_id") % 10).alias("idx")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"), F.count("*").alias("n"))
    speed = F.greatest(F.lit(0.0), F.lit(70.0) - F.col("cents").cast("double") / (F.col("n").cast("double") * 200.0))
    return cells.select("ts", _sid(F.col("idx")).alias("sid"), speed.alias("speed"))


def weekly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """readings(ts, sid, speed) from line items: a week and a supplier each."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ts = F.date_trunc("week", F.col("l_shipdate")).cast("timestamp_ntz")
    cells = items.groupBy(ts.alias("ts"), F.col("l_suppkey").alias("idx")).agg(F.sum(F.round("l_quantity").cast("bigint")).alias("units"), F.count("*").alias("n"))
    speed = F.greatest(F.lit(0.0), F.lit(70.0) - F.lit(1.5) * F.col("units").cast("double") / F.col("n").cast("double"))
    return cells.select("ts", _sid(F.col("idx")).alias("sid"), speed.alias("speed"))


def hourly_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensors(sid, idx) of hourly_readings, from the ids alone."""
    return _sensors(spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 10).alias("idx")))


def weekly_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensors(sid, idx) of weekly_readings, from the ids alone."""
    return _sensors(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("idx")))


def _sensors(ids: DataFrame) -> DataFrame:
    return ids.distinct().select(_sid(F.col("idx")).alias("sid"), F.col("idx").cast("int").alias("idx"))


def edges_of(sensors: DataFrame) -> DataFrame:
    """edges(src, dst, weight): self-loops, each to the next, even ones to the third next, among the sensors."""
    most = sensors.agg(F.max("idx").alias("most"))
    ends = F.when(F.col("idx") % 2 == 0, F.array(F.col("idx"), F.col("idx") + 1, F.col("idx") + 3)).otherwise(F.array(F.col("idx"), F.col("idx") + 1))
    out = sensors.select("sid", F.explode(ends).alias("to")).join(F.broadcast(most), F.col("to") <= F.col("most"))  # one row
    known = sensors.select(F.col("sid").alias("dst"), F.col("idx").alias("to"))
    return out.join(known, "to").select(F.col("sid").alias("src"), "dst", F.lit(1.0).alias("weight"))


def holidays(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (DATE'2024-01-01'), (DATE'2024-01-15') AS t(day)")


def hourly_targets(sensors: DataFrame) -> DataFrame:
    return sensors.where("idx IN (3, 5, 7, 9)").select("sid")


def weekly_targets(sensors: DataFrame) -> DataFrame:
    return sensors.where("idx % 25 = 3").select("sid")
