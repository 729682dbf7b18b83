"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stage

#: Edges that a shuffle's partition is meant to hold.
PART_EDGES = 1 << 14


@contextmanager
def partitions_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer shuffle partitions than the session's where few rows go through, as a round has many small shuffles."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(int(was), math.ceil(rows / PART_EDGES)))))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) to (node, root): root is the least node that node reaches, for each node but the roots.

    Self-loops, repeated edges and either direction are fine. Each round is written to the
    shared folder; a node with very many edges only ever meets its own minimum, so Spark
    may split it over tasks. Rounds end when every edge leads from a node with no other to
    one that has none.
    """
    spark = edges.sparkSession
    star = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star")
    while True:
        rows = star.count()
        with partitions_for(spark, 2 * rows):
            ends = star.select(F.col("a").alias("u"), F.lit(1).alias("out")).unionAll(star.select(F.col("b").alias("u"), F.lit(0).alias("out")))
            ends = ends.groupBy("u").agg(F.sum("out").alias("out"), F.count("*").alias("all"))
            if not rows or ends.where("out > 1 OR (out = 1 AND all > 1)").limit(1).count() == 0:
                return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
            both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            least = stage(least, "star-least")  # a join of two plain exchanges is one that Spark can split
            large = stage(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "star")
            discard(star, least)
            least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "star-least")
            small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            star = stage(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "star")
            discard(large, least)
