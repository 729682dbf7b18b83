"""Choosing feature columns: correlation with targets, gain, and whose columns they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.timefeat import NAMES

from .sizes import bounded


def is_own(name: Column, sid: Column) -> Column:
    """A column of the sensor itself or of the calendar. Neighbour columns end in an index, so they are not."""
    return (name == sid) | F.endswith(name, F.concat(F.lit("_"), sid)) | name.isin(*NAMES)


def column_moments(features: DataFrame, n_train: int) -> DataFrame:
    """Per column on train rows: n, mean, and sxx, the centred sum of squares; nulls count as the mean."""
    rows = features.where(F.col("pos") < n_train)
    return rows.groupBy("column_name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.coalesce(F.var_pop("value"), F.lit(0.0)) * F.count("value")).alias("sxx"))


def correlations(features: DataFrame, targets: DataFrame, n_train: int) -> DataFrame:
    """Absolute correlation of each column with each target on train rows: (sid, column_name, score).

    targets(sid, pos, y). A null value acts as its column's mean, so only rows with a value
    add to the cross product; the target's spread is over all train rows. 0 if undefined.
    The long rows meet the targets' values by position, and one aggregation by column and
    target merges centred co-moments, so that large means cancel nothing; it is combined on
    the map side, and the shuffle has a row for each column, target and partition.
    """
    train = targets.where(F.col("pos") < n_train).select("sid", "pos", F.col("y").cast("double").alias("y"))
    spread = train.groupBy("sid").agg((F.var_pop("y") * F.count("y")).alias("syy"))  # a row a target
    met = features.where(F.col("pos") < n_train).join(train, "pos")
    both = F.count(F.when(F.col("value").isNotNull() & F.col("y").isNotNull(), 1))
    # the values are centred by their own mean, so the mean that the targets are centred by doesn't matter
    sums = met.groupBy("column_name", "sid").agg((F.covar_pop("value", "y") * both).alias("sxy"), (F.var_pop("value") * F.count("value")).alias("sxx"))
    below = F.sqrt(F.col("sxx") * F.col("syy"))
    score = F.when(below > 0, F.coalesce(F.abs(F.col("sxy") / below), F.lit(0.0))).otherwise(0.0)
    return sums.join(bounded(spread), "sid").select("sid", "column_name", score.alias("score"))


def prefilter(scores: DataFrame, columns: DataFrame, top_k: int) -> DataFrame:
    """(sid, column_name): own and calendar columns, filled up to top_k by score; ties to the later column.

    columns(column_name, col_idx). With top_k columns or fewer, all stay.
    """
    rows = scores.join(columns, "column_name").withColumn("own", is_own(F.col("column_name"), F.col("sid")))
    rank = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("own"), F.desc("score"), F.desc("col_idx")))
    rows = rows.withColumns({"rank": rank, "n_own": F.sum(F.col("own").cast("int")).over(Window.partitionBy("sid"))})
    return rows.where(F.col("rank") <= F.greatest(F.lit(top_k), F.col("n_own"))).select("sid", "column_name", "own", "score")


def rank_own_and_cross(columns: DataFrame, gain: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """columns with rank and n_own: own columns in order, then others by gain; no gain is 0, ties in order.

    columns(keys, column_name, col_idx), gain(keys, column_name, gain); sid is one of the keys.
    """
    rows = columns.join(gain.select(*keys, "column_name", "gain"), [*keys, "column_name"], "left").withColumn("own", is_own(F.col("column_name"), F.col("sid")))
    by = Window.partitionBy(*keys).orderBy(F.desc("own"), F.when(F.col("own"), 0.0).otherwise(-F.coalesce("gain", F.lit(0.0))), "col_idx")
    return rows.withColumns({"rank": F.row_number().over(by), "n_own": F.sum(F.col("own").cast("int")).over(Window.partitionBy(*keys))})


def select_own_and_cross(columns: DataFrame, gain: DataFrame, nfeat: int) -> DataFrame:
    """(sid, column_name, rank): own columns in order, then others by gain up to nfeat in all."""
    rows = rank_own_and_cross(columns, gain)
    return rows.where(F.col("rank") <= F.greatest(F.lit(nfeat), F.col("n_own"))).select("sid", "column_name", "rank")


def select_top(columns: DataFrame, gain: DataFrame, nfeat: int, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, column_name, rank): nfeat columns by gain, filled with the rest in order. gain(keys, column_name, seq, gain)."""
    if nfeat <= 0:
        raise ValueError("nfeat must be positive")
    rows = columns.join(gain, [*keys, "column_name"], "left")
    by = Window.partitionBy(*keys).orderBy(F.col("gain").isNull(), F.desc("gain"), F.coalesce("seq", "col_idx"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= nfeat).select(*keys, "column_name", "rank")


def known_gain(gain: DataFrame, columns: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """gain of the columns that a frame has."""
    return gain.join(columns.select(*keys, "column_name"), [*keys, "column_name"], "left_semi")
