"""Time-of-week profiles: means of train rows by bin, looked up for every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.config import PanelConfig
from panelwright.functions.timefeat import bin_ahead, minute_of_week, week_bin

from .clean import share


def profile(panel: DataFrame, column: str, config: PanelConfig) -> DataFrame:
    """profile(sid, bin, mean) of train rows, nulls left out."""
    rows = panel.where(F.col("pos") < share(F.col("n"), config.train_share))
    return rows.groupBy("sid", week_bin(minute_of_week(), config.bin_minutes).alias("bin")).agg(F.avg(column).alias("mean"))


def add_congestion_profile(panel: DataFrame, horizon: int, config: PanelConfig) -> DataFrame:
    """panel with tow_cong_prob, and tow_cong_prob_ahead for the bin at the target's time; an unseen bin is null."""
    table = profile(panel, "label", config)
    now = table.select("sid", F.col("bin").alias("__now"), F.col("mean").alias("tow_cong_prob"))
    ahead = table.select("sid", F.col("bin").alias("__ahead"), F.col("mean").alias("tow_cong_prob_ahead"))
    rows = panel.withColumns({"__now": week_bin(minute_of_week(), config.bin_minutes), "__ahead": bin_ahead(minute_of_week(), horizon, config.bin_minutes)})
    return rows.join(now, ["sid", "__now"], "left").join(ahead, ["sid", "__ahead"], "left").drop("__now", "__ahead")


def add_speed_residual(panel: DataFrame, config: PanelConfig) -> DataFrame:
    """panel with speed_residual: the speed less its bin's mean."""
    table = profile(panel, "speed", config).select("sid", F.col("bin").alias("__now"), F.col("mean").alias("__mean"))
    rows = panel.withColumn("__now", week_bin(minute_of_week(), config.bin_minutes))
    return rows.join(table, ["sid", "__now"], "left").withColumn("speed_residual", F.col("speed") - F.col("__mean")).drop("__now", "__mean")
