"""Calendar features of a timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.config import WEEK

NAMES = ("day_of_week_sin", "day_of_week_cos", "hour_of_day_sin", "hour_of_day_cos", "minute_of_day_sin", "minute_of_day_cos", "is_weekend", "rushhour", "is_holiday")
RUSH_HOURS = (7, 8, 9, 16, 17, 18)


def minute_of_week(ts: str = "ts") -> Column:
    """Minutes since Monday's midnight."""
    return (F.weekday(F.col(ts)) * 1440 + F.hour(F.col(ts)) * 60 + F.minute(F.col(ts))).cast("int")


def week_bin(minutes: Column, size: int) -> Column:
    return (F.floor(minutes / size) * size).cast("int")


def add_time_features(rows: DataFrame, holidays: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """rows with the calendar columns; is_holiday only if holidays(day) are given."""
    day, hour = F.weekday(F.col(ts)), F.hour(F.col(ts))
    minute = hour * 60 + F.minute(F.col(ts))
    for name, value, period in (("day_of_week", day, 7), ("hour_of_day", hour, 24), ("minute_of_day", minute, 1440)):
        turn = value.cast("double") * (2 * math.pi / period)
        rows = rows.withColumns({f"{name}_sin": F.sin(turn), f"{name}_cos": F.cos(turn)})
    rows = rows.withColumns({"is_weekend": day.isin(5, 6).cast("int"), "rushhour": hour.isin(*RUSH_HOURS).cast("int")})
    if holidays is None:
        return rows
    days = F.broadcast(holidays.select(F.col("day").alias("__day")).distinct())
    return rows.join(days, F.to_date(F.col(ts)) == F.col("__day"), "left").withColumn("is_holiday", F.col("__day").isNotNull().cast("int")).drop("__day")


def bin_ahead(minutes: Column, ahead: int, size: int) -> Column:
    """The bin that many minutes later, around the week's end."""
    return week_bin((minutes + ahead) % WEEK, size)
