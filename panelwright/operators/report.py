"""Importance reports: feature groups, roll-ups, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import bounded

SPATIAL = r"^(spd|cong|trans_on|trans_off|wspd|wcong)_h(\d+)_(\d+)$"
#: Beginnings of names that lose a numeric ending even if it is no known sensor.
NUMBERED = ("lag_", "roll_", "delta_", "acceleration_")


def with_group(rows: DataFrame, sensors: DataFrame, name: str = "column_name") -> DataFrame:
    """rows with feature_group, by the first rule that fits.

    A known sensor's id; a neighbour measure by hop; a name with a known sensor's id at its
    end; a numbered window name; digits alone; else the name itself.
    """
    col = F.col(name)
    tail = F.regexp_extract(col, r"_(\d+)$", 1)
    known = bounded(sensors.select(F.col("sid").alias("__sid")).distinct())
    rows = rows.withColumn("__end", F.when(col.rlike(r"^\d+$"), col).otherwise(tail))
    rows = rows.join(known, F.col("__end") == F.col("__sid"), "left")
    is_known = F.col("__sid").isNotNull()
    stem = F.regexp_extract(col, r"^(.+)_\d+$", 1)
    numbered = (stem != "") & F.array_contains(F.transform(F.array(*map(F.lit, NUMBERED)), lambda p: F.startswith(col, p)), True)
    group = (
        F.when(is_known & (col == F.col("__sid")), "sensor_current_speed")
        .when(col.rlike(SPATIAL), F.concat(F.lit("spatial_"), F.regexp_extract(col, SPATIAL, 1), F.lit("_h"), F.regexp_extract(col, SPATIAL, 2)))
        .when(is_known, F.concat(F.lit("sensor_"), F.expr(f"substring(`{name}`, 1, length(`{name}`) - length(__end) - 1)")))
        .when(numbered, F.concat(F.lit("sensor_"), stem))
        .when(col.rlike(r"^\d+$"), "sensor_current_speed")
        .otherwise(col)
    )
    return rows.withColumn("feature_group", group).drop("__end", "__sid")


def group_gain(gain: DataFrame, sensors: DataFrame, kind: str = "gain") -> DataFrame:
    """Per model (sid), variant, horizon and group: sum, count and mean of gain. gain(variant, horizon_min, sid, column_name, gain)."""
    rows = with_group(gain, sensors).groupBy("variant", "horizon_min", "sid", "feature_group")
    out = rows.agg(F.sum("gain").alias("sum_importance"), F.count("*").alias("n_columns"), F.avg("gain").alias("model_mean_importance"))
    return out.withColumn("importance_type", F.lit(kind))


def group_selection(selected: DataFrame, sensors: DataFrame) -> DataFrame:
    """Per model and group: how many columns were selected."""
    return with_group(selected, sensors).groupBy("variant", "horizon_min", "sid", "feature_group").agg(F.count("*").alias("selected_count"))


def importance_report(grouped: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Roll-up over models, with selection counts and their share of the largest in a (variant, horizon)."""
    keys = ["variant", "horizon_min", "importance_type", "feature_group"]
    out = grouped.groupBy(*keys).agg(F.sum("sum_importance").alias("sum_importance"), F.sum("n_columns").alias("n_columns"), F.count("model_mean_importance").alias("n_models_with_feature"))
    out = out.withColumn("mean_importance", F.col("sum_importance") / F.col("n_columns"))
    if selection is None:
        out = out.withColumns({"selected_count": F.lit(0).cast("bigint"), "selected_count_norm": F.lit(0.0)})
    else:
        counts = selection.groupBy("variant", "horizon_min", "feature_group").agg(F.sum("selected_count").alias("selected_count"))
        most = F.max("selected_count").over(Window.partitionBy("variant", "horizon_min"))
        counts = counts.withColumn("selected_count_norm", F.when(most == 0, 0.0).otherwise(F.col("selected_count") / most))
        out = out.join(counts, ["variant", "horizon_min", "feature_group"], "left")
        out = out.withColumns({"selected_count": F.coalesce("selected_count", F.lit(0)).cast("bigint"), "selected_count_norm": F.coalesce("selected_count_norm", F.lit(0.0))})
    order = ["variant", "horizon_min", "importance_type"]
    return out.select("variant", "horizon_min", "importance_type", "feature_group", "mean_importance", "sum_importance", "n_columns", "n_models_with_feature", "selected_count", "selected_count_norm").orderBy(*order, F.desc("mean_importance"))


def local_suffix(name: Column, sid: Column) -> Column:
    """A column's name without its sensor; null if the sensor isn't in it."""
    cut = F.substr(name, F.lit(1), F.length(name) - F.length(sid) - 1)
    return F.when(name == sid, "__current_speed__").when(F.endswith(name, F.concat(F.lit("_"), sid)), cut).when(F.contains(name, sid), F.replace(name, sid, F.lit("{sid}")))


def horizon_suffixes(gain: DataFrame) -> DataFrame:
    """(transition_weight, horizon_min, suffix, score, rank): gain by suffix, summed over sensors."""
    rows = gain.withColumn("suffix", local_suffix(F.col("column_name"), F.col("sid"))).where("suffix IS NOT NULL")
    out = rows.groupBy("transition_weight", "horizon_min", "suffix").agg(F.sum("gain").alias("score"), F.min("seq").alias("seq"))
    by = Window.partitionBy("transition_weight", "horizon_min").orderBy(F.desc("score"), "seq", "suffix")
    return out.withColumn("rank", F.row_number().over(by)).drop("seq")


def common_params(params: DataFrame) -> DataFrame:
    """Per (transition_weight, horizon_min): the parameter set that most models have, the first seen of ties. params(..., seq, params map)."""
    rows = params.withColumn("params", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params")))))
    out = rows.groupBy("transition_weight", "horizon_min", "params").agg(F.count("*").alias("n_models"), F.min("seq").alias("seq"))
    by = Window.partitionBy("transition_weight", "horizon_min").orderBy(F.desc("n_models"), "seq")
    return out.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k", "seq")
