"""From readings to a dense positional panel with labels, targets and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.config import PanelConfig

from .chunks import quantiles, ranked
from .sizes import bounded


def by_sid():
    """The window that all per-sensor features share."""
    return Window.partitionBy("sid").orderBy("pos")


def rows_between(first: int, last: int):
    return by_sid().rowsBetween(first, last)


def zero_to_null(readings: DataFrame) -> DataFrame:
    """An exact zero is a missing speed."""
    return readings.withColumn("speed", F.when(F.col("speed") != 0, F.col("speed")))


def zero_report(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """n_zero, n_cells (all times by all sensors, empty ones too) and percent of zeros."""
    found = readings.agg(F.count_if(F.col("speed") == 0).alias("n_zero"), F.count_distinct("ts").alias("n_ts"))
    width = sensors.agg(F.count("*").alias("n_sensors"))
    out = found.join(F.broadcast(width)).withColumn("n_cells", F.col("n_ts") * F.col("n_sensors"))
    return out.select("n_zero", "n_cells", F.when(F.col("n_cells") == 0, 0.0).otherwise(100.0 * F.col("n_zero") / F.col("n_cells")).alias("percent"))


def time_axis(readings: DataFrame, sensors: DataFrame, config: PanelConfig) -> DataFrame:
    """axis(ts, pos, n): times that survive, ranked from 0, and how many there are.

    With zeros as missing, a time goes if all its sensors are missing; else if any is.
    """
    seen = readings.groupBy("ts").agg(F.count("speed").alias("k"))
    if config.zero_missing:
        seen = seen.where("k > 0")
    else:
        seen = seen.join(F.broadcast(sensors.agg(F.count("*").alias("all"))), F.col("k") == F.col("all"))
    if config.chunk_rows:
        return ranked(seen.select("ts"), ["ts"])
    # one value a time: the axis is ordered, never the panel
    axis = seen.agg(F.array_sort(F.collect_list("ts")).alias("axis"))
    return axis.select(F.posexplode("axis").alias("pos", "ts"), F.size("axis").alias("n")).select("ts", F.col("pos").cast("bigint").alias("pos"), F.col("n").cast("bigint").alias("n"))


def dense_panel(readings: DataFrame, sensors: DataFrame, config: PanelConfig) -> DataFrame:
    """panel(sid, idx, pos, ts, n, speed): every surviving time for every sensor."""
    if config.zero_missing:
        readings = zero_to_null(readings)
    grid = time_axis(readings, sensors, config).crossJoin(bounded(sensors.select("sid", "idx")))
    return grid.join(readings.select("ts", "sid", "speed"), ["ts", "sid"], "left").select("sid", "idx", "pos", "ts", "n", "speed")


def share(n: Column, part: float) -> Column:
    """floor(n * part) in double arithmetic."""
    return F.floor(n.cast("double") * F.lit(part).cast("double"))


def thresholds(panel: DataFrame, config: PanelConfig, train_only: bool | None = None) -> DataFrame:
    """thresholds(sid, thr): a share of the speed's quantile on train rows (or all rows)."""
    train_only = config.train_threshold if train_only is None else train_only
    rows = panel.where(F.col("pos") < share(F.col("n"), config.train_share)) if train_only else panel
    if config.chunk_rows:
        known = rows.select("sid").distinct().join(quantiles(rows.select("sid", "speed"), "speed", config.quantile), "sid", "left")
        return known.select("sid", (F.col("value") * config.threshold_share).alias("thr"))
    return rows.groupBy("sid").agg((F.percentile("speed", config.quantile) * config.threshold_share).alias("thr"))


def label(panel: DataFrame, limits: DataFrame) -> DataFrame:
    """panel with label: 1 where the speed is below its sensor's threshold; a missing speed is 0."""
    out = panel.join(limits, "sid", "left")  # by the sensor, as the windows that follow are
    return out.withColumn("label", F.coalesce((F.col("speed") < F.col("thr")).cast("int"), F.lit(0))).drop("thr")


def build_panel(readings: DataFrame, sensors: DataFrame, config: PanelConfig) -> DataFrame:
    """The whole of the steps above: panel(sid, idx, pos, ts, n, speed, label)."""
    panel = dense_panel(readings, sensors, config)
    return label(panel, thresholds(panel, config))


def head(panel: DataFrame, config: PanelConfig) -> DataFrame:
    """The panel's first rows, with n as what is left; experiments leave out the last few."""
    cut = share(F.col("n"), config.head_share)
    return panel.where(F.col("pos") < cut).withColumn("n", cut)


def only_targets(panel: DataFrame, targets: DataFrame, sensors: DataFrame | None = None) -> DataFrame:
    """Rows of the target sensors; a target that isn't among sensors (by default the panel's) is an error."""
    known = (panel if sensors is None else sensors).select("sid").distinct()
    unknown = [r[0] for r in targets.join(known, "sid", "left_anti").limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown target sensors: {unknown}")
    return panel.join(bounded(targets.select("sid")), "sid", "left_semi")


def future_target(steps: int) -> Column:
    """1 if any of the next rows is labelled; rows past the end don't count."""
    return F.coalesce(F.max("label").over(rows_between(1, steps)), F.lit(0))


def with_split(rows: DataFrame, steps: int | Column, config: PanelConfig) -> DataFrame:
    """rows with split (train, eval, test in time order), without rows whose target window of so many steps isn't whole."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    left = F.when((F.col("n") > steps) & F.lit(config.tail_drop), F.col("n") - steps).otherwise(F.col("n"))
    rows = rows.withColumn("m", left).where("pos < m")
    train = share(F.col("m"), config.train_share)
    check = train + share(F.col("m"), config.eval_share)
    return rows.withColumn("split", F.when(F.col("pos") < train, "train").when(F.col("pos") < check, "eval").otherwise("test")).drop("m")


def inner_validation(train: DataFrame, rows: int, config: PanelConfig) -> DataFrame:
    """train rows (positions from 0 to rows - 1) with is_val: the last tenth, one row at least, not all."""
    if rows < 2:
        raise ValueError("need two training rows at least for a split by time")
    cut = min(max(int(rows * (1 - config.inner_share)), 1), rows - 1)
    return train.withColumn("is_val", F.col("pos") >= cut)


def current_labels(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """rows(sid, pos, ...) with current_label from the panel, 0 where it has none."""
    own = panel.select("sid", "pos", F.col("label").alias("current_label"))
    return rows.join(own, ["sid", "pos"], "left").withColumn("current_label", F.coalesce("current_label", F.lit(0)))
