"""One query for each operation, over the panels derived from the given tables."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright import fixtures
from panelwright.config import HOURLY, PanelConfig
from panelwright.functions import timefeat
from panelwright.operators import clean, frames, graph, metrics, profiles, report, selection, training, windows
from panelwright.plans import jobs
from panelwright.sources import io
from panelwright.sources.scratch import new_folder, written

C: PanelConfig = HOURLY
#: The horizon of queries on a single one: 2 rows ahead.
H = 120
#: The same panel as if its axis were too long for a task a sensor.
LONG: PanelConfig = replace(C, chunk_rows=100)


class Hourly:
    """The hourly panel and what goes with it. What several steps of a query read is a written table, made when it is first asked for."""

    make = (fixtures.hourly_readings, fixtures.hourly_sensors, fixtures.hourly_targets)

    def __init__(self, spark: SparkSession, sf_dir: str, config: PanelConfig = C):
        readings, self._sensors, self._targets = self.make
        self.spark, self.config, self.sf_dir = spark, config, sf_dir
        self.readings = readings(spark, sf_dir)
        self.holidays = fixtures.holidays(spark)

    @cached_property
    def cells(self) -> DataFrame:
        """readings as a written table: a panel reads them four times, and the raw rows are scanned once."""
        return written(self.readings, "readings")

    @cached_property
    def sensors(self) -> DataFrame:
        return written(self._sensors(self.spark, self.sf_dir), "sensors")

    @cached_property
    def targets(self) -> DataFrame:
        return self._targets(self.sensors)

    @cached_property
    def edges(self) -> DataFrame:
        return written(fixtures.edges_of(self.sensors), "edges")

    @cached_property
    def panel(self) -> DataFrame:
        return written(clean.build_panel(self.cells, self.sensors, self.config), "panel")

    @cached_property
    def upstream(self) -> DataFrame:
        return written(graph.hop_sets(self.edges, self.config.hops, upstream=True), "hops")


class Weekly(Hourly):
    """The weekly panel, which grows with the tables."""

    make = (fixtures.weekly_readings, fixtures.weekly_sensors, fixtures.weekly_targets)


def tidy(rows: DataFrame) -> DataFrame:
    """Whole numbers as bigint, doubles to 6 digits, so that engines can be compared."""

    def one(name: str, kind: str):
        col = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint", "bigint"):
            col = col.cast("bigint")
        elif kind == "double":
            col = F.round(col, 6) + F.lit(0.0)
        return col.alias(name)

    return rows.select(*[one(n, k) for n, k in rows.dtypes])


QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
    return f


# sources and sinks


@query
def wide_csv_round_trip(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    sids = [r[0] for r in p.sensors.orderBy("idx").select("sid").collect()]
    path = new_folder(spark, "wide")
    io.write_wide(p.readings, sids, path)
    return io.to_long(io.read_wide(spark, path)).where("speed IS NOT NULL")


@query
def wide_csv_sensors(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    sids = [r[0] for r in p.sensors.orderBy("idx").select("sid").collect()]
    path = new_folder(spark, "wide")
    io.write_wide(p.readings, sids, path)
    wide = io.read_wide(spark, path)
    return io.to_long(wide).groupBy("sid").agg(F.count("speed").alias("n_readings"), F.count("*").alias("n_cells"))


@query
def graph_from_matrix(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    sids = [r[0] for r in p.sensors.orderBy("idx").select("sid").collect()]
    matrix = p.edges.groupBy("src").pivot("dst", sids).agg(F.first("weight")).na.fill(0.0)
    path = new_folder(spark, "graph")
    matrix.write.option("header", True).csv(f"{path}/matrix")
    p.sensors.write.option("header", True).csv(f"{path}/sensors")
    edges, _ = io.read_graph(spark, f"{path}/matrix", f"{path}/sensors", "csv")
    assert io.read_graph(spark, f"{path}/none", f"{path}/none") is None
    return edges


@query
def result_append(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    path = io.stamped(new_folder(spark, "results"), "naive")
    report_ = clean.zero_report(p.readings, p.sensors)
    io.append_results(report_, path)
    io.append_results(report_, path)
    return spark.read.option("header", True).schema(report_.schema).csv(path)


@query
def choices_json_lines(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    limits = clean.thresholds(clean.dense_panel(p.readings, p.sensors, C), C)
    rows = limits.select("sid", F.struct(F.col("thr").alias("threshold")).alias("params"), F.array(*map(F.lit, C.horizons)).alias("horizons"), F.lit("hourly").alias("dataset"))
    path = new_folder(spark, "choices")
    io.write_choices(rows, path)
    back = spark.read.schema("dataset string, horizons array<int>, params struct<threshold: double>, sid string").json(path)
    return back.select("dataset", F.array_join(F.transform("horizons", lambda h: h.cast("string")), " ").alias("horizons"), F.col("params.threshold").alias("threshold"), "sid")


@query
def importance_csv(spark, sf_dir):
    path = new_folder(spark, "importance")
    io.write_importance(_importance(spark, sf_dir), spark, path)
    return spark.read.option("header", True).schema(io.IMPORTANCE).csv(path)


# cleaning, labelling, splitting


@query
def zero_report(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return clean.zero_report(p.readings, p.sensors)


@query
def time_axis(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return clean.time_axis(clean.zero_to_null(p.readings), p.sensors, C)


@query
def time_axis_all_present(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return clean.time_axis(p.readings, p.sensors, replace(C, zero_missing=False))


@query
def thresholds(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    panel = clean.dense_panel(p.readings, p.sensors, C)
    whole = clean.thresholds(panel, C, train_only=False).withColumnRenamed("thr", "thr_all")
    return clean.thresholds(panel, C).join(whole, "sid")


@query
def labelled_panel(spark, sf_dir):
    return clean.head(Hourly(spark, sf_dir).panel, C)


@query
def target_splits(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, C)
    rows = clean.with_split(panel.withColumn("y", clean.future_target(C.steps(H))), C.steps(H), C)
    return rows.select("sid", "pos", "label", "y", "split")


@query
def inner_validation(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, C)
    train = clean.with_split(panel, C.steps(H), C).where("split = 'train'")
    n = train.select("pos").distinct().count()
    return clean.inner_validation(train, n, C).select("sid", "pos", "is_val")


@query
def current_labels(spark, sf_dir):
    panel = Hourly(spark, sf_dir).panel
    rows = panel.select("sid", (F.col("pos") + 5).alias("pos"))
    return clean.current_labels(rows, panel)


@query
def target_sensor_rows(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return clean.only_targets(p.panel, p.targets, p.sensors).groupBy("sid").agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_congested"))


# calendar


@query
def calendar_features(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return timefeat.add_time_features(clean.time_axis(clean.zero_to_null(p.readings), p.sensors, C).select("ts", "pos"), p.holidays)


@query
def week_bins(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    axis = clean.time_axis(clean.zero_to_null(p.readings), p.sensors, C)
    minutes = timefeat.minute_of_week()
    return axis.select("pos", minutes.alias("minute_of_week"), timefeat.week_bin(minutes, C.bin_minutes).alias("bin"), timefeat.bin_ahead(minutes, H, C.bin_minutes).alias("bin_ahead"))


# window features


def _with(spark, sf_dir, columns: dict) -> DataFrame:
    panel = clean.head(Hourly(spark, sf_dir).panel, C)
    return panel.withColumns(columns).select("sid", "pos", *columns)


@query
def speed_lags(spark, sf_dir):
    return _with(spark, sf_dir, windows.lags(H, C) | windows.long_lags(H, C))


@query
def rolling_windows(spark, sf_dir):
    return _with(spark, sf_dir, windows.rollings(C))


@query
def speed_changes(spark, sf_dir):
    return _with(spark, sf_dir, windows.changes(C))


@query
def congestion_windows(spark, sf_dir):
    return _with(spark, sf_dir, frames.own_congestion(H, C))


@query
def state_times(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, C)
    return windows.add_state_times(panel, C).select("sid", "pos", "minutes_in_state", "minutes_since_onset", "previous_episode_minutes")


@query
def naive_label_features(spark, sf_dir):
    return _with(spark, sf_dir, windows.naive_labels(H, C))


@query
def exponential_means(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, C)
    return windows.add_ema(panel, C).select("sid", "pos", *[f"ema_{m}min" for m in C.half_lives])


@query
def threshold_margin(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, C)
    return windows.add_margin(panel, C).select("sid", "pos", "margin", "margin_ratio")


@query
def congestion_profile(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, C)
    return profiles.add_congestion_profile(panel, H, C).select("sid", "pos", "tow_cong_prob", "tow_cong_prob_ahead")


@query
def speed_residual(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, C)
    return profiles.add_speed_residual(panel, C).select("sid", "pos", "speed_residual")


# the same in chunks of a long axis


@query
def time_axis_by_ranges(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return clean.time_axis(clean.zero_to_null(p.readings), p.sensors, LONG)


@query
def thresholds_by_ranges(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    panel = written(clean.dense_panel(p.readings, p.sensors, LONG), "dense")
    whole = clean.thresholds(panel, LONG, train_only=False).withColumnRenamed("thr", "thr_all")
    return clean.thresholds(panel, LONG).join(whole, "sid")


def _in_chunks(spark, sf_dir, columns: dict) -> DataFrame:
    panel = clean.head(Hourly(spark, sf_dir).panel, LONG)
    return frames.with_windows(panel, columns, H, LONG).select("sid", "pos", *columns)


@query
def speed_lags_in_chunks(spark, sf_dir):
    return _in_chunks(spark, sf_dir, windows.lags(H, LONG) | windows.long_lags(H, LONG))


@query
def rolling_windows_in_chunks(spark, sf_dir):
    return _in_chunks(spark, sf_dir, windows.rollings(LONG))


@query
def congestion_windows_in_chunks(spark, sf_dir):
    return _in_chunks(spark, sf_dir, frames.own_congestion(H, LONG))


@query
def state_times_in_chunks(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, LONG)
    return windows.add_state_times(panel, LONG).select("sid", "pos", "minutes_in_state", "minutes_since_onset", "previous_episode_minutes")


@query
def exponential_means_in_chunks(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, LONG)
    return windows.add_ema(panel, LONG).select("sid", "pos", *[f"ema_{m}min" for m in LONG.half_lives])


# graph


@query
def downstream_hops(spark, sf_dir):
    return graph.hop_sets(Weekly(spark, sf_dir).edges, C.hops)


@query
def upstream_hops(spark, sf_dir):
    return graph.hop_sets(Weekly(spark, sf_dir).edges, C.hops, upstream=True)


@query
def neighbour_means(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return graph.neighbour_means(p.panel, p.upstream, {"spd": "speed", "cong": "label"})


@query
def neighbour_waves(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return graph.neighbour_means(p.panel, p.upstream, {}, {"wspd": "speed", "wcong": "label"}, C.wave_rows)


@query
def neighbour_transitions(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return graph.neighbour_means(graph.onsets(p.panel, C.steps(H)), p.upstream, {"trans_on": "__on", "trans_off": "__off"})


@query
def origin_scores(spark, sf_dir):
    p = Weekly(spark, sf_dir)
    return graph.origin_scores(clean.build_panel(p.cells, p.sensors, p.config), p.edges, p.sensors)


@query
def top_origins(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return jobs.origins(p.cells, p.sensors, p.edges, C)


@query
def graph_alignment(spark, sf_dir):
    p = Weekly(spark, sf_dir)
    known = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal >= 0").select((F.col("s_suppkey") + fixtures.FIRST_SID).cast("string").alias("sid"))
    return graph.alignment(p.readings, known)


@query
def graph_order(spark, sf_dir):
    """Readings in order of their ids against a graph whose sensors go by nation."""
    p = Weekly(spark, sf_dir)
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    by_nation = Window.partitionBy().orderBy("s_nationkey", "s_suppkey")  # a row a sensor
    known = suppliers.select((F.col("s_suppkey") + fixtures.FIRST_SID).cast("string").alias("sid"), (F.row_number().over(by_nation) - 1).alias("idx"))
    own = p.sensors.select("sid", (F.row_number().over(Window.partitionBy().orderBy("idx")) - 1).alias("idx"))
    return graph.alignment(own, known)


@query
def graph_report(spark, sf_dir):
    p = Weekly(spark, sf_dir)
    return graph.graph_report(p.edges, p.sensors)


# frames


def _column_sums(long: DataFrame) -> DataFrame:
    return long.groupBy("column_name").agg(F.count("value").alias("n_values"), F.count("*").alias("n_rows"), F.sum("value").alias("total"))


def _row_sums(long: DataFrame) -> DataFrame:
    return long.groupBy("pos").agg(F.count("value").alias("n_values"), F.count("*").alias("n_rows"), F.sum("value").alias("total"))


def _local_long(spark, sf_dir) -> DataFrame:
    p = Hourly(spark, sf_dir)
    rows = clean.only_targets(clean.head(p.panel, C), p.targets, p.sensors)
    frame = frames.local_frame(rows, H, C, p.holidays)
    names = [*frames.feature_names(frame), "y"]
    doubles = frame.select("sid", "pos", *[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot(["sid", "pos"], names, "column_name", "value")


def _wide_long(spark, sf_dir) -> DataFrame:
    p = Hourly(spark, sf_dir)
    return frames.wide_frame(clean.head(p.panel, C), H, C, p.upstream, p.targets, p.holidays)


def _snapshot_long(spark, sf_dir) -> DataFrame:
    p = Hourly(spark, sf_dir)
    return frames.wide_frame(clean.head(p.panel, C), H, C, p.upstream, None, p.holidays, long_lags=True, snapshot_only=True)


@query
def local_frame_columns(spark, sf_dir):
    return _column_sums(_local_long(spark, sf_dir))


@query
def local_frame_rows(spark, sf_dir):
    return _row_sums(_local_long(spark, sf_dir))


@query
def wide_frame_columns(spark, sf_dir):
    return _column_sums(_wide_long(spark, sf_dir))


@query
def wide_frame_rows(spark, sf_dir):
    return _row_sums(_wide_long(spark, sf_dir))


@query
def snapshot_frame_columns(spark, sf_dir):
    return _column_sums(_snapshot_long(spark, sf_dir))


@query
def snapshot_frame_rows(spark, sf_dir):
    return _row_sums(_snapshot_long(spark, sf_dir))


@query
def features_with_target(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    panel = clean.head(p.panel, C)
    rows = panel.select("sid", (F.col("pos") + 3).alias("pos"), "speed")
    return frames.with_target(rows, panel, H, C)


# selection


def _speed_features(p: Hourly) -> DataFrame:
    """The long frame of speed features and calendar of the hourly panel."""
    panel = clean.head(p.panel, C)
    speed = frames.own_speed(H, C)
    return frames._melt(panel.withColumns(speed), ["speed", *speed], "sid")


def _correlations(p: Hourly) -> DataFrame:
    panel = clean.head(p.panel, C)
    n_train = int(panel.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] * C.train_share)
    ys = clean.only_targets(panel, p.targets).select("sid", "pos", clean.future_target(C.steps(H)).alias("y"))
    return selection.correlations(_speed_features(p), ys, n_train)


def _column_index(p: Hourly) -> DataFrame:
    """columns(column_name, col_idx) in order of their names."""
    from pyspark.sql import Window

    names = _speed_features(p).select("column_name").distinct()  # one row a column
    return names.withColumn("col_idx", F.row_number().over(Window.orderBy("column_name")) - 1)


@query
def column_moments(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    n = clean.head(p.panel, C).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return selection.column_moments(_speed_features(p), int(n * C.train_share))


@query
def target_correlations(spark, sf_dir):
    return _correlations(Hourly(spark, sf_dir))


def _rounded_gain(p: Hourly) -> DataFrame:
    """Correlations to 4 digits as gains, so that near-ties are ties in any engine; those under a tenth are no gain."""
    return _correlations(p).withColumn("gain", F.round("score", 4)).drop("score")


@query
def prefiltered_columns(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    scores = _rounded_gain(p).withColumnRenamed("gain", "score")
    return selection.prefilter(scores, _column_index(p), 40)


@query
def own_and_cross_columns(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    columns = p.targets.crossJoin(F.broadcast(_column_index(p)))
    return selection.select_own_and_cross(columns, _rounded_gain(p).where("gain >= 0.1"), 30)


@query
def top_gain_columns(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    index = _column_index(p)
    columns = p.targets.crossJoin(F.broadcast(index))
    gain = _rounded_gain(p).where("gain >= 0.1").join(index.withColumnRenamed("col_idx", "seq"), "column_name")
    return selection.select_top(columns, selection.known_gain(gain, columns), 20)


# weights and labels


@query
def row_weights(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, C)
    rows = clean.with_split(panel.withColumn("y", clean.future_target(C.steps(H))), C.steps(H), C)
    rows = rows.withColumn("weight", training.row_weight(F.col("label"), F.col("y"), 3.0))
    raised = training.count_raised(rows.where("split = 'train'"), ["sid"])
    return rows.groupBy("sid", "split").agg(F.sum("weight").alias("total_weight")).join(raised, "sid", "left")


@query
def class_weights(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, C)
    rows = clean.with_split(panel.withColumn("y", clean.future_target(C.steps(H))), C.steps(H), C)
    return training.class_weight(rows.where("split = 'train'"), ["sid"])


@query
def soft_labels(spark, sf_dir):
    panel = clean.head(Hourly(spark, sf_dir).panel, C)
    probs = profiles.add_congestion_profile(panel, H, C).where("tow_cong_prob_ahead IS NOT NULL AND speed IS NOT NULL").select("sid", "pos", F.col("tow_cong_prob_ahead").alias("prob"))
    rows = panel.withColumn("y", clean.future_target(C.steps(H)))
    return training.soft_labels(rows, probs, C.soft_share).select("sid", "pos", "y", "soft")


# evaluation


@query
def naive_metrics(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return jobs.naive(p.panel, p.targets, C, p.sensors)


@query
def naive_summary(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return metrics.summary(jobs.naive(p.panel, p.targets, C, p.sensors), "hourly", "naive")


@query
def training_time(spark, sf_dir):
    """A method's time as a result row; a second for each cell of the panel stands for what a clock would say."""
    return metrics.training_time(spark, "hourly", "naive", "naive_persistence", Hourly(spark, sf_dir).panel.count())


def _profile_scores(p: Hourly, split: str) -> DataFrame:
    """Scores whose probability is the profile's at the target's time; 0 for an unseen bin."""
    panel = clean.only_targets(clean.head(p.panel, C), p.targets, p.sensors)
    rows = profiles.add_congestion_profile(panel, H, C).withColumn("y_true", clean.future_target(C.steps(H)))
    rows = clean.with_split(rows, C.steps(H), C).where(F.col("split") == split)
    rows = rows.withColumns({"horizon_min": F.lit(H), "method": F.lit("profile"), "prob": F.coalesce("tow_cong_prob_ahead", F.lit(0.0)), "current_label": F.col("label")})
    return metrics.mark_changes(rows, C.score_window)


@query
def threshold_curve(spark, sf_dir):
    return metrics.threshold_curve(_profile_scores(Hourly(spark, sf_dir), "eval"), C)


@query
def best_thresholds(spark, sf_dir):
    scores = _profile_scores(Hourly(spark, sf_dir), "eval")
    return metrics.best_thresholds(scores, C, ("f1", "transition_f1", "trsp")).select("sid", "metric", "threshold", "score", "f1")


@query
def test_metrics_at_threshold(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    best = metrics.best_threshold(_profile_scores(p, "eval"), C)
    return metrics.evaluate_with_threshold(_profile_scores(p, "test"), best, C)


# models and what they leave behind


@query
def search_choice(spark, sf_dir):
    """Of three candidates' scores on eval rows, each sensor's best with its own best threshold; the first of ties."""
    scores = written(_profile_scores(Hourly(spark, sf_dir), "eval"), "scores")
    made = F.array(F.col("prob"), F.col("prob") * F.col("prob"), 1 - F.col("prob"))
    tried = scores.withColumn("transition_weight", F.lit(1.0)).select(*training.MODEL, F.posexplode(made).alias("cand", "prob"), "pos", "split", "y_true", "current_label", "changed")
    heads = tried.select(*training.CANDIDATE).distinct()
    return training.best_candidate(tried.unionByName(heads, allowMissingColumns=True).withColumns({c: F.lit(None).cast(t) for c, t in (("n_rounds", "int"), ("n_features", "int"), ("gains", "array<double>"), ("inference_us", "double"))}), C).select("sid", "cand", "threshold", "score", "f1")


@query
def artifacts_round_trip(spark, sf_dir):
    """A global job's training probabilities, saved for each weight and read for one."""
    p = Hourly(spark, sf_dir)
    scores = _profile_scores(p, "train").withColumn("transition_weight", F.explode(F.array(F.lit(1.0), F.lit(3.0))))
    probs = scores.select(*training.MODEL, "pos", (F.col("prob") * F.col("transition_weight")).alias("prob"))
    gain = _rounded_gain(p).select("sid", F.lit(H).alias("horizon_min"), F.lit(3.0).alias("transition_weight"), "column_name", F.lit(0).alias("seq"), "gain")
    params = p.targets.select("sid", F.lit(H).alias("horizon_min"), F.lit(3.0).alias("transition_weight"), F.lit(0).alias("seq"), training.as_map(C.fixed_params).alias("params"))
    path = new_folder(spark, "artifacts")
    io.save_artifacts(path, gain, params, probs)
    return io.load_artifacts(spark, path, 3.0)["train_probs"].select("sid", "horizon_min", "transition_weight", "pos", "prob")


@query
def boosted_fits(spark, sf_dir):
    """What must hold for a fit of each target: a probability for each row, within bounds, importances that sum to 1, the rounds asked for."""
    p = Hourly(spark, sf_dir)
    own = written(clean.only_targets(clean.head(p.panel, C), p.targets, p.sensors), "targets")
    frame = frames.local_frame(own, H, C, p.holidays)
    names = frames.feature_names(frame)
    frame = clean.with_split(frame, C.steps(H), C).withColumn("horizon_min", F.lit(H))
    rows = written(training.model_rows(frame, names, C), "rows", ("sid", "horizon_min"))
    tries = training.listed(training.models_of(rows, (3.0,)), [C.fixed_params], rounds=F.lit(2), splits=("train", "eval", "test"))
    fits = written(training.fit_models(rows, tries, C), "fits")
    inside = (F.col("prob") >= 0) & (F.col("prob") <= 1)
    scored = fits.where("pos IS NOT NULL").groupBy("sid").agg(F.count("*").alias("n_rows"), F.count_if(~inside).alias("n_outside"), F.count_distinct("pos").alias("n_pos"))
    whole = F.aggregate("gains", F.lit(0.0), lambda a, b: a + b)
    return training.fitted(fits).select("sid", "n_rounds", F.round(whole, 6).alias("gain"), (F.size("gains") - F.col("n_features")).alias("n_left_out")).join(scored, "sid")


# reports


def _gain_rows(p: Hourly) -> DataFrame:
    gain = _rounded_gain(p).where("gain >= 0.05")
    return gain.select(F.lit("global_W1").alias("variant"), F.lit(H).alias("horizon_min"), "sid", "column_name", "gain")


@query
def feature_groups(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    names = frames.wide_frame(clean.head(p.panel, C), H, C, p.upstream, p.targets, p.holidays).select("column_name").distinct()
    return report.with_group(names, p.targets)  # names of other sensors take the later rules


def _importance(spark, sf_dir) -> DataFrame:
    p = Hourly(spark, sf_dir)
    gain = _gain_rows(p)
    selected = gain.where("gain >= 0.15").drop("gain")
    return report.importance_report(report.group_gain(gain, p.sensors), report.group_selection(selected, p.sensors))


@query
def importance_report(spark, sf_dir):
    return _importance(spark, sf_dir)


@query
def horizon_suffixes(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    index = _column_index(p).withColumnRenamed("col_idx", "seq")
    gain = _gain_rows(p).join(index, "column_name").withColumn("transition_weight", F.lit(1.0))
    return report.horizon_suffixes(gain)


@query
def common_params(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    counts = p.panel.groupBy("sid", "idx").agg(F.sum("label").alias("hot"))
    params = counts.select(F.lit(1.0).alias("transition_weight"), F.lit(H).alias("horizon_min"), "sid", F.col("idx").alias("seq"), F.create_map(F.lit("max_depth"), (3 + F.col("hot") % 3).cast("double"), F.lit("eta"), F.lit(0.05)).alias("params"))
    return report.common_params(params)


# models: no SQL form


def _results(out: dict) -> DataFrame:
    """A job's results without the time that predictions took."""
    return out["results"].drop("inference_us")


@query
def local_model(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    return _results(jobs.local(p.panel, p.targets, C, p.holidays))


@query
def global_then_transfer_model(spark, sf_dir):
    p = Hourly(spark, sf_dir)
    path = new_folder(spark, "artifacts")
    out = jobs.global_model(p.panel, p.sensors, p.edges, p.targets, C, p.holidays, path)
    jobs.write_run(out, new_folder(spark, "run"))
    return _results(out).unionByName(_results(jobs.transfer(p.panel, p.targets, C, path, p.holidays)))


# the weekly panel, which grows with the tables


@query
def weekly_local_features(spark, sf_dir):
    p = Weekly(spark, sf_dir)
    panel = clean.head(p.panel, C)
    columns = frames.own_speed(H, C) | frames.own_congestion(H, C)
    rows = windows.add_state_times(panel.withColumns(columns), C)
    names = [*columns, "minutes_in_state", "minutes_since_onset", "previous_episode_minutes"]
    return rows.groupBy("sid").agg(*[F.count(n).alias(f"n_{n}") for n in names])


@query
def weekly_neighbours(spark, sf_dir):
    p = Weekly(spark, sf_dir)
    near = graph.all_neighbour_features(p.panel, p.upstream, H, C)
    names = [c for c in near.columns if c not in ("sid", "pos")]
    return near.groupBy("sid").agg(*[F.count(n).alias(f"n_{n}") for n in names], *[F.avg(n).alias(n) for n in names if n.startswith(("cong", "trans"))])


@query
def weekly_naive_summary(spark, sf_dir):
    p = Weekly(spark, sf_dir)
    return metrics.summary(jobs.naive(p.panel, p.sensors.select("sid"), C, p.sensors), "weekly", "naive")
