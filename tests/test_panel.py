"""Hand-worked panels for the rules that are easy to get wrong, and pandas as a second opinion."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.config import HOURLY, PanelConfig
from panelwright.operators import clean, graph, metrics, report, selection, training, windows
from panelwright.sources import io

C = PanelConfig()
START = dt.datetime(2024, 1, 1)


def panel_of(spark, labels, speeds=None, sid="100001"):
    n = len(labels)
    speeds = speeds if speeds is not None else [50.0] * n
    rows = [(sid, 1, i, START + dt.timedelta(minutes=5 * i), n, speeds[i], labels[i]) for i in range(n)]
    return spark.createDataFrame(rows, "sid string, idx int, pos long, ts timestamp_ntz, n long, speed double, label int")


def column(rows, name):
    return [r[name] for r in rows.orderBy("pos").collect()]


def test_split_uses_double_arithmetic(spark):
    panel = panel_of(spark, [0] * 90)
    rows = clean.with_split(panel, 100, C)  # the window is longer than the panel, so no tail is dropped
    assert rows.where("split = 'train'").count() == int(90 * 0.7) == 62


def test_future_target_and_tail(spark):
    panel = panel_of(spark, [0, 0, 1, 0]).withColumn("y", clean.future_target(2))
    assert column(panel, "y") == [1, 1, 0, 0]
    assert clean.with_split(panel, 2, C).count() == 2
    assert clean.with_split(panel, 2, replace(C, tail_drop=False)).count() == 4


def test_state_times(spark):
    rows = windows.add_state_times(panel_of(spark, [1, 1, 0, 0, 1, 0]), C)
    assert column(rows, "minutes_in_state") == [0, 5, 0, 5, 0, 0]
    assert column(rows, "previous_episode_minutes") == [None, None, 10, 10, 10, 5]
    rows = windows.add_state_times(panel_of(spark, [1, 1, 0, 1]), C)
    assert column(rows, "minutes_since_onset") == [None, None, None, 0]


def test_rolling_needs_a_whole_window(spark):
    panel = panel_of(spark, [0] * 5, [1.0, None, 3.0, 4.0, 5.0])
    rows = panel.withColumns({"m": windows.rolling("speed", 3, "mean"), "s": windows.rolling("speed", 1, "std")})
    assert column(rows, "m") == [None, None, None, None, 4.0]
    assert column(rows, "s") == [None] * 5
    with pytest.raises(ValueError):
        windows.rolling("speed", 3, "median")


def test_windows_match_pandas(spark):
    rng = np.random.default_rng(5)
    speeds = [None if rng.random() < 0.1 else float(x) for x in rng.normal(50, 10, 60)]
    series = pd.Series(speeds, dtype=float)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # the recurrence goes on from batch to batch
    rows = windows.add_ema(panel_of(spark, [0] * 60, speeds), C).withColumns(windows.changes(C) | windows.rollings(C))
    got = rows.orderBy("pos").toPandas()
    expected = {
        "ema_15min": series.ewm(halflife=3, min_periods=3).mean(),
        "delta_5": series.diff(5),
        "acceleration_1": series.diff().diff(),
        "roll_std_30min": series.rolling(6, min_periods=6).std(),
        "roll_min_30min": series.rolling(6, min_periods=6).min(),
    }
    for name, want in expected.items():
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, equal_nan=True)


def test_missing_times(spark):
    rows = [(START, "a", 0.0), (START, "b", 1.0), (START + dt.timedelta(hours=1), "a", 0.0), (START + dt.timedelta(hours=1), "b", None), (START + dt.timedelta(hours=2), "a", 5.0), (START + dt.timedelta(hours=2), "b", 6.0)]
    readings = spark.createDataFrame(rows, "ts timestamp_ntz, sid string, speed double")
    sensors = spark.createDataFrame([("a", 0), ("b", 1)], "sid string, idx int")
    panel = clean.dense_panel(readings, sensors, HOURLY)
    assert [r.pos for r in panel.where("sid = 'a'").orderBy("pos").collect()] == [0, 1]
    assert column(panel.where("sid = 'a'"), "speed") == [None, 5.0]
    strict = clean.dense_panel(readings, sensors, replace(HOURLY, zero_missing=False))
    assert strict.select("ts").distinct().count() == 2
    assert clean.zero_report(readings, sensors).first() == (2, 6, pytest.approx(100 / 3))
    empty = clean.build_panel(readings.limit(0), sensors, HOURLY)
    assert empty.count() == 0


def test_missing_speed_is_not_congested(spark):
    panel = panel_of(spark, [0] * 3, [None, 10.0, 100.0]).drop("label")
    limits = spark.createDataFrame([("100001", 50.0)], "sid string, thr double")
    assert column(clean.label(panel, limits), "label") == [0, 1, 0]


def test_inner_validation_and_targets(spark):
    panel = panel_of(spark, [0, 1])
    assert column(clean.inner_validation(panel, 2, C), "is_val") == [False, True]
    with pytest.raises(ValueError):
        clean.inner_validation(panel, 1, C)
    with pytest.raises(ValueError):
        clean.only_targets(panel, spark.createDataFrame([("7",)], "sid string"))


def graph_fixture(spark):
    edges = spark.createDataFrame([("a", "a", 1.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("c", "c", 1.0)], "src string, dst string, weight double")
    rows = []
    for sid, idx, speed, label in (("a", 0, None, 1), ("b", 1, 20.0, 0), ("c", 2, 30.0, 1), ("d", 3, 40.0, 0)):
        rows.append((sid, idx, 0, START, 1, speed, label))
    panel = spark.createDataFrame(rows, "sid string, idx int, pos long, ts timestamp_ntz, n long, speed double, label int")
    return edges, panel


def test_hops_and_neighbours(spark):
    edges, panel = graph_fixture(spark)
    hops = graph.hop_sets(edges, 3, upstream=True)
    assert {tuple(r) for r in hops.collect()} == {("c", "a", 1), ("c", "b", 1), ("d", "c", 1), ("d", "a", 2), ("d", "b", 2)}
    near = {r.sid: r for r in graph.neighbour_means(panel, hops, {"spd": "speed", "cong": "label"}).collect()}
    assert near["c"].spd_h1 is None and near["c"].cong_h1 == 0.5  # one neighbour's speed is missing
    assert near["d"].spd_h1 == 30.0 and near["d"].cong_h2 == 0.5 and near["d"].spd_h3 is None


def test_origins_and_reports(spark):
    edges, panel = graph_fixture(spark)
    scores = {r.sid: r.score for r in graph.origin_scores(panel, edges).collect()}
    assert scores == {"a": 0, "b": 0, "c": 1, "d": 0}  # a's downstream c is congested; c has a above and a free d below
    assert [r.sid for r in graph.top_origins(graph.origin_scores(panel, edges)).collect()] == ["c"]
    sensors = panel.select("sid", "idx")
    assert graph.graph_report(edges, sensors).first() == (False, 5, 2)
    graph.check_alignment(panel, sensors)
    with pytest.raises(ValueError):
        graph.check_alignment(panel, sensors.where("sid <> 'b'"))


def scores_of(spark, y, p, current=None):
    current = current or [0] * len(y)
    rows = [("m", "s", 10, i, y[i], p[i], current[i]) for i in range(len(y))]
    return metrics.mark_changes(spark.createDataFrame(rows, "method string, sid string, horizon_min int, pos long, y_true int, y_pred int, current_label int"), 1)


def test_transition_mask_and_scores(spark):
    rows = scores_of(spark, [0, 0, 0, 1, 1, 1, 1], [0] * 7)
    assert column(rows, "changed") == [False, False, True, True, True, False, False]
    same = metrics.evaluate(scores_of(spark, [0] * 4, [0] * 4), C).first()
    assert (same.trsp, same.f1, same.transition_f1) == (1.0, 0.0, None)
    mixed = metrics.evaluate(scores_of(spark, [0, 0, 1, 1], [0, 1, 1, 1], [0, 0, 0, 1]), C).first()
    assert mixed.precision == pytest.approx(2 / 3) and mixed.recall == 1.0 and mixed.transition_f1 == 1.0


def test_threshold_search_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(60) < 0.4).astype(int)
    prob = np.round(np.clip(y * 0.3 + rng.random(60) * 0.7, 0, 1), 2)
    rows = [("m", "s", 10, i, int(y[i]), float(prob[i]), int(rng.random() < 0.5)) for i in range(60)]
    scores = metrics.mark_changes(spark.createDataFrame(rows, "method string, sid string, horizon_min int, pos long, y_true int, prob double, current_label int"), 1)
    curve = {r.k: r for r in metrics.threshold_curve(scores, C).collect()}
    for k in range(1, metrics.THRESHOLDS + 1, 9):
        found = metrics.evaluate(scores.withColumn("y_pred", (F.col("prob") >= 0.02 + 0.02 * (k - 1)).cast("int")), C).first()
        for name in ("f1", "transition_f1", "trsp", "precision", "recall"):
            assert curve[k][name] == pytest.approx(found[name])
    for metric in ("f1", "transition_f1", "trsp"):
        best = metrics.best_threshold(scores, C, metric).first()
        values = [curve[k][metric] for k in range(1, metrics.THRESHOLDS + 1)]
        assert best.score == max(values) and best.threshold == pytest.approx(0.02 * (values.index(max(values)) + 1))


def test_no_changed_rows_fall_back(spark):
    rows = [("m", "s", 10, i, i % 2, 0.31 + 0.4 * (i % 2), i % 2) for i in range(6)]
    scores = metrics.mark_changes(spark.createDataFrame(rows, "method string, sid string, horizon_min int, pos long, y_true int, prob double, current_label int"), 1)
    best = metrics.best_threshold(scores, C, "transition_f1").first()
    assert best.transition_f1 is None and best.score == 1.0 and best.threshold == pytest.approx(0.32)


def test_weights_and_soft_labels(spark):
    rows = spark.createDataFrame([("s", 0, 0), ("s", 1, 0)], "sid string, pos long, y int")
    assert training.class_weight(rows, ["sid"]).first().class_weight == 1.0
    probs = spark.createDataFrame([("s", 0, 1.0)], "sid string, pos long, prob double")
    assert column(training.soft_labels(rows, probs, 0.3), "soft") == [pytest.approx(0.3), pytest.approx(0.15)]
    assert training.warm_start_grid({"max_depth": 7, "eta": 0.1}) == {"max_depth": [7, 7], "eta": [0.1]}


def test_selection_rules(spark):
    columns = spark.createDataFrame([("7", "lag_7", 0), ("7", "is_weekend", 1), ("7", "x_1", 2), ("7", "x_2", 3)], "sid string, column_name string, col_idx int")
    gain = spark.createDataFrame([("7", "x_2", 0, 0.5)], "sid string, column_name string, seq int, gain double")
    names = lambda rows: [r.column_name for r in rows.orderBy("rank").collect()]
    assert names(selection.select_own_and_cross(columns, gain.drop("seq"), 3)) == ["lag_7", "is_weekend", "x_2"]
    assert names(selection.select_own_and_cross(columns, gain.drop("seq"), 1)) == ["lag_7", "is_weekend"]
    assert names(selection.select_top(columns, gain, 2)) == ["x_2", "lag_7"]
    with pytest.raises(ValueError):
        selection.select_top(columns, gain, 0)


def test_feature_groups_and_suffixes(spark):
    names = ["100005", "spd_h2_7", "trans_off_h1_3", "lag_60min_100005", "delta_1_100005", "is_weekend", "roll_mean_15min_999", "999", "other_999"]
    rows = report.with_group(spark.createDataFrame([(n,) for n in names], "column_name string"), spark.createDataFrame([("100005",)], "sid string"))
    assert {r.column_name: r.feature_group for r in rows.collect()} == {
        "100005": "sensor_current_speed",
        "spd_h2_7": "spatial_spd_h2",
        "trans_off_h1_3": "spatial_trans_off_h1",
        "lag_60min_100005": "sensor_lag_60min",
        "delta_1_100005": "sensor_delta_1",
        "is_weekend": "is_weekend",
        "roll_mean_15min_999": "sensor_roll_mean_15min",
        "999": "sensor_current_speed",
        "other_999": "other_999",
    }
    suffix = spark.createDataFrame([("5", "5"), ("lag_5", "5"), ("a5b", "5"), ("x", "5")], "c string, s string").select(report.local_suffix(F.col("c"), F.col("s")))
    assert [r[0] for r in suffix.collect()] == ["__current_speed__", "lag", "a{sid}b", None]


def test_sources(spark, tmp_path):
    with open(tmp_path / "wide.csv", "w") as f:
        f.write(",a,b\n2024-01-01 00:00:00,1.5,\n2024-01-01 00:05:00,0,2\n")
    wide = io.read_wide(spark, f"file://{tmp_path}/wide.csv")
    assert io.sensor_columns(wide) == ["a", "b"]
    assert sorted((r.sid, r.speed) for r in io.to_long(wide).collect() if r.speed is not None) == [("a", 0.0), ("a", 1.5), ("b", 2.0)]
    with pytest.raises(FileNotFoundError):
        io.load_artifacts(spark, f"file://{tmp_path}/none")
    io.write_importance(None, spark, f"file://{tmp_path}/importance")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/importance").columns[0] == "variant"
    rows = spark.createDataFrame([("s", 1, 0.5)], "sid string, horizon_min int, prob double").withColumn("transition_weight", F.lit(3.0))
    io.save_artifacts(f"file://{tmp_path}/art", rows, rows, rows)
    assert io.load_artifacts(spark, f"file://{tmp_path}/art", 3.0)["gain"].count() == 1


def test_config():
    assert C.steps(12.5) == 2 and C.steps(1) == 1  # halves go to the even number
    with pytest.raises(ValueError):
        replace(C, selection_metric="auc")


def test_model_queries_take_all_targets_and_the_whole_config(spark, monkeypatch):
    from panelwright import queries
    from panelwright.plans import jobs

    given = []
    rows = spark.createDataFrame([(1.0,)], "inference_us double")

    def job(name):
        def run(*args):
            config = next(a for a in args if isinstance(a, PanelConfig))
            targets = args[args.index(config) - 1]
            given.append((name, config, sorted(r.sid for r in targets.collect())))
            return {"results": rows.withColumn("x", F.lit(1))}

        return run

    monkeypatch.setattr(jobs, "local", job("local"))
    monkeypatch.setattr(jobs, "global_model", job("global"))
    monkeypatch.setattr(jobs, "transfer", job("transfer"))
    monkeypatch.setattr(jobs, "write_run", lambda out, path: None)
    for name in ("local_model", "global_then_transfer_model"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert given == [(name, HOURLY, ["100003", "100005", "100007", "100009"]) for name in ("local", "global", "transfer")]


def test_the_graph_goes_in_the_order_of_the_readings(spark):
    own = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "sid string, idx int")
    known = spark.createDataFrame([("a", 0), ("b", 2), ("d", 1)], "sid string, idx int")
    assert {tuple(r) for r in graph.alignment(own, known).collect()} == {("b", "order"), ("c", "readings"), ("d", "graph")}
    assert graph.alignment(own, own).count() == 0


def test_plans_read_what_was_written_a_few_times(spark):
    """What a query reads again is a written table, and horizons and metrics share a pass."""
    from panelwright import queries

    limits = {"weekly_naive_summary": 7, "naive_metrics": 7, "weekly_neighbours": 20, "best_thresholds": 7, "target_correlations": 7}
    for name, most in limits.items():
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= most, (name, plan.count("Relation ["))
