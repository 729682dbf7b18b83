"""Chunks of a long axis against whole sensors, pandas and Spark's own exact percentile."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.config import HOURLY
from panelwright.operators import chunks, clean, frames, graph, selection, windows

C = HOURLY
LONG = replace(C, chunk_rows=37)
H = 120


@pytest.fixture(scope="module")
def panel(spark):
    """Two sensors, one of them with one state for most of the time and long runs without a speed."""
    rng, rows = np.random.default_rng(3), []
    for idx, sid in enumerate(("a", "b")):
        speed = 60 + 10 * np.sin(np.arange(400) / 9) + rng.normal(0, 4, 400)
        label = (speed < 52).astype(int) if idx == 0 else (np.arange(400) // 150 % 2)
        speed[rng.random(400) < 0.1] = np.nan
        speed[100 + 50 * idx : 180 + 60 * idx] = np.nan
        rows += [(sid, idx, k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), 400, None if np.isnan(speed[k]) else float(speed[k]), int(label[k])) for k in range(400)]
    return spark.createDataFrame(rows, "sid string, idx int, pos long, ts timestamp_ntz, n long, speed double, label int").repartition(5).cache()


def same(a, b, digits=None):
    rounded = lambda r: tuple(round(v, digits) if digits and isinstance(v, float) else v for v in r)
    rows = lambda df: sorted(str(rounded(r)) for r in df.select(sorted(df.columns)).collect())
    assert rows(a) == rows(b)


@pytest.mark.parametrize("rows", [1, 37, 400, 1_000])
def test_bounded_windows(panel, rows):
    columns = windows.lags(H, C) | windows.long_lags(H, C) | windows.rollings(C) | windows.changes(C) | frames.own_congestion(H, C) | windows.naive_labels(H, C) | {"y": clean.future_target(C.steps(H))}
    if rows == 1:  # every row is repeated for each chunk that it reaches
        panel = panel.where("pos < 60")
    same(panel.withColumns(columns), frames.with_windows(panel, columns, H, replace(C, chunk_rows=rows)))


@pytest.mark.parametrize("rows", [1, 37, 1_000])
def test_states(panel, rows):
    same(windows.add_state_times(panel, C), windows.add_state_times(panel, replace(C, chunk_rows=rows)))


@pytest.mark.parametrize("rows", [1, 37, 100, 1_000])
def test_exponential_means(panel, rows):
    found = windows.add_ema(panel, replace(C, chunk_rows=rows))
    same(windows.add_ema(panel, C), found, 9)
    table = found.toPandas().sort_values(["sid", "pos"])
    for m in C.half_lives:
        k = C.steps(m)
        for _, own in table.groupby("sid"):
            plain = own["speed"].astype(float).ewm(halflife=k, min_periods=k, adjust=True).mean()
            assert np.allclose(plain, own[f"ema_{m}min"].astype(float), equal_nan=True)


def test_more_tasks_than_sensors(spark, panel):
    """Rows of one sensor are in many groups, so that its history is no task's alone."""
    groups = []
    chunks.in_chunks(panel, 37, 5, 2, lambda p: groups.append(p.select("sid").distinct().count()) or p).count()
    assert groups == [2 * -(-402 // 37)] or groups[0] > 10


def test_local_frame_and_panel(spark, panel):
    same(frames.local_frame(panel, H, C), frames.local_frame(panel, H, LONG), 9)
    readings, sensors = panel.select("ts", "sid", "speed"), panel.select("sid", "idx").distinct()
    same(clean.build_panel(readings, sensors, C), clean.build_panel(readings, sensors, LONG))


@pytest.mark.parametrize("share", [0.0, 0.25, 0.9, 1.0])
def test_quantiles(spark, share):
    """One sensor has most of the rows, and most of those one value."""
    rng = np.random.default_rng(5)
    rows = [("most", 50.0)] * 900 + [("most", float(rng.normal(50, 20))) for _ in range(500)] + [("few", float(v)) for v in (3, 1, 2, 2)] + [("one", 7.0), ("none", None), ("few", None)]
    table = spark.createDataFrame(rows, "sid string, speed double").repartition(6)
    found = {r.sid: r.value for r in chunks.quantiles(table, "speed", share).collect()}
    plain = {r.sid: r.v for r in table.groupBy("sid").agg(F.percentile("speed", share).alias("v")).collect() if r.v is not None}
    assert found == plain


def test_ranks(spark):
    rng = np.random.default_rng(6)
    values = rng.permutation(1_000).tolist()
    table = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    assert {(r.v, r.pos, r.n) for r in chunks.ranked(table, ["v"]).collect()} == {(v, v, 1_000) for v in values}
    assert chunks.ranked(table.limit(0), ["v"]).count() == 0


def test_correlations_of_large_means(spark):
    """A column of mean 1e8 and spread 1: centred moments keep nine digits."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(1e8, 1, 500), rng.integers(0, 2, 500)
    x += 0.7 * y
    gone = rng.random(500) < 0.2
    features = spark.createDataFrame([(k, "c", None if gone[k] else float(x[k])) for k in range(500)], "pos long, column_name string, value double").repartition(6)
    targets = spark.createDataFrame([("s", k, int(y[k])) for k in range(500)] + [("t", k, 1) for k in range(500)], "sid string, pos long, y int")
    found = {r.sid: r.score for r in selection.correlations(features, targets, 400).collect()}
    own = pd.Series(np.where(gone, np.nan, x))[:400] - 1e8
    plain = abs(np.corrcoef(own.fillna(own.mean()), y[:400])[0, 1])
    assert found["s"] == pytest.approx(plain, abs=1e-9) and found["t"] == 0.0


@pytest.mark.parametrize("block,cut", [(1 << 18, 1 << 20), (40, 30)])
def test_multiplied_means_are_the_joined_ones(spark, monkeypatch, block, cut):
    """Blocks of positions and slices of sensors of any size; missing rows, nulls, a sensor of many neighbours and one of none."""
    rng = np.random.default_rng(8)
    rows = [(f"s{i}", k, None if rng.random() < 0.05 else float(rng.normal()), int(rng.integers(0, 2))) for i in range(12) for k in range(30) if rng.random() < 0.95]
    panel = spark.createDataFrame(rows, "sid string, pos long, speed double, label int").repartition(4)
    hops = spark.createDataFrame([("s0", f"s{i}", 1 + i % 3) for i in range(1, 12)] + [("s1", "s0", 1), ("s2", "s1", 2), ("s3", "gone", 1)], "sid string, nb_sid string, hop int")
    measures, waves = {"spd": "speed", "cong": "label"}, {"wspd": "speed"}
    monkeypatch.setattr(graph, "BLOCK_VALUES", block)
    monkeypatch.setattr(graph, "SLICE_VALUES", cut)
    found = graph.neighbour_means(panel, hops, measures, waves)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 3)
    same(graph.neighbour_means(panel, hops, measures, waves), found, 9)
    assert found.where("sid = 's0' AND spd_h1 IS NOT NULL").count() > 5 and found.where("sid = 's3'").count() == 0
    assert graph.neighbour_means(panel, hops.limit(0), measures, waves).count() == 0
