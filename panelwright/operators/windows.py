"""Per-sensor window features. All share one partitioning by sensor, ordered by position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.config import DAY, WEEK, PanelConfig

from .chunks import chunk_of, state_events
from .clean import by_sid, rows_between, thresholds
from .sizes import bounded


def lags(horizon: int, config: PanelConfig) -> dict[str, Column]:
    return {f"lag_{m}min": F.lag("speed", config.steps(m)).over(by_sid()) for m in config.lag_minutes(horizon)}


def long_lags(horizon: int, config: PanelConfig) -> dict[str, Column]:
    """Half a day ago, and the target's time one and two days and a week ago."""
    spans = {"12h": DAY // 2, "24h": DAY - horizon, "48h": 2 * DAY - horizon, "7d": WEEK - horizon}
    return {f"lag_{name}": F.lag("speed", config.steps(m)).over(by_sid()) for name, m in spans.items()}


def rolling(column: str, rows: int, kind: str) -> Column:
    """A mean, std (sample) or min over the last rows, null unless all are there."""
    over = rows_between(-(rows - 1), 0)
    how = {"mean": F.avg, "std": F.stddev_samp, "min": F.min}
    if kind not in how:
        raise ValueError(f"unknown window function {kind!r}")
    value = how[kind](column).over(over)
    if kind == "std" and rows == 1:
        return F.lit(None).cast("double")
    return F.when(F.count(column).over(over) == rows, value)


def rollings(config: PanelConfig) -> dict[str, Column]:
    out = {}
    for m in config.roll_windows:
        out |= {f"roll_{kind}_{m}min": rolling("speed", config.steps(m), kind) for kind in ("mean", "std")}
    return out | {f"roll_min_{m}min": rolling("speed", config.steps(m), "min") for m in config.roll_min_windows}


def changes(config: PanelConfig) -> dict[str, Column]:
    """Differences over some rows, and the second difference."""
    back = lambda k: F.lag("speed", k).over(by_sid())
    out = {f"delta_{k}": F.col("speed") - back(k) for k in config.delta_rows}
    return out | {"acceleration_1": F.col("speed") - 2 * back(1) + back(2)}


def state_now() -> dict[str, Column]:
    return {"cong_state": F.col("label").cast("int")}


def congested_share(config: PanelConfig) -> dict[str, Column]:
    return {f"cong_mean_{m}min": rolling("label", config.steps(m), "mean") for m in config.roll_windows}


def transitions(minutes: list[int], config: PanelConfig) -> dict[str, Column]:
    """Onset and recovery over trailing windows, null for the first rows."""
    out = {}
    for m in minutes:
        change = F.col("label") - F.lag("label", config.steps(m)).over(by_sid())
        out |= {f"onset_{m}min": (change == 1).cast("double"), f"recovery_{m}min": (change == -1).cast("double")}
    return out


def naive_labels(horizon: int, config: PanelConfig) -> dict[str, Column]:
    """The label at the target's time a day and a week ago."""
    ahead = config.steps(horizon)
    return {f"label_{name}": F.lag("label", config.steps(m) - ahead).over(by_sid()) for name, m in (("yesterday", DAY), ("lastweek", WEEK))}


def add_state_times(panel: DataFrame, config: PanelConfig) -> DataFrame:
    """panel with minutes_in_state, minutes_since_onset and previous_episode_minutes."""
    rows = state_events(panel, config.chunk_rows) if config.chunk_rows else _state_events(panel)
    minutes = lambda c: (c * config.sampling).cast("int")
    rows = rows.withColumns(
        {
            "minutes_in_state": minutes(F.col("pos") - F.col("__start")),
            "minutes_since_onset": minutes(F.col("pos") - F.col("__onset")),
            "previous_episode_minutes": minutes(F.col("__length")),
        }
    )
    return rows.drop("__was", "__start", "__onset", "__length")


def _state_events(panel: DataFrame) -> DataFrame:
    """panel with the label before, where the state and the last congestion began, and how long the last one ended was."""
    was = F.lag("label").over(by_sid())
    so_far = rows_between(Window.unboundedPreceding, 0)
    last = lambda flag, value: F.last(F.when(flag, value), ignorenulls=True).over(so_far)
    rows = panel.withColumns({"__was": was})
    rows = rows.withColumns({"__start": last(F.col("__was").isNull() | (F.col("__was") != F.col("label")), F.col("pos")), "__onset": last((F.col("__was") == 0) & (F.col("label") == 1), F.col("pos"))})
    # at the row that ends an episode, the row before it knows where the episode began
    began = F.lag("__start").over(by_sid())
    rows = rows.withColumn("__length", F.when((F.col("__was") == 1) & (F.col("label") == 0), F.col("pos") - began))
    return rows.withColumn("__length", F.last("__length", ignorenulls=True).over(so_far))


def add_margin(panel: DataFrame, config: PanelConfig) -> DataFrame:
    """panel with the speed's difference from, and ratio to, the threshold of its train rows."""
    limits = thresholds(panel, config, train_only=True)
    rows = panel.join(limits, "sid", "left")
    return rows.withColumns({"margin": F.col("speed") - F.col("thr"), "margin_ratio": F.when(F.col("thr") > 0, F.col("speed") / F.col("thr"))}).drop("thr")


#: Rows that one step of a decayed sum takes together.
EMA_ROWS = 64


def decayed_sum(values: np.ndarray, decay: float, before: float) -> np.ndarray:
    """y[i] = decay * y[i - 1] + values[i], with before as y[-1]."""
    n = -(-len(values) // EMA_ROWS)
    blocks = np.zeros(n * EMA_ROWS)
    blocks[: len(values)] = values
    away = np.arange(EMA_ROWS)
    out = blocks.reshape(n, EMA_ROWS) @ np.where(away[:, None] <= away, decay ** np.maximum(away - away[:, None], 0.0), 0.0)
    carried = decay ** (away + 1.0)
    for block in out:
        block += carried * before
        before = block[-1]
    return out.ravel()[: len(values)]


def _ends(panel: DataFrame, spans: dict[str, int], rows: int) -> DataFrame:
    """(sid, __chunk, <name>_total, <name>_weight, __seen): the sums before each chunk, decayed to its first row.

    A chunk by itself is an aggregation of its rows by their distance from its end; the few
    chunks of a sensor are then combined in order, as a sum over those before that ages by
    the rows between.
    """
    own = panel.select("sid", "pos", "speed", chunk_of(rows).alias("__chunk"))
    last = F.least((F.col("__chunk") + 1) * rows, F.col("__most") + 1) - 1
    most = panel.groupBy("sid").agg(F.max("pos").alias("__most"))
    age = last - F.col("pos")
    sums = {}
    for name, k in spans.items():
        aged = F.pow(F.lit(0.5 ** (1 / k)), age)
        sums |= {f"{name}_total": F.sum(F.col("speed") * aged), f"{name}_weight": F.sum(F.when(F.col("speed").isNotNull(), aged))}
    sums = {n: F.coalesce(c, F.lit(0.0)).alias(n) for n, c in sums.items()}
    ends = own.join(bounded(most), "sid").groupBy("sid", "__chunk").agg(*sums.values(), F.count("speed").alias("__seen"))
    listed = ends.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("__chunk", "__seen", *sums))).alias("ends"))
    zero = F.struct(F.lit(0).cast("bigint").alias("__chunk"), F.lit(0).cast("bigint").alias("__seen"), *[F.lit(0.0).alias(n) for n in sums])

    def on(state: Column, end: Column) -> Column:
        decay = {n: F.lit(0.5 ** (rows / k)) for name, k in spans.items() for n in (f"{name}_total", f"{name}_weight")}
        return F.struct((end["__chunk"] + 1).alias("__chunk"), (state["__seen"] + end["__seen"]).alias("__seen"), *[(state[n] * decay[n] + end[n]).alias(n) for n in sums])

    # the state after each chunk but the last is the state before the next
    states = F.aggregate("ends", F.array(zero), lambda done, end: F.concat(done, F.array(on(F.element_at(done, -1), end))))
    return listed.select("sid", F.explode(states).alias("s")).select("sid", "s.*")


def add_ema(panel: DataFrame, config: PanelConfig) -> DataFrame:
    """panel with ema_<m>min: an adjusted exponential mean whose weight halves every k rows.

    A missing row still ages the weights and shows the value before it; null until k rows
    had a speed. The recurrence is carried from one Arrow batch of the sorted rows to the
    next, so a sensor's history is never held as a whole. In chunks, each one starts from
    the sums of those before it.
    """
    spans = {f"ema_{m}min": config.steps(m) for m in config.half_lives}
    schema = T.StructType([*panel.schema.fields, *[T.StructField(n, T.DoubleType()) for n in spans]])
    starts = [c for n in spans for c in (f"{n}_total", f"{n}_weight")] + ["__seen", "__chunk"] if config.chunk_rows else []

    def carry(batches):
        sid, state = None, {}
        for batch in batches:
            sids, speed = batch.column("sid"), batch.column("speed").to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(speed)
            codes = sids.dictionary_encode().indices.to_numpy()
            new = np.diff(codes) != 0
            if starts:
                chunk = batch.column("__chunk").to_numpy()
                new |= np.diff(chunk) != 0
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(codes)]
            means = {name: np.empty(len(codes)) for name in spans}
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo:
                    continue
                key = (sids[lo].as_py(), chunk[lo] if starts else 0)
                if key != sid or not state:
                    sid = key
                    before = lambda c, lo=lo, batch=batch: batch.column(c)[lo].as_py()
                    state = {n: (before(f"{n}_total"), before(f"{n}_weight"), before("__seen")) if starts else (0.0, 0.0, 0) for n in spans}
                for name, k in spans.items():
                    total, weight, seen = state[name]
                    top = decayed_sum(np.where(known[lo:hi], speed[lo:hi], 0.0), 0.5 ** (1 / k), total)
                    below = decayed_sum(known[lo:hi].astype(float), 0.5 ** (1 / k), weight)
                    count = seen + np.cumsum(known[lo:hi])
                    means[name][lo:hi] = np.where(count >= k, top / np.where(below > 0, below, 1.0), np.nan)
                    state[name] = (top[-1], below[-1], int(count[-1]))
            made = [pa.array(m, mask=np.isnan(m)) for m in means.values()]
            kept = [c for c in batch.schema.names if c not in starts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *spans])

    if not starts:
        return panel.repartition("sid").sortWithinPartitions("sid", "pos").mapInArrow(carry, schema)
    rows = panel.withColumn("__chunk", chunk_of(config.chunk_rows)).join(bounded(_ends(panel, spans, config.chunk_rows)), ["sid", "__chunk"])
    rows = rows.select(*panel.columns, *starts)
    return rows.repartition("sid", "__chunk").sortWithinPartitions("sid", "pos").mapInArrow(carry, schema)
