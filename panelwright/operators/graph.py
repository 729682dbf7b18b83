"""Neighbourhoods on the sensor graph and features of neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.config import PanelConfig

from .clean import by_sid
from .sizes import BROADCAST_ROWS, bounded

#: Hops that neighbour features tell apart.
MOST_HOPS = 3
#: Values of a measure in a block of positions, and of the neighbours that are multiplied at a time.
BLOCK_VALUES, SLICE_VALUES = 1 << 15, 1 << 20


def hop_sets(edges: DataFrame, hops: int, upstream: bool = False) -> DataFrame:
    """hops(sid, nb_sid, hop): neighbours by their least number of steps, 1 to hops.

    Downstream follows edges of positive weight; upstream goes against them. The graph is
    small next to the panel.
    """
    step = edges.where("weight > 0").select("src", "dst").distinct()
    near, far = ("dst", "src") if upstream else ("src", "dst")
    step = step.select(F.col(near).alias("at"), F.col(far).alias("to"))
    seen = step.select(F.col("at").alias("sid"), F.col("at").alias("nb_sid"))
    seen = seen.union(step.select("to", "to")).distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        reached = front.join(step, front["nb_sid"] == step["at"]).select("sid", F.col("to").alias("nb_sid")).distinct()
        front = reached.join(seen.select("sid", "nb_sid"), ["sid", "nb_sid"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.union(front)
    return seen.where("hop > 0")


def neighbour_means(panel: DataFrame, hops: DataFrame, measures: dict[str, str], waves: dict[str, str] | None = None, wave_rows: int = 1) -> DataFrame:
    """Per (sid, pos): <prefix>_h<hop>, the neighbours' mean by hop, for each measure (prefix -> column of panel).

    Null where any neighbour of that hop has null. waves are measures whose neighbours are
    taken wave_rows rows earlier for each step. Hop sets within the bound of a broadcast are
    a sparse matrix that is multiplied with blocks of positions; larger ones are joined.
    """
    waves, steps = waves or {}, range(1, MOST_HOPS + 1)
    late = dict.fromkeys(waves.values())
    rows = panel.withColumns({f"{c}__{h}": F.lag(c, h * wave_rows).over(by_sid()) for c in late for h in steps}) if late else panel
    rows = rows.select("sid", "pos", *dict.fromkeys([*measures.values(), *(f"{c}__{h}" for c in late for h in steps)]))
    sources = {f"{p}_h{h}": (h, c) for p, c in measures.items() for h in steps} | {f"{p}_h{h}": (h, f"{c}__{h}") for p, c in waves.items() for h in steps}
    pairs = hops.select("sid", "nb_sid", "hop").where(F.col("hop") <= MOST_HOPS)
    found = pairs.limit(BROADCAST_ROWS + 1).toArrow()
    if len(found) > BROADCAST_ROWS:
        return _joined_means(rows, pairs, sources)
    return _multiplied_means(rows, found, sources)


def _joined_means(rows: DataFrame, hops: DataFrame, sources: dict[str, tuple[int, str]]) -> DataFrame:
    """Every neighbour's row at every position, aggregated; the key holds the position, so a sensor with many neighbours is no hot key."""
    near = hops.select(F.col("sid").alias("target"), F.col("nb_sid").alias("sid"), "hop")
    met = rows.join(near, "sid")

    def mean(name: str, hop: int, column: str):
        here = F.col("hop") == hop
        value = F.when(here, F.col(column).cast("double"))
        return F.when(F.count(value) == F.count_if(here), F.avg(value)).alias(name)

    return met.groupBy(F.col("target").alias("sid"), "pos").agg(*[mean(n, h, c) for n, (h, c) in sources.items()])


def _multiplied_means(rows: DataFrame, hops: pa.Table, sources: dict[str, tuple[int, str]]) -> DataFrame:
    """Hop sets as sparse matrices, times blocks of positions: sums, and how many neighbours have a row and a value.

    The shuffle has a row of rows once; what neighbours multiply stays in a task, for a
    slice of sensors at a time.
    """
    known, targets = pc.unique(hops["nb_sid"]), pc.unique(hops["sid"])
    of, to, hop = (np.asarray(x) for x in (pc.index_in(hops["sid"], targets), pc.index_in(hops["nb_sid"], known), hops["hop"]))
    matrices = {}
    for h in range(1, MOST_HOPS + 1):
        order = np.flatnonzero(hop == h)
        order = order[np.argsort(of[order], kind="stable")]
        own, starts = np.unique(of[order], return_index=True)
        matrices[h] = (own, np.append(starts, len(order)), to[order])
    graph = rows.sparkSession.sparkContext.broadcast((known, targets, matrices))
    span = max(1, BLOCK_VALUES // max(1, len(known)))
    columns = sorted({c for _, c in sources.values()})

    def multiply(block: pa.Table) -> pa.Table:
        known, targets, matrices = graph.value
        at = pc.index_in(block["sid"].combine_chunks(), known.cast(block["sid"].type))
        block = block.filter(at.is_valid())
        at, pos = np.asarray(at.drop_null()), block["pos"].to_numpy()
        first = int(pos.min()) if len(pos) else 0
        width = int(pos.max()) - first + 1 if len(pos) else 0
        there = np.zeros((len(known), width), dtype=bool)
        there[at, pos - first] = True
        values = {}
        for c in columns:
            values[c] = np.full((len(known), width), np.nan)
            values[c][at, pos - first] = block[c].cast(pa.float64()).to_numpy()
        met = np.zeros((len(targets), width), dtype=bool)
        out = {n: np.full((len(targets), width), np.nan) for n in sources}
        for h, (own, starts, to) in matrices.items():
            k = 0
            while k < len(own) and width:
                # as many sensors as their neighbours' rows fit in a slice
                last = max(k + 1, int(np.searchsorted(starts, starts[k] + max(1, SLICE_VALUES // width), "right")) - 1)
                nb, edges = to[starts[k] : starts[last]], starts[k:last] - starts[k]
                n = np.add.reduceat(there[nb].astype(np.int64), edges, axis=0)
                met[own[k:last]] |= n > 0
                for name, (of_hop, c) in sources.items():
                    if of_hop == h:
                        v = values[c][nb]
                        full = np.add.reduceat((~np.isnan(v)).astype(np.int64), edges, axis=0) == n
                        total = np.add.reduceat(np.nan_to_num(v), edges, axis=0)
                        out[name][own[k:last]] = np.where(full & (n > 0), total / np.maximum(n, 1), np.nan)
                k = last
        t, p = np.nonzero(met)
        made = {n: pa.array(v[t, p], mask=np.isnan(v[t, p])) for n, v in out.items()}
        return pa.table({"sid": targets.take(pa.array(t)).cast(pa.string()), "pos": pa.array(p + first, pa.int64())} | made)

    blocks = rows.select("sid", "pos", *[F.col(c).cast("double").alias(c) for c in columns], F.floor(F.col("pos") / span).alias("__block"))
    return blocks.groupBy("__block").applyInArrow(multiply, "sid string, pos long, " + ", ".join(f"{n} double" for n in sources))


def onsets(panel: DataFrame, steps: int) -> DataFrame:
    """panel with __on and __off: whether the label rose or fell over the trailing window; null for its first rows."""
    change = F.col("label") - F.lag("label", steps).over(by_sid())
    return panel.withColumns({"__on": (change == 1).cast("double"), "__off": (change == -1).cast("double")})


def all_neighbour_features(panel: DataFrame, upstream: DataFrame, horizon: int, config: PanelConfig) -> DataFrame:
    """Speed, congestion and transitions of upstream neighbours, and speed and congestion as a wave reaches them."""
    rows = onsets(panel, config.steps(horizon))
    waves = {"wspd": "speed", "wcong": "label"} if "wave" in config.families else None
    return neighbour_means(rows, upstream, {"spd": "speed", "cong": "label", "trans_on": "__on", "trans_off": "__off"}, waves, config.wave_rows)


def origin_scores(panel: DataFrame, edges: DataFrame, sensors: DataFrame | None = None) -> DataFrame:
    """scores(sid, idx, score): at how many times a sensor is congested, no downstream neighbour is, and some upstream one is.

    A congested sensor marks itself, those upstream of it and those downstream of it; one
    aggregation of the marks by time and sensor, combined on the map side, says all three.
    """
    everyone = panel.select("sid", "idx").distinct() if sensors is None else sensors.select("sid", "idx")
    links = edges.where("weight <> 0 AND src <> dst").select("src", "dst").distinct()
    marks = everyone.select("sid", F.col("sid").alias("to"), F.lit(1).alias("mark"))
    marks = marks.unionByName(links.select(F.col("dst").alias("sid"), F.col("src").alias("to"), F.lit(2).alias("mark")))
    marks = marks.unionByName(links.select(F.col("src").alias("sid"), F.col("dst").alias("to"), F.lit(4).alias("mark")))
    marks = bounded(marks.groupBy("sid", "to").agg(F.bit_or("mark").alias("mark")))
    seen = panel.where("label = 1").select("ts", "sid").join(marks, "sid").groupBy("ts", F.col("to").alias("sid")).agg(F.bit_or("mark").alias("mark"))
    found = seen.where("mark = 5").groupBy("sid").agg(F.count("*").alias("score"))  # congested, one upstream is, none downstream
    return everyone.join(found, "sid", "left").select("sid", "idx", F.coalesce("score", F.lit(0)).alias("score"))


def top_origins(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k highest scores above zero; ties in sensor order."""
    return scores.where("score > 0").orderBy(F.desc("score"), "idx").limit(k)


def alignment(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Where readings(sid, ...) and the graph's sensors(sid, idx) disagree: (sid, only_in), empty if they agree.

    A sensor that one of them alone has is "readings" or "graph"; where both have an idx, a
    sensor with another one in the graph is "order", as neighbour features go by it.
    """
    ordered = "idx" in readings.columns and "idx" in sensors.columns
    own = readings.groupBy("sid").agg((F.min("idx") if ordered else F.lit(0)).alias("__a"))
    known = sensors.groupBy("sid").agg((F.min("idx") if ordered else F.lit(0)).alias("__b"))
    both = own.join(known, "sid", "full")
    kind = F.when(F.col("__a").isNull(), "graph").when(F.col("__b").isNull(), "readings").when(F.col("__a") != F.col("__b"), "order")
    return both.select("sid", kind.alias("only_in")).where("only_in IS NOT NULL")


def check_alignment(readings: DataFrame, sensors: DataFrame) -> None:
    odd = [tuple(r) for r in alignment(readings, sensors).limit(5).collect()]
    if odd:
        raise ValueError(f"readings and graph have different sensors or another order: {odd}")


def graph_report(edges: DataFrame, sensors: DataFrame) -> DataFrame:
    """One row: is_symmetric (within a relative 1e-5 and absolute 1e-8), n_edges, n_without_upstream."""
    a = edges.select("src", "dst", "weight")
    b = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    w, v = F.coalesce("weight", F.lit(0.0)), F.coalesce("back", F.lit(0.0))
    odd = a.join(b, ["src", "dst"], "full").agg(F.count_if(F.abs(w - v) > 1e-8 + 1e-5 * F.abs(v)).alias("odd"), F.count("weight").alias("n_edges"))
    fed = edges.where("weight > 0 AND src <> dst").select(F.col("dst").alias("sid")).distinct()
    alone = sensors.join(fed, "sid", "left_anti").agg(F.count("*").alias("n_without_upstream"))
    return odd.join(F.broadcast(alone)).select((F.col("odd") == 0).alias("is_symmetric"), "n_edges", "n_without_upstream")
