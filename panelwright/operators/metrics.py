"""Naive predictors, scores that weigh changes of state, and threshold search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.config import DAY, WEEK, PanelConfig

from .clean import by_sid, future_target, with_split

#: Thresholds tried: 0.02 to 0.96 in steps of 0.02.
THRESHOLDS = 48
NO_THRESHOLD = 0.99


def naive_scores(panel: DataFrame, config: PanelConfig, horizons: tuple[int, ...] | None = None, split: str = "test") -> DataFrame:
    """scores(method, sid, horizon_min, pos, y_true, y_pred, current_label, changed) of three predictors.

    Persistence, the label a day and a week before the target's time; missing is 0. All
    horizons share one pass over the sensors' windows; where the target changes is marked
    before the methods fan out.
    """
    horizons = config.horizons if horizons is None else horizons
    columns = {}
    for h in horizons:
        k = config.steps(h)
        lag = lambda span, k=k: F.coalesce(F.lag("label", config.steps(span) - k).over(by_sid()), F.lit(0))
        columns[f"h{h}"] = F.struct(F.lit(h).alias("horizon_min"), F.lit(k).alias("k"), future_target(k).alias("y_true"), lag(DAY).alias("yesterday"), lag(WEEK).alias("lastweek"))
    rows = panel.withColumns(columns)
    rows = rows.select("sid", "pos", "n", "label", F.explode(F.array(*columns)).alias("h")).select("sid", "pos", "n", "label", "h.*")
    out = with_split(rows, F.col("k"), config).where(F.col("split") == split)
    out = mark_changes(out, config.score_window)
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("y_pred")) for m, c in (("naive_persistence", "label"), ("naive_yesterday", "yesterday"), ("naive_lastweek", "lastweek"))])
    out = out.withColumn("p", F.explode(methods))
    return out.select("p.method", "sid", "horizon_min", "pos", "y_true", "p.y_pred", F.col("label").alias("current_label"), "changed")


def mark_changes(rows: DataFrame, window: int, keys: tuple[str, ...] = ("sid", "horizon_min")) -> DataFrame:
    """rows with changed: within window rows of a change in y_true."""
    by = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("__flip", F.coalesce((F.col("y_true") != F.lag("y_true").over(by)).cast("int"), F.lit(0)))
    return rows.withColumn("changed", F.max("__flip").over(by.rowsBetween(-window, window)) == 1).drop("__flip")


def ratio(top: Column, below: Column) -> Column:
    return F.when(below == 0, 0.0).otherwise(top / below)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2.0 * tp + fp + fn)


def _counts(where: Column | None = None) -> dict[str, Column]:
    """tp, fp, fn, n, n_pos and n_right of the rows where a condition holds."""
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    also = (lambda c: c) if where is None else (lambda c: c & where)
    every = F.lit(True) if where is None else where
    return {"tp": F.count_if(also(y & p)), "fp": F.count_if(also(~y & p)), "fn": F.count_if(also(y & ~p)), "n": F.count_if(every), "n_pos": F.count_if(also(y)), "n_right": F.count_if(also(y == p))}


def region_score(c: dict[str, Column]) -> Column:
    """F1 of a region; its accuracy if it has one class; 1 if it is empty."""
    one_class = (c["n_pos"] == 0) | (c["n_pos"] == c["n"])
    return F.when(c["n"] == 0, 1.0).when(one_class, c["n_right"] / c["n"]).otherwise(f1_of(c["tp"], c["fp"], c["fn"]))


def harmonic(transition: Column, steady: Column, weight: float, n: Column) -> Column:
    if weight <= 0:
        score = steady
    elif weight >= 1:
        score = transition
    else:
        score = F.when((transition <= 0) | (steady <= 0), 0.0).otherwise(1.0 / (F.lit(float(weight)) / transition + F.lit(1.0 - weight) / steady))
    return F.when(n > 0, score)


def evaluate(scores: DataFrame, config: PanelConfig, keys: tuple[str, ...] = ("method", "sid", "horizon_min")) -> DataFrame:
    """Per key: f1, transition_f1 (rows whose current label isn't the target), trsp, precision, recall.

    scores has changed from mark_changes. All come from one pass of conditional counts.
    """
    moved = F.col("current_label") != F.col("y_true")
    groups = {"a": _counts(), "m": _counts(moved), "t": _counts(F.col("changed")), "s": _counts(~F.col("changed"))}
    sums = scores.groupBy(*keys).agg(*[c.alias(f"{g}_{k}") for g, cs in groups.items() for k, c in cs.items()])
    return sums.select(*keys, *[c.alias(n) for n, c in metrics_of(config).items()])


def metrics_of(config: PanelConfig) -> dict[str, Column]:
    """The metrics from columns of counts: a_ all rows, m_ moved, t_ transition, s_ steady."""
    of = lambda g: {k: F.col(f"{g}_{k}") for k in ("tp", "fp", "fn", "n", "n_pos", "n_right")}
    a, m, t, s = of("a"), of("m"), of("t"), of("s")
    return {
        "f1": f1_of(a["tp"], a["fp"], a["fn"]),
        "transition_f1": F.when(m["n"] > 0, f1_of(m["tp"], m["fp"], m["fn"])),
        "trsp": harmonic(region_score(t), region_score(s), config.score_weight, a["n"]),
        "precision": ratio(a["tp"], a["tp"] + a["fp"]),
        "recall": ratio(a["tp"], a["tp"] + a["fn"]),
    }


def threshold_curve(scores: DataFrame, config: PanelConfig, keys: tuple[str, ...] = ("method", "sid", "horizon_min")) -> DataFrame:
    """Per key and threshold: the metrics at that threshold. scores has prob, changed and current_label.

    Rows are first counted by the last threshold that their probability reaches, so what
    the 48 thresholds multiply is bins, not rows; a running sum from the top gives the
    counts at each threshold.
    """
    # the grid is k * 0.02 in doubles; the bin is the number of grid points not above the probability
    grid = F.array(*[F.lit(0.02 + 0.02 * k) for k in range(THRESHOLDS)])
    guess = F.least(F.greatest(F.floor(F.col("prob") / 0.02), F.lit(0)), F.lit(THRESHOLDS)).cast("int")
    up = F.when((guess < THRESHOLDS) & (F.col("prob") >= F.get(grid, guess)), guess + 1).otherwise(guess)
    last = F.when((up > 0) & (F.col("prob") < F.get(grid, up - 1)), up - 1).otherwise(up)
    y, moved = F.col("y_true") == 1, F.col("current_label") != F.col("y_true")
    regions = {"a": F.lit(True), "m": moved, "t": F.col("changed"), "s": ~F.col("changed")}
    bins = scores.withColumn("bin", last).groupBy(*keys, "bin").agg(*[c.alias(n) for g, w in regions.items() for n, c in ((f"{g}_p", F.count_if(w & y)), (f"{g}_q", F.count_if(w & ~y)))])
    spread = bins.groupBy(*keys).agg(F.collect_list(F.struct("bin", *[f"{g}_{x}" for g in regions for x in "pq"])).alias("bins"))  # 49 at most
    rows = spread.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(THRESHOLDS))))
    total = lambda c, test: F.aggregate(F.filter("bins", test), F.lit(0).cast("bigint"), lambda s, b: s + b[c])
    hit = lambda b: b["bin"] >= F.col("k")
    every = lambda b: F.lit(True)
    counts = {}
    for g in regions:
        counts |= {f"{g}_tp": total(f"{g}_p", hit), f"{g}_fp": total(f"{g}_q", hit), f"{g}_n_pos": total(f"{g}_p", every), f"{g}_n_neg": total(f"{g}_q", every)}
    rows = rows.withColumns(counts)
    rows = rows.withColumns({f"{g}_fn": F.col(f"{g}_n_pos") - F.col(f"{g}_tp") for g in regions} | {f"{g}_n": F.col(f"{g}_n_pos") + F.col(f"{g}_n_neg") for g in regions})
    rows = rows.withColumns({f"{g}_n_right": F.col(f"{g}_tp") + F.col(f"{g}_n_neg") - F.col(f"{g}_fp") for g in regions})
    value = F.lit(0.02) + F.lit(0.02) * (F.col("k") - 1)
    return rows.select(*keys, "k", value.alias("threshold"), *[c.alias(n) for n, c in metrics_of(config).items()])


def best_thresholds(scores: DataFrame, config: PanelConfig, metrics: tuple[str, ...], keys: tuple[str, ...] = ("method", "sid", "horizon_min")) -> DataFrame:
    """best_threshold by each of the metrics, with metric; all from one curve."""
    by = {"f1": F.col("f1"), "transition_f1": F.coalesce("transition_f1", "f1"), "trsp": F.col("trsp")}
    ranked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), by[m].alias("score")) for m in metrics]))
    rows = threshold_curve(scores, config, keys).withColumn("m", ranked).select("*", "m.*").drop("m")
    first = Window.partitionBy(*keys, "metric").orderBy(F.col("score").desc_nulls_last(), "k")
    rows = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return rows.withColumn("threshold", F.when(F.col("score").isNull(), NO_THRESHOLD).otherwise(F.col("threshold"))).drop("__r", "k")


def best_threshold(scores: DataFrame, config: PanelConfig, metric: str | None = None, keys: tuple[str, ...] = ("method", "sid", "horizon_min")) -> DataFrame:
    """Per key: the threshold with the best metric (the lowest of ties) and its metrics; NO_THRESHOLD if none is defined.

    transition_f1 gives way to f1 where no row changes.
    """
    return best_thresholds(scores, config, (metric or config.selection_metric,), keys).drop("metric")


def evaluate_with_threshold(test: DataFrame, best: DataFrame, config: PanelConfig, keys: tuple[str, ...] = ("method", "sid", "horizon_min")) -> DataFrame:
    """Metrics of test rows (prob, y_true, current_label, changed) at each key's threshold."""
    rows = test.join(best.select(*keys, "threshold"), list(keys))
    return evaluate(rows.withColumn("y_pred", (F.col("prob") >= F.col("threshold")).cast("int")), config, keys)


def summary(results: DataFrame, dataset: str, experiment: str) -> DataFrame:
    """Per (method, horizon): means over sensors; inference_us as sum and mean. Nulls are passed over."""
    if "inference_us" not in results.columns:
        results = results.withColumn("inference_us", F.lit(None).cast("double"))
    return results.groupBy(F.lit(dataset).alias("dataset"), F.lit(experiment).alias("experiment"), "method", "horizon_min").agg(
        F.avg("f1").alias("f1_mean"),
        F.avg("transition_f1").alias("transition_f1_mean"),
        F.avg("trsp").alias("trsp"),
        F.avg("precision").alias("prec_mean"),
        F.avg("recall").alias("rec_mean"),
        F.sum("inference_us").alias("inference_us_all_nodes"),
        F.avg("inference_us").alias("inference_us_per_node"),
    )


def training_time(spark, dataset: str, experiment: str, method: str, seconds: float) -> DataFrame:
    """One row: how many minutes a method took, to two digits."""
    values = {"dataset": dataset, "experiment": experiment, "method": method}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.round(F.lit(float(seconds)) / 60, 2).alias("tt_mins"))
