"""The jobs: origin mining, naive baselines, and the local, global and transfer models.

A model is fitted for each transition weight, target sensor and horizon. All models of a job
go through each step together: a pool of threads submits their distributed fits, their
scores are one aggregation. The driver loops over horizons to build frames, over search
stages and over fits.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from panelwright.config import PanelConfig
from panelwright.operators import chunks, clean, frames, graph, metrics, report, selection, training
from panelwright.sources import io
from panelwright.sources.scratch import new_folder, written

FRAME = ("sid", "horizon_min")
RESULT = ("method", *training.MODEL, "f1", "transition_f1", "trsp", "precision", "recall", "inference_us", "threshold", "n_features", "n_boost_rounds")


def origins(readings: DataFrame, sensors: DataFrame, edges: DataFrame, config: PanelConfig, k: int = 10) -> DataFrame:
    """The sensors where congestion begins most often: (sid, idx, score)."""
    panel = clean.build_panel(readings, sensors, config)
    return graph.top_origins(graph.origin_scores(panel, edges, sensors), k)


def naive(panel: DataFrame, targets: DataFrame, config: PanelConfig, sensors: DataFrame | None = None) -> DataFrame:
    """Scores of the naive predictors: (method, sid, horizon_min, metrics)."""
    rows = clean.only_targets(clean.head(panel, config), targets, sensors)
    return metrics.evaluate(metrics.naive_scores(rows, config), config)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _by_horizon(spark: SparkSession, config: PanelConfig, one_horizon: Callable[[int], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(rows, names) of what one_horizon gives for each horizon, as written tables.

    The horizons' steps are independent, and their jobs share the cluster. Rows lie in
    folders by horizon and sensor, as a horizon's plan left them: rows this wide are not
    shuffled once more.
    """
    folder = new_folder(spark, "model-rows")

    def run(horizon: int) -> DataFrame:
        rows, names = one_horizon(horizon)
        rows.select(*[c for c in training.ROWS if c != "horizon_min"]).write.partitionBy("sid").parquet(f"{folder}/horizon_min={horizon}")
        return names

    with ThreadPoolExecutor(config.fit_threads) as pool:
        asked = [pool.submit(inheritable_thread_target(spark)(run), h) for h in config.horizons]
        names = [a.result() for a in asked]
    shape = ", ".join(f"{name} {kind}" for name, kind in training.ROWS.items())
    return spark.read.schema(shape).parquet(folder), written(_union(names), "names")


def _local_rows(own: DataFrame, config: PanelConfig, holidays: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows, names) of all targets and horizons on their own features: names(sid, horizon_min, seq, column_name)."""
    sids = own.select("sid").distinct()

    def one_horizon(horizon: int) -> tuple[DataFrame, DataFrame]:
        frame = frames.local_frame(own, horizon, config, holidays)
        columns = frames.feature_names(frame)
        frame = clean.with_split(frame, config.steps(horizon), config).withColumn("horizon_min", F.lit(horizon))
        names = sids.select("sid", F.lit(horizon).alias("horizon_min"), F.posexplode(F.array(*map(F.lit, columns))).alias("seq", "column_name"))
        return training.model_rows(frame, columns, config), names

    return _by_horizon(own.sparkSession, config, one_horizon)


def _picked(names: DataFrame, chosen: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, names): of each of models the chosen(keys, seq) places in order, and their names."""
    keys = [c for c in training.MODEL if c in chosen.columns]
    lists = models.join(chosen, keys).groupBy(*training.MODEL).agg(F.array_sort(F.collect_list(F.col("seq").cast("int"))).alias("columns"))
    places = models.join(chosen, keys).select(*training.MODEL, "seq").join(names.select(*FRAME, "seq", "column_name"), [*FRAME, "seq"])
    return written(lists, "columns"), written(places.select(*training.MODEL, "seq", "column_name"), "picked-names")


def _report(method: str, models: DataFrame, best: DataFrame, names: DataFrame, sensors: DataFrame, began: float, dataset: str = "panel") -> dict[str, DataFrame]:
    """What a job writes: results, summary, training_time, gain and importance, from final_models' results."""
    spark = models.sparkSession
    weight = F.format_string("%s", F.regexp_replace(F.col("transition_weight").cast("string"), r"\.0$", ""))
    results = models.select(F.lit(method).alias("method"), *training.MODEL, "f1", "transition_f1", "trsp", "precision", "recall", "inference_us", "threshold", "n_features", F.col("n_rounds").alias("n_boost_rounds")).select(*RESULT)
    by_name = [c for c in training.MODEL if c in names.columns]
    gain = models.select(*training.MODEL, F.posexplode("gains").alias("seq", "gain")).where("gain > 0").join(names, [*by_name, "seq"])
    gain = written(gain.select(*training.MODEL, "column_name", "seq", "gain"), "gain")
    variant = F.concat(F.lit(f"{method}_W"), weight).alias("variant")
    used = models.select(*training.MODEL).join(names, by_name).select(variant, "horizon_min", "sid", "column_name")
    grouped = report.group_gain(gain.select(variant, "horizon_min", "sid", "column_name", "gain"), sensors)
    return {
        "results": results,
        "gain": gain,
        "summary": metrics.summary(results.withColumn("method", F.concat(F.lit(f"XGB-{method.title()}-w"), weight)), dataset, method),
        "importance": report.importance_report(grouped, report.group_selection(used, sensors)),
        "params": best.select(*training.MODEL, "params", "n_rounds"),
        "training_time": metrics.training_time(spark, dataset, method, f"XGB-{method.title()}", time.time() - began),
    }


def write_run(out: dict[str, DataFrame], folder: str) -> None:
    """Write a job's tables under a folder of this run: CSV, and JSON lines for choices."""
    spark = out["results"].sparkSession
    for name in ("results", "summary", "training_time"):
        io.append_results(out[name], io.stamped(folder, name))
    if "choices" in out:
        io.write_choices(out["choices"], io.stamped(folder, "choices"))
    io.write_importance(out["importance"], spark, io.stamped(folder, "importance"))


def local(panel: DataFrame, targets: DataFrame, config: PanelConfig, holidays: DataFrame | None = None) -> dict[str, DataFrame]:
    """Models on each target's own features: results, gain, summary, importance, params, training_time."""
    began = time.time()
    own = written(clean.only_targets(clean.head(panel, config), targets), "targets")
    rows, names = _local_rows(own, config, holidays)
    best = training.staged_search(rows, training.models_of(rows, config.weights), config)
    models, _ = training.final_models(rows, best, config)
    return _report("local", models, best, names, own.select("sid").distinct(), began)


def _wide_rows(cut: DataFrame, own: DataFrame, upstream: DataFrame, targets: DataFrame, config: PanelConfig, holidays: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows, names) of all targets and horizons on the columns that the correlation filter leaves; names also has col_idx and n_full."""
    n_train = int((cut.agg(F.max("n")).first()[0] or 0) * config.train_share)

    spark, sids = cut.sparkSession, own.select("sid").distinct()

    def one_horizon(horizon: int) -> tuple[DataFrame, DataFrame]:
        k = config.steps(horizon)
        parts = frames.wide_parts(cut, horizon, config, upstream, targets, holidays)
        pack, widths = written(frames.packed(parts), "wide-parts"), [names for _, names, _ in parts]
        base = clean.with_split(own.withColumn("y", clean.future_target(k)), k, config).withColumn("horizon_min", F.lit(horizon))
        # marked before a row has its features: the windows sort narrow rows
        base = training.with_inner(base.select("sid", "horizon_min", "pos", "label", "y", "split"), config)
        named = frames.packed_columns(pack, widths)
        n_full = sum(r.n * len(widths[r.part]) for r in pack.groupBy("part").agg(F.count_distinct("of").alias("n")).collect())
        if n_full <= config.prefilter_top:
            # the filter leaves all columns to every target, whatever their correlations
            columns = sorted(named.collect(), key=lambda c: c.column_name.encode())
            every = spark.createDataFrame([(i, c.column_name, i, n_full) for i, c in enumerate(columns)], "seq int, column_name string, col_idx int, n_full bigint")
            return base.join(frames.side_by_side(pack, columns), "pos"), sids.crossJoin(F.broadcast(every)).select("sid", F.lit(horizon).alias("horizon_min"), "seq", "column_name", "col_idx", "n_full")
        named = written(named, "named")
        columns = chunks.ranked(named.select("column_name").distinct(), ["column_name"], "col_idx")
        columns = written(columns.select("column_name", F.col("col_idx").cast("int").alias("col_idx"), F.col("n").alias("n_full")), "columns")
        features = frames.melted(pack, named)
        ys = own.select("sid", "pos", clean.future_target(k).alias("y"))
        kept = selection.prefilter(selection.correlations(features, ys, n_train), columns.select("column_name", "col_idx"), config.prefilter_top)
        kept = kept.select("sid", "column_name").join(columns, "column_name")
        kept = kept.withColumn("seq", F.row_number().over(Window.partitionBy("sid").orderBy("col_idx")) - 1)
        kept = written(kept.withColumn("k", F.count("*").over(Window.partitionBy("sid"))), "prefiltered")
        side = frames.as_arrays(features.join(kept.select("sid", "column_name", "seq", "k"), "column_name"))
        return base.join(side, ["sid", "pos"]), kept.select("sid", F.lit(horizon).alias("horizon_min"), "seq", "column_name", "col_idx", "n_full")

    return _by_horizon(spark, config, one_horizon)


def global_model(panel: DataFrame, sensors: DataFrame, edges: DataFrame, targets: DataFrame, config: PanelConfig, holidays: DataFrame | None = None, artifacts: str | None = None) -> dict[str, DataFrame]:
    """Models on all sensors' features: what local gives, and sweep, choices, ranker_gain, train_probs and horizon_suffixes.

    Columns are filtered by correlation and ranked by the gain of a fit on those left; a
    sweep says how many foreign columns go with the own ones. The artifacts are written if a
    path is given: the ranker's gains, parameters, training probabilities, and the most
    telling suffixes and most common parameters of each horizon.
    """
    began = time.time()
    graph.check_alignment(panel.select("sid", "idx"), sensors)
    upstream = written(graph.hop_sets(edges, config.hops, upstream=True), "hops")
    cut = written(clean.head(panel, config), "panel")
    own = written(clean.only_targets(cut, targets, sensors), "targets")
    rows, names = _wide_rows(cut, own, upstream, targets, config, holidays)

    frames_ = written(training.models_of(rows, (1.0,)), "models")
    fixed = config.fixed_params | {"max_rounds": config.fixed_rounds}
    ranked = training.fit_models(rows, training.listed(frames_, [fixed]), config)
    ranker = written(training.gain_rows(training.fitted(ranked), names.select(*FRAME, "seq", "column_name")).drop("transition_weight"), "ranker-gain")

    order = written(selection.rank_own_and_cross(names, ranker, FRAME), "ranked-columns")
    picks = [F.array_sort(F.collect_list(F.when(F.col("rank") <= F.col("n_own") + b, F.col("seq")))).alias(f"b{b}") for b in (0, *config.cross_budgets)]
    lists = written(order.groupBy(*FRAME).agg(*picks, F.first("n_own").alias("n_own"), F.first("n_full").alias("n_full"), F.count("*").alias("n_prefiltered")), "budgets")
    tries = F.array(*[F.struct(F.lit(i).alias("cand"), F.lit(b).alias("budget"), F.col(f"b{b}").alias("columns")) for i, b in enumerate(config.cross_budgets)])
    tries = frames_.join(lists, list(FRAME)).select(*training.MODEL, F.explode(tries).alias("o")).select(*training.MODEL, "o.*")
    tries = written(tries.withColumns({"params": training.as_map(fixed), "rounds": F.lit(None).cast("int"), "splits": F.array(F.lit("eval"))}), "sweep")
    swept = training.fit_models(rows, tries, config)
    scores = metrics.best_threshold(training.predictions(swept, "eval"), config, config.selection_metric, training.CANDIDATE)
    sweep = tries.select(*training.CANDIDATE, "budget", F.size("columns").alias("n_features")).join(scores, list(training.CANDIDATE), "left")
    sweep = written(sweep.select(*FRAME, "cand", "budget", "n_features", "threshold", "f1", "precision", "recall", "transition_f1", "score"), "sweep-scores")
    best_budget = sweep.where("score IS NOT NULL").groupBy(*FRAME).agg(F.max_by("budget", F.struct("score", -F.col("cand"))).alias("budget"))
    # without a defined score, own columns alone
    budget = written(lists.select(*FRAME, "n_own", "n_full", "n_prefiltered").join(best_budget, list(FRAME), "left").withColumn("budget", F.coalesce("budget", F.lit(0))), "budget")
    chosen = order.join(budget.select(*FRAME, "budget"), list(FRAME)).where(F.col("rank") <= F.col("n_own") + F.col("budget")).select(*FRAME, "seq")
    every = training.models_of(rows, config.weights)
    columns, names = _picked(names, chosen, every)
    best = training.staged_search(rows, every, config, columns=columns)
    models, fits = training.final_models(rows, best, config, columns)
    out = _report("global", models, best, names, sensors, began)
    narrow = training.with_weights(rows.where("split = 'train'").select(*FRAME, "label", "y"), config.weights)
    raised = training.count_raised(narrow, list(training.MODEL)).withColumnRenamed("n_raised", "transition_train_count")
    lists = sweep.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("budget", "n_features", "threshold", "f1", "precision", "recall", "transition_f1", "score"))).alias("feature_sweep_scores"))
    search = best.select(*training.MODEL, F.col("params").alias("search_best_params"), F.col("n_rounds").alias("search_rounds"), *[F.col(c).alias(f"search_eval_{c}") for c in ("threshold", "f1", "precision", "recall", "transition_f1", "score")])
    choices = search.join(raised, list(training.MODEL), "left").join(budget, list(FRAME)).join(lists, list(FRAME))
    gain = ranker.join(F.broadcast(best.sparkSession.createDataFrame([(float(w),) for w in config.weights], "transition_weight double")))
    seq = F.row_number().over(Window.partitionBy("transition_weight", "horizon_min").orderBy("sid"))
    params = best.select(*training.MODEL, seq.alias("seq"), F.map_concat(F.map_filter("params", lambda k, v: k != "num_boost_round"), F.create_map(F.lit("num_boost_round"), F.col("n_rounds").cast("double"))).alias("params"))
    probs = fits.where("pos IS NOT NULL AND split = 'train'").select(*training.MODEL, "pos", "prob")
    out |= {"sweep": sweep, "choices": choices, "ranker_gain": gain.select(*training.MODEL, "column_name", "seq", "gain"), "params": params, "train_probs": probs}
    out |= {"horizon_suffixes": report.horizon_suffixes(out["ranker_gain"]), "common_params": report.common_params(params)}
    if artifacts is not None:
        io.save_artifacts(artifacts, out["ranker_gain"], params, probs, {"horizon_suffixes": out["horizon_suffixes"], "common_params": out["common_params"]})
    return out


def to_local_names(gain: DataFrame) -> DataFrame:
    """Gains of own columns under the local frame's names: without the sensor."""
    name = report.local_suffix(F.col("column_name"), F.col("sid"))
    local_name = F.when(name == "__current_speed__", "speed").when(name.isNull(), F.col("column_name")).otherwise(name)
    return gain.withColumn("column_name", local_name)


def transfer(panel: DataFrame, targets: DataFrame, config: PanelConfig, artifacts: str, holidays: DataFrame | None = None) -> dict[str, DataFrame]:
    """Own-feature models on the columns that the global ranker found best, taught by the global models' training probabilities; gives what local does."""
    began = time.time()
    own = written(clean.only_targets(clean.head(panel, config), targets), "targets")
    known = io.load_artifacts(panel.sparkSession, artifacts)
    rows, names = _local_rows(own, config, holidays)
    every = training.models_of(rows, config.weights)
    columns = every.join(names.select(*FRAME, "column_name", F.col("seq").alias("col_idx")), list(FRAME))
    gain = to_local_names(known["gain"]).select(*training.MODEL, "column_name", "seq", "gain")
    top = selection.select_top(columns, selection.known_gain(gain, columns, training.MODEL), config.transfer_features, training.MODEL)
    chosen = top.join(names, [*FRAME, "column_name"]).select(*training.MODEL, "seq")
    columns, names = _picked(names, chosen, every)
    teacher = known["train_probs"]
    best = training.staged_search(rows, every, config, columns, teacher)
    models, _ = training.final_models(rows, best, config, columns, teacher)
    return _report("transfer", models, best, names, own.select("sid").distinct(), began)
