"""Row weights, soft labels, and the fits, search and predictions of very many models, each a distributed pyspark.ml fit.

A model is one (sid, horizon_min, transition_weight). The driver goes through the list of
fits with a small pool, so that the jobs of several fits share the cluster; a fit reads the
rows of its sensor and horizon alone. What the models' predictions are worth is found by the
metrics' aggregations over all models together, and so is the best candidate of each. The
driver holds a row a fit (parameters, columns, gains), and never rows of models or scores.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from panelwright.config import PanelConfig
from panelwright.sources.scratch import new_folder, shared_folder, written

from . import metrics
from .clean import share

NO_PROBABILITY = 0.5
#: Values of a fit's features that a partition is meant to hold.
PART_VALUES = 4_000_000
#: What tells models apart, and candidates of a model.
MODEL = ("sid", "horizon_min", "transition_weight")
CANDIDATE = (*MODEL, "cand")
#: Columns of the rows that models are fitted on.
ROWS = {"sid": "string", "horizon_min": "int", "pos": "long", "label": "int", "y": "int", "split": "string", "inner": "boolean", "changed": "boolean", "features": "array<double>"}


def row_weight(current: Column, target: Column, weight: float) -> Column:
    """The weight where the label is about to change, else 1."""
    return F.when(current != target, float(weight)).otherwise(1.0)


def class_weight(rows: DataFrame, by: list[str]) -> DataFrame:
    """Negatives over positives; 1 if a class is absent."""
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    return rows.groupBy(*by).agg(F.when((pos == 0) | (neg == 0), 1.0).otherwise(neg / pos).alias("class_weight"))


def count_raised(rows: DataFrame, by: list[str]) -> DataFrame:
    """How many rows weigh more than 1."""
    return rows.groupBy(*by).agg(F.count_if(F.col("weight") > 1).alias("n_raised"))


def soft_labels(rows: DataFrame, probs: DataFrame, alpha: float, keys: tuple[str, ...] = ("sid", "pos")) -> DataFrame:
    """rows with soft: the teacher's probability and the label, blended; a row it has none for counts as a half."""
    out = rows.join(probs.select(*keys, F.col("prob").alias("__p")), list(keys), "left")
    return out.withColumn("soft", alpha * F.coalesce("__p", F.lit(NO_PROBABILITY)) + (1 - alpha) * F.col("y")).drop("__p")


def model_rows(frame: DataFrame, names: list[str], config: PanelConfig) -> DataFrame:
    """frame(sid, horizon_min, pos, label, y, split, ...) as rows of models, without a weight yet.

    features holds the named columns in order, missing as NaN; inner says whether a training
    row is in the part that candidates are fitted on, the rest of training being their
    validation; changed is marked within each split.
    """
    values = [F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(float("nan"))) for n in names]
    rows = frame.select("sid", "horizon_min", "pos", "label", "y", "split", F.array(*values).alias("features"))
    return with_inner(rows, config)


def with_inner(rows: DataFrame, config: PanelConfig) -> DataFrame:
    """rows with inner and changed. A model needs two training rows; without them none is inner."""
    by = Window.partitionBy("sid", "horizon_min")
    n = F.count_if(F.col("split") == "train").over(by)
    cut = F.greatest(F.lit(1), F.least(n - 1, share(n, 1 - config.inner_share)))
    rows = rows.withColumn("inner", (F.col("split") == "train") & (n > 1) & (F.row_number().over(by.orderBy("pos")) <= cut))
    return metrics.mark_changes(rows.withColumn("y_true", F.col("y")), config.score_window, ("sid", "horizon_min", "split")).drop("y_true")


def with_weights(rows: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """rows once for each transition weight, with their weight."""
    each = rows.withColumn("transition_weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    moved = F.col("label") != F.col("y")
    return each.withColumn("weight", F.when(moved, F.col("transition_weight")).otherwise(1.0))


def models_of(rows: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """models(model keys): each sensor and horizon of rows with each transition weight."""
    each = F.explode(F.array(*[F.lit(float(w)) for w in weights]))
    return rows.select("sid", "horizon_min").distinct().select("sid", F.col("horizon_min").cast("int").alias("horizon_min"), each.alias("transition_weight"))


def first_minimum(losses: list[float], patience: int) -> int:
    """The round (from 1) with the least loss, none seen after as many worse rounds as patience allows."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def first_trees(model: GBTClassificationModel, k: int) -> GBTClassificationModel:
    """The model that the first k rounds made, without another fit."""
    java, context = model._java_obj, SparkSession.active().sparkContext
    trees, weights = java.trees(), java.treeWeights()
    kept = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, k)
    shares = context._gateway.new_array(context._jvm.double, k)
    for i in range(k):
        kept[i], shares[i] = trees[i], weights[i]
    return GBTClassificationModel(context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), kept, shares, java.numFeatures(), java.numClasses()))


def fitted_to_patience(params: dict[str, float], most: int, config: PanelConfig, train: DataFrame, rest: DataFrame) -> GBTClassificationModel:
    """The model of up to most rounds, cut to those that the loss on rest speaks for.

    Rounds after patience has run out would be cut off again, so a fit begins with a few and
    is made anew with twice as many while the loss may still fall. A fit's first rounds do
    not depend on how many follow: each draws by the seed and its own number.
    """
    rounds = min(most, 2 * config.patience)
    while True:
        model = learner(params, rounds, config.seed).fit(train)
        losses = model.evaluateEachIteration(rest)
        kept = first_minimum(losses, config.patience)
        if rounds == most or len(losses) - kept >= config.patience:
            return first_trees(model, kept)
        rounds = min(most, 2 * rounds)


def learner(params: dict[str, float], rounds: int, seed: int) -> GBTClassifier:
    """Boosted trees with the parameters that MLlib has: gamma is the least gain of a split, min_child_weight the least rows of a leaf, colsample_bytree is drawn for each split; the others have no counterpart."""
    columns = params.get("colsample_bytree", 1.0)
    return GBTClassifier(
        labelCol="target",
        weightCol="weight",
        maxIter=rounds,
        maxDepth=int(params.get("max_depth", 3)),
        stepSize=params.get("eta", 0.1),
        subsamplingRate=params.get("subsample", 1.0),
        featureSubsetStrategy="all" if columns >= 1 else str(columns),
        minInstancesPerNode=max(1, int(params.get("min_child_weight", 1))),
        minInfoGain=params.get("gamma", 0.0),
        seed=seed,
    )


def weighted_targets(train: DataFrame, class_ratio: float, soft: bool = False) -> DataFrame:
    """(target, weight, features) to fit on, of rows with y, weight and, for taught models, soft.

    Rows whose label is 1 weigh class_ratio times as much. A soft label s is two rows, 1 with
    the weight's share s and 0 with the rest: the same loss.
    """
    aim = "soft" if soft else "CAST(y AS DOUBLE)"
    rows = train.selectExpr("features", f"{aim} AS target", f"weight * CASE WHEN {aim} = 1 THEN {number(class_ratio)} ELSE 1D END AS weight")
    if soft:
        pair = "ARRAY(STRUCT(1D AS target, weight * target AS weight), STRUCT(0D AS target, weight * (1 - target) AS weight))"
        rows = rows.selectExpr("features", f"EXPLODE({pair}) AS p").selectExpr("features", "p.target", "p.weight").where("weight > 0")
    return rows


def number(value: float) -> str:
    """A double as SQL."""
    return f"DOUBLE('{float(value)!r}')"


def constants(values: list, kind: str) -> str:
    """An array of numbers as SQL, one literal whatever their number."""
    return f"CAST(SPLIT('{','.join(map(repr, values))}', ',') AS ARRAY<{kind}>)" if values else f"CAST(ARRAY() AS ARRAY<{kind}>)"


GONE, KNOWN = "isnan(x) OR x IS NULL", "CASE WHEN train AND NOT (isnan(x) OR x IS NULL) THEN x END"
COUNTS = {"gone": f"COUNT_IF({GONE})", "seen": f"COUNT({KNOWN})", "mean": f"AVG({KNOWN})", "train": "COUNT_IF(train)", "rows": "COUNT(*)"}


def column_counts(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of each place in features: values missing, known ones in training and their mean, rows in training and in all."""
    each = rows.selectExpr(*keys, "split = 'train' AS train", "POSEXPLODE(features) AS (i, x)")
    return each.groupBy(*keys, "i").agg(*[F.expr(e).alias(n) for n, e in COUNTS.items()])


def counted(rows: DataFrame) -> dict[tuple, tuple[list[Row], dict, dict]]:
    """By sensor and horizon: column_counts, and how many training rows have which label, inner ones and all.

    Two jobs for all fits on rows, and for whatever steps fit on them afterwards: the driver
    keeps them with the table, a row a column as in a fit's gains.
    """
    found = getattr(rows, "_counted", None)
    if found is None:
        found = {}
        keys, train = ("sid", "horizon_min"), "split = 'train'"
        for r in rows.where(train).groupBy(*keys, "inner", "y").count().collect():  # four rows a sensor and horizon
            _, of_inner, of_all = found.setdefault((r.sid, r.horizon_min), ([], {}, {}))
            of_all[r.y] = of_all.get(r.y, 0) + r["count"]
            if r.inner:
                of_inner[r.y] = r["count"]
        for r in column_counts(rows, keys).collect():
            if (r.sid, r.horizon_min) in found:
                found[r.sid, r.horizon_min][0].append(r)
        rows._counted = found
    return found


def assembled(rows: DataFrame, columns: Iterable[int] | None, counts: list[Row] | None = None) -> tuple[DataFrame, list[int], int] | None:
    """(rows with their features as a vector, the place in features of each of its entries, how many features there are); None without training rows.

    Missing values become the training rows' mean, and a column that has any gets a flag
    beside it; a column without a value in training is left out. That is what an Imputer and
    a VectorAssembler do, as a few expressions on arrays: with one for each of a wide frame's
    columns, the generated code would be too large to compile. They are SQL, as each call
    that builds a column from Python holds up the fits in other threads. counts are the rows'
    column_counts, if they are known.
    """
    if counts is None:
        counts = column_counts(rows).collect()  # a row a column
    by_place = {r.i: r for r in counts}
    if not counts or not counts[0].train:
        return None
    columns = [i for i in (sorted(by_place) if columns is None else columns) if by_place[i].seen]
    gaps, names = [i for i in columns if by_place[i].gone], columns or [0]
    means = constants([by_place[i].mean if columns else 0.0 for i in names], "DOUBLE")
    full = f"ZIP_WITH(TRANSFORM({constants(names, 'INT')}, i -> GET(features, i)), {means}, (x, m) -> CASE WHEN isnan(x) OR x IS NULL THEN m ELSE x END)"
    flags = f"TRANSFORM({constants(gaps, 'INT')}, i -> CAST(isnan(GET(features, i)) AS DOUBLE))"
    kept = [c for c in rows.columns if c != "features"]
    size = {"ml_attr": {"num_attrs": len(names) + len(gaps)}}  # a fit needs no job to find it
    out = rows.select(*kept, array_to_vector(F.expr(f"CONCAT({full}, {flags})")).alias("features", metadata=size))
    parts = max(1, -(-counts[0].rows * (len(names) + len(gaps)) // PART_VALUES))
    return out.coalesce(parts), columns + gaps, len(counts)


def class_ratio(counts: dict[int, int]) -> float:
    """class_weight of counted labels."""
    return counts[0] / counts[1] if counts.get(0) and counts.get(1) else 1.0


FITS = "sid string, horizon_min int, transition_weight double, cand int, pos long, split string, y_true int, current_label int, changed boolean, prob double, n_rounds int, n_features int, gains array<double>, inference_us double"


def fit_models(rows: DataFrame, candidates: DataFrame, config: PanelConfig, teacher: DataFrame | None = None) -> DataFrame:
    """Fit candidates and predict: a row a (candidate, predicted row), and one a candidate with what was fitted; a written table.

    rows(sid, horizon_min, pos, label, y, split, inner, changed, features).
    candidates(model keys, cand, params, columns, rounds, splits): columns are places in
    features, all if null. With rounds, the fit is on all training rows; without, on the
    inner ones (config.max_rounds rounds at most, or params' max_rounds), cut to the rounds
    that the rest's unweighted loss by hard labels speaks for. Training rows weigh the
    transition weight where the label is about to change. splits names the splits to
    predict. A teacher(model keys, pos, prob) blends its probabilities into the labels
    fitted on.

    A predicted row has pos, split, y_true, current_label, changed and prob; a candidate's
    own row has a null pos, and n_rounds, n_features and gains (importances that sum to 1, by
    place in features). A model with no two training rows gives nothing.
    """
    spark, folder, known = rows.sparkSession, new_folder(rows.sparkSession, "fits"), counted(rows)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))  # else a fit of many rounds is one plan of all of them
    if teacher is not None:
        # one join for all fits, not one in each: a row has the probabilities of its models by weight
        given = teacher.groupBy("sid", "horizon_min", "pos").agg(F.map_from_entries(F.collect_list(F.struct("transition_weight", "prob"))).alias("given"))
        rows = written(rows.join(given, ["sid", "horizon_min", "pos"], "left"), "taught", ("sid", "horizon_min"))
    groups: dict[tuple, list[Row]] = {}
    for one in candidates.collect():  # a row a fit
        groups.setdefault((one.sid, one.horizon_min, None if one.columns is None else tuple(one.columns)), []).append(one)

    def fit_group(of: tuple, tries: list[Row], nth: int) -> list[tuple]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "fits")
        sid, horizon, columns = of
        counts, of_inner, of_all = known.get((sid, horizon), ([], {}, {}))
        if not of_inner:
            return []
        kept = (*ROWS, *(() if teacher is None else ("given",)))
        found = assembled(rows.where((F.col("sid") == sid) & (F.col("horizon_min") == horizon)).select(*kept), columns, counts)
        if found is None:
            return []
        vectors, places, width = found
        vectors, heads, scores = vectors.persist(), [], []
        try:
            probability = vector_to_array("probability")[1]
            for one in tries:
                inner, weight = one.rounds is None, number(one.transition_weight)
                train = vectors.where("split = 'train'").withColumn("weight", F.expr(f"CASE WHEN label <> y THEN {weight} ELSE 1D END"))
                if teacher is not None:
                    train = train.withColumn("soft", F.expr(f"{number(config.soft_share)} * COALESCE(TRY_ELEMENT_AT(given, {weight}), {number(NO_PROBABILITY)}) + {number(1 - config.soft_share)} * y"))
                targets = weighted_targets(train.where("inner") if inner else train, class_ratio(of_inner if inner else of_all), teacher is not None)
                if inner:
                    rest = vectors.where("split = 'train' AND NOT inner").selectExpr("features", "CAST(y AS DOUBLE) AS target", "1D AS weight")
                    model = fitted_to_patience(one.params, int(one.params.get("max_rounds") or config.max_rounds), config, targets, rest)
                else:
                    model = learner(one.params, int(one.rounds), config.seed).fit(targets)
                gains, importance = [0.0] * width, model.featureImportances
                for at, gain in zip(importance.indices.tolist(), importance.values.tolist(), strict=True):
                    if at < len(places):
                        gains[places[at]] += gain
                key = (sid, horizon, one.transition_weight, one.cand)
                heads.append((*key, model.getNumTrees, len(columns) if columns is not None else width, gains))
                wanted = ", ".join(f"'{x}'" for x in one.splits)
                scored = model.transform(vectors.where(f"split IN ({wanted})")).withColumn("prob", probability)
                scores.append(scored.selectExpr("sid", "CAST(horizon_min AS INT) AS horizon_min", f"{weight} AS transition_weight", f"{one.cand} AS cand", "pos", "split", "y AS y_true", "label AS current_label", "changed", "prob"))
            if scores:
                functools.reduce(DataFrame.unionByName, scores).write.parquet(f"{folder}/predicted/fits={nth}")
        finally:
            vectors.unpersist()
        return heads

    with ThreadPoolExecutor(config.fit_threads) as pool:
        asked = [pool.submit(inheritable_thread_target(spark)(fit_group), of, tries, k) for k, (of, tries) in enumerate(groups.items())]
        heads = [h for a in asked for h in a.result()]
    head = spark.createDataFrame(heads, "sid string, horizon_min int, transition_weight double, cand int, n_rounds int, n_features int, gains array<double>")
    head = written(head, "fitted")
    if not heads:
        return spark.createDataFrame([], FITS)
    scored = spark.read.schema(", ".join(FITS.split(", ")[:10]) + ", fits int").parquet(f"{folder}/predicted").drop("fits")
    return scored.unionByName(head, allowMissingColumns=True).withColumn("inference_us", F.lit(None).cast("double"))


def predictions(fits: DataFrame, split: str) -> DataFrame:
    """The predicted rows of a split, as scores for the metrics."""
    return fits.where(F.col("pos").isNotNull() & (F.col("split") == split))


def fitted(fits: DataFrame) -> DataFrame:
    """(candidate, n_rounds, n_features, gains, inference_us)."""
    return fits.where("pos IS NULL").select(*CANDIDATE, "n_rounds", "n_features", "gains", "inference_us")


def listed(models: DataFrame, choices: list[dict], columns: Column | None = None, rounds: Column | None = None, splits: tuple[str, ...] = ("eval",)) -> DataFrame:
    """Candidates: each choice of parameters for each of models(model keys, ...)."""
    options = F.array(*[F.struct(F.lit(i).alias("cand"), as_map(c).alias("params")) for i, c in enumerate(choices)])
    none = F.lit(None)
    made = models.select(*MODEL, (none.cast("array<int>") if columns is None else columns).alias("columns"), (none.cast("int") if rounds is None else rounds).alias("rounds"), F.explode(options).alias("o"))
    return made.select(*MODEL, "o.cand", "o.params", "columns", "rounds", F.array(*map(F.lit, splits)).alias("splits"))


def as_map(params: dict) -> Column:
    return F.create_map(*[x for k, v in params.items() for x in (F.lit(k), F.lit(float(v)))])


def best_candidate(fits: DataFrame, config: PanelConfig, metric: str | None = None) -> DataFrame:
    """Of each model, the candidate with the best score on eval rows, the first of ties: (candidate, threshold, score, f1, ..., n_rounds, gains).

    The threshold is each candidate's own best one. An undefined score counts as -1.
    """
    scores = metrics.best_threshold(predictions(fits, "eval"), config, metric, CANDIDATE)
    rows = fitted(fits).join(scores, list(CANDIDATE), "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))
    first = Window.partitionBy(*MODEL).orderBy(F.desc("score"), "cand")
    return rows.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def stage_choices(params: dict, grid: dict, keys: tuple[str, ...]) -> list[dict]:
    """params with each combination of a stage's values."""
    return [params | dict(zip(keys, values, strict=True)) for values in itertools.product(*(grid[k] for k in keys))]


def active_stages(grid: dict, stages: tuple[tuple[str, ...], ...]) -> list[tuple[str, ...]]:
    """Stages that have a choice to make."""
    return [s for s in stages if any(len(grid.get(k, [])) > 1 for k in s)]


def staged_search(rows: DataFrame, models: DataFrame, config: PanelConfig, columns: DataFrame | None = None, teacher: DataFrame | None = None) -> DataFrame:
    """The best parameters of each of models(model keys): (model keys, params, n_rounds, score, threshold, f1, precision, recall, transition_f1).

    Stages go in order; each tries its values around the best so far on the eval rows, and
    only a better score wins. All models go through a stage together. columns(model keys,
    columns) says which features a model has, all without it.
    """
    start = {k: v[0] for k, v in config.grid.items()}
    kept = ["params", "n_rounds", "score", "threshold", "f1", "precision", "recall", "transition_f1"]
    best = None
    # a stage without a choice would fit the best candidate again and find the same score
    for keys in active_stages(config.grid, config.stages) or config.stages[:1]:
        changes = [as_map({k: c[k] for k in keys if k in c}) for c in stage_choices(start, config.grid, tuple(k for k in keys if k in config.grid))]
        base = models.select(*MODEL, as_map(start).alias("was")) if best is None else best.select(*MODEL, F.col("params").alias("was"))
        options = F.array(*[F.struct(F.lit(i).alias("cand"), c.alias("now")) for i, c in enumerate(changes)])
        tried = base.select(*MODEL, "was", F.explode(options).alias("o")).select(*MODEL, "o.cand", F.map_concat(F.map_filter("was", lambda k, v: ~F.map_contains_key("o.now", k)), "o.now").alias("params"))
        tried = written(tried, "candidates")
        fits = fit_models(rows, with_columns_of(tried, columns).select("*", F.lit(None).cast("int").alias("rounds"), F.array(F.lit("eval")).alias("splits")), config, teacher)
        found = best_candidate(fits, config, config.metric_for(1.0)).join(tried, list(CANDIDATE)).select(*MODEL, *kept)
        if best is not None:  # of equal scores the earlier stage's stays
            both = best.withColumn("__s", F.lit(0)).unionByName(found.withColumn("__s", F.lit(1)))
            first = Window.partitionBy(*MODEL).orderBy(F.desc("score"), "__s")
            found = both.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k", "__s")
        best = written(found, "searched")
    return best


def with_columns_of(tries: DataFrame, columns: DataFrame | None) -> DataFrame:
    """tries with the columns of their models, null for all."""
    if columns is None:
        return tries.withColumn("columns", F.lit(None).cast("array<int>"))
    return tries.join(columns.select(*MODEL, "columns"), list(MODEL))


def final_models(rows: DataFrame, best: DataFrame, config: PanelConfig, columns: DataFrame | None = None, teacher: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, fits) of models refitted on all training rows with the searched params and n_rounds.

    results has the model keys, the test metrics at the threshold that the eval rows speak
    for, threshold, inference_us, n_rounds and gains.
    """
    tries = best.select(*MODEL, F.lit(0).alias("cand"), "params", F.col("n_rounds").alias("rounds"), F.array(*map(F.lit, ("train", "eval", "test"))).alias("splits"))
    fits = fit_models(rows, with_columns_of(tries, columns), config, teacher)
    limits = metrics.best_threshold(predictions(fits, "eval"), config, config.metric_for(1.0), CANDIDATE)
    found = metrics.evaluate_with_threshold(predictions(fits, "test"), limits, config, CANDIDATE)
    out = fitted(fits).join(limits.select(*CANDIDATE, "threshold"), list(CANDIDATE), "left").join(found, list(CANDIDATE), "left")
    return written(out.drop("cand"), "results"), fits


def gain_rows(models: DataFrame, names: DataFrame) -> DataFrame:
    """gain(model keys, column_name, seq, gain) of the columns that a model uses: models(model keys, gains), names(sid, horizon_min, seq, column_name)."""
    each = models.select(*MODEL, F.posexplode("gains").alias("seq", "gain")).where("gain > 0")
    return each.join(names, ["sid", "horizon_min", "seq"]).select(*MODEL, "column_name", "seq", "gain")


def warm_start_grid(params: dict) -> dict:
    """A grid around known parameters: their depth and one that is two deeper (7 at most), the rest as they are."""
    grid = {k: [v] for k, v in params.items()}
    return grid | {"max_depth": [params["max_depth"], min(params["max_depth"] + 2, 7)]}
