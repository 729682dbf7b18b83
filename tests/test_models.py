"""Fits, search, sweep, transfer and artifacts on a small planted panel."""

import datetime as dt
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.config import HOURLY, PanelConfig
from panelwright.operators import training
from panelwright.plans import jobs
from panelwright.sources import io

C = replace(HOURLY, horizons=(120, 240), weights=(1.0, 3.0), max_rounds=6, patience=3, fixed_rounds=5, cross_budgets=(1, 2), prefilter_top=60, transfer_features=6, grid={"max_depth": [2, 3], "eta": [0.3], "subsample": [0.8], "colsample_bytree": [0.8]}, stages=(("max_depth", "eta"), ("subsample", "colsample_bytree")))


KEYS = "sid string, horizon_min int, transition_weight double"
TRIES = f"{KEYS}, cand int, params map<string,double>, columns array<int>, rounds int, splits array<string>"
ROWS = "sid string, horizon_min int, pos long, y int, label int, split string, inner boolean, changed boolean, features array<double>"


def table_of(spark, values, ys, sid="s", train=140, inner=126, label=None):
    """One model's rows: a list of feature lists and their labels; eval rows follow training, then test rows."""
    rows = []
    for k, (x, y) in enumerate(zip(values, ys, strict=True)):
        split = "train" if k < train else "eval" if k < train + 30 else "test"
        rows.append((sid, 120, k, int(y), int(label[k]) if label is not None else 0, split, k < inner, k % 2 == 0, [float(v) for v in x]))
    return spark.createDataFrame(rows, ROWS)


def one_try(spark, *tries, sid="s", weight=1.0, rounds=None, splits=("eval",)):
    """Candidates from (params, columns)."""
    return spark.createDataFrame([(sid, 120, weight, k, params, columns, rounds, list(splits)) for k, (params, columns) in enumerate(tries)], TRIES)


def noisy(n=200, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 1] + rng.normal(0, 0.8, n) > 0).astype(int)
    return x, y


def test_first_minimum():
    assert training.first_minimum([0.5], 3) == 1
    assert training.first_minimum([0.5, 0.4, 0.41, 0.42, 0.3], 2) == 2
    assert training.first_minimum([0.5, 0.4, 0.41, 0.42, 0.3], 3) == 5
    assert training.first_minimum([0.4, 0.4, 0.4], 9) == 1


def test_rounds_are_cut_to_the_least_validation_loss(spark):
    """The minimum is inside, the kept trees are the first of the same fit, and the loss is the log-loss."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 4)), rng.random(200) < 0.5
    rows, places, _ = training.assembled(table_of(spark, x, y), None)
    weighted = rows.where("split = 'train'").withColumn("weight", F.lit(1.0))
    model = training.learner({"max_depth": 3.0, "eta": 0.3}, 12, 1).fit(training.weighted_targets(weighted.where("inner"), 1.0))
    rest = weighted.where("NOT inner").withColumn("target", F.col("y").cast("double"))
    losses = model.evaluateEachIteration(rest)
    k = training.first_minimum(losses, 4)
    assert places == [0, 1, 2, 3] and 1 <= k < 12 and losses[k - 1] == min(losses[: k + 4])
    cut = training.first_trees(model, k)
    assert cut.getNumTrees == k and cut.treeWeights == model.treeWeights[:k]
    scored = [(r.y, r.probability[1]) for r in cut.transform(rest).select("y", "probability").collect()]
    # the learner's log-loss is of the doubled margin, as its probability is
    assert 2 * -np.mean([np.log(p if y else 1 - p) for y, p in scored]) == pytest.approx(losses[k - 1], rel=1e-6)
    assert sum(cut.featureImportances) == pytest.approx(1.0)
    fits = training.fit_models(table_of(spark, x, y), one_try(spark, ({"max_depth": 3.0, "eta": 0.3, "max_rounds": 12.0}, None)), replace(C, patience=4, seed=1))
    assert training.fitted(fits).first().n_rounds == k


def test_fits_give_probabilities_and_importances(spark):
    x, y = noisy()
    x[::7, 1] = np.nan  # missing values get a flag
    x[:, 3] = np.nan  # nothing to learn from
    tries = one_try(spark, ({"max_depth": 2.0, "eta": 0.3}, None), ({"max_depth": 2.0, "eta": 0.3}, [0, 2]), splits=("train", "eval", "test"))
    config = replace(C, max_rounds=6)
    fits = training.fit_models(table_of(spark, x, y), tries, config)
    heads = {r.cand: r for r in training.fitted(fits).collect()}
    assert sum(heads[0].gains) == pytest.approx(1.0) and np.argmax(heads[0].gains) == 1 and heads[0].gains[3] == 0 and heads[0].n_features == 4
    assert heads[1].gains[1] == heads[1].gains[3] == 0 and heads[1].n_features == 2
    rows = fits.where("pos IS NOT NULL")
    assert rows.count() == 400 and rows.where("prob < 0 OR prob > 1 OR prob IS NULL OR isnan(prob)").count() == 0
    right = rows.where("cand = 0 AND split = 'test'").select(F.avg(((F.col("prob") >= 0.5).cast("int") == F.col("y_true")).cast("int"))).first()[0]
    assert right > 0.6  # of 30 noisy rows
    key = lambda f: sorted(map(str, f.select("cand", "pos", "prob", "n_rounds", "gains").collect()))
    assert key(fits) == key(training.fit_models(table_of(spark, x, y), tries, config))


def test_transition_and_class_weights_reach_the_fit(spark):
    x, y = noisy()
    label = np.roll(y, 1)
    rows = training.assembled(table_of(spark, x, y, label=label), None)[0].where("inner").withColumn("weight", training.row_weight(F.col("label"), F.col("y"), 3.0))
    ratio = (y[:126] == 0).sum() / (y[:126] == 1).sum()
    given = training.weighted_targets(rows, ratio).groupBy("target").agg(F.sum("weight").alias("w")).collect()
    plain = {t: sum((3.0 if label[k] != y[k] else 1.0) * (ratio if t else 1.0) for k in range(126) if y[k] == t) for t in (0, 1)}
    assert {r.target: pytest.approx(r.w) for r in given} == plain


def test_soft_labels_are_weighted_pairs(spark):
    """A row of soft label s is 1 with the share s of its weight and 0 with the rest; the class weight is for labels of 1."""
    x, y = noisy()
    rows = training.assembled(table_of(spark, x, y), None)[0].where("inner").withColumns({"weight": F.lit(2.0), "soft": 0.3 + 0.5 * F.col("y")})
    given = {r.target: r.w for r in training.weighted_targets(rows, 1.7, True).groupBy("target").agg(F.sum("weight").alias("w")).collect()}
    soft = 0.3 + 0.5 * y[:126]
    assert given == {1.0: pytest.approx(2 * soft.sum()), 0.0: pytest.approx(2 * (1 - soft).sum())}


def test_transfer_validates_on_hard_labels(spark):
    """The teacher is sure of the wrong class on the rows that say when to stop: soft labels there would prefer other rounds."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2))
    y = x[:, 0] > 0
    teacher = spark.createDataFrame([("s", 120, 1.0, k, float(y[k]) if k < 126 else float(not y[k])) for k in range(140)], f"{KEYS}, pos long, prob double")
    config = replace(C, max_rounds=8, patience=8, soft_share=1.0)
    fits = training.fit_models(table_of(spark, x, y), one_try(spark, ({"max_depth": 2.0, "eta": 0.3}, None)), config, teacher)
    rows = training.soft_labels(training.assembled(table_of(spark, x, y), None)[0].where("split = 'train'").withColumn("weight", F.lit(1.0)), teacher, 1.0, ("pos",))
    model = training.learner({"max_depth": 2.0, "eta": 0.3}, 8, config.seed).fit(training.weighted_targets(rows.where("inner"), (~y[:126]).sum() / y[:126].sum(), True))
    rest = rows.where("NOT inner").withColumn("weight", F.lit(1.0))
    hard, soft = (training.first_minimum(model.evaluateEachIteration(rest.withColumn("target", F.col(c).cast("double"))), 8) for c in ("y", "soft"))
    assert hard != soft and training.fitted(fits).first().n_rounds == hard


def test_fits_overlap_and_choose_as_one_by_one(spark, monkeypatch):
    """Two models are fitted at a time; what is chosen is what a serial run chooses."""
    both, sids = None, ("a", "b")
    for k, sid in enumerate(sids):
        x, y = noisy(seed=k)
        rows = table_of(spark, x, y, sid)
        both = rows if both is None else both.unionByName(rows)
    models = spark.createDataFrame([(s, 120, 1.0) for s in sids], KEYS)
    config = replace(C, max_rounds=3, patience=2)
    spans, was = [], training.learner

    class Timed:
        def __init__(self, learner):
            self.learner = learner

        def fit(self, rows):
            began = time.monotonic()
            out = self.learner.fit(rows)
            spans.append((began, time.monotonic()))
            return out

    monkeypatch.setattr(training, "learner", lambda *a: Timed(was(*a)))
    key = lambda rows: sorted(map(str, rows.collect()))
    together = key(training.staged_search(both, models, config))
    assert any(a[0] < b[0] < a[1] for a in spans for b in spans)
    spans.clear()
    assert together == key(training.staged_search(both, models, replace(config, fit_threads=1))) and len(together) == 2
    assert not any(a[0] < b[0] < a[1] for a in spans for b in spans)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def planted_panel(spark, n=260):
    """Two sensors; the second follows the first by two rows."""
    rng = np.random.default_rng(7)
    state = (np.sin(np.arange(n) / 6) + rng.normal(0, 0.3, n) < -0.5).astype(int)
    rows = []
    for idx, sid in enumerate(("100000", "100001")):
        own = np.roll(state, 2 * idx)
        rows += [(sid, idx, k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), n, float(60 - 30 * own[k] + rng.normal(0, 2)), int(own[k])) for k in range(n)]
    panel = spark.createDataFrame(rows, "sid string, idx int, pos long, ts timestamp_ntz, n long, speed double, label int")
    sensors = panel.select("sid", "idx").distinct()
    edges = spark.createDataFrame([("100000", "100001", 1.0)], "src string, dst string, weight double")
    return panel, sensors, edges, spark.createDataFrame([("100001",)], "sid string")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('models')}"
    panel, sensors, edges, targets = planted_panel(spark)
    out = jobs.global_model(panel, sensors, edges, targets, C, artifacts=f"{path}/art")
    jobs.write_run(out, f"{path}/run")
    return path, out


def test_global_job(spark, made):
    path, out = made
    results = out["results"].collect()
    assert {(r.horizon_min, r.transition_weight) for r in results} == {(h, w) for h in C.horizons for w in C.weights} and len(results) == 4
    for r in results:
        assert all(0 <= r[c] <= 1 for c in ("f1", "trsp", "precision", "recall")) and 1 <= r.n_boost_rounds <= 6 and r.inference_us is None
    assert max(r.f1 for r in results) > 0.5
    probs = out["train_probs"]
    assert probs.where("prob < 0 OR prob > 1").count() == 0 and probs.groupBy("horizon_min", "transition_weight").count().count() == 4
    sweep = {(r.horizon_min, r.budget): r for r in out["sweep"].collect()}
    assert len(sweep) == 4
    for r in out["choices"].collect():
        best = max((sweep[r.horizon_min, b].score, -b) for b in C.cross_budgets)
        assert (r.budget or 0) == -best[1] and len(r.feature_sweep_scores) == 2 and r.transition_train_count >= 0
    assert spark.read.option("header", True).csv(f"{path}/run/results").count() == 4
    assert spark.read.json(f"{path}/run/choices").count() == 4
    assert spark.read.option("header", True).csv(f"{path}/run/importance").count() > 0
    assert spark.read.option("header", True).csv(f"{path}/run/training_time").first().method == "XGB-Global"
    assert spark.read.option("header", True).csv(f"{path}/run/summary").count() == 4


def test_artifacts_are_the_rankers(spark, made):
    path, out = made
    saved = io.load_artifacts(spark, f"{path}/art")
    key = lambda rows: sorted((r.transition_weight, r.sid, r.horizon_min, r.column_name, round(r.gain, 9)) for r in rows.collect())
    assert key(saved["gain"]) == key(out["ranker_gain"]) != key(out["gain"])
    assert spark.read.parquet(f"{path}/art/common_params").count() == 4 and spark.read.parquet(f"{path}/art/horizon_suffixes").count() > 0
    assert all("num_boost_round" in r.params for r in saved["params"].collect())


def test_transfer_takes_the_rankers_columns(spark, made):
    path, out = made
    panel, _, _, targets = planted_panel(spark)
    taught = jobs.transfer(panel, targets, C, f"{path}/art")
    used = {(r.horizon_min, r.column_name) for r in taught["gain"].collect()}
    own = jobs.to_local_names(out["ranker_gain"].where("transition_weight = 1.0")).where("gain > 0")
    ranked = {}
    for r in own.orderBy(F.desc("gain"), "seq").collect():
        ranked.setdefault(r.horizon_min, []).append(r.column_name)
    local = {c for _, c in used}
    for h in C.horizons:
        known = [c for c in ranked[h] if c in local or not c.startswith(("spd", "cong_h", "wspd", "wcong", "trans"))]
        assert {c for k, c in used if k == h} & set(known[: C.transfer_features])
    assert {r.n_features for r in taught["results"].collect()} == {C.transfer_features}


def test_local_job_is_the_same_again(spark):
    panel, _, _, targets = planted_panel(spark)
    key = lambda out: sorted(tuple(r) for r in out["results"].drop("inference_us").collect())
    config = replace(C, horizons=(120,))
    assert key(jobs.local(panel, targets, config)) == key(jobs.local(panel, targets, config))


def test_the_search_scores_eval_rows(spark):
    """Two candidate columns: one tells the validation rows, the other the eval rows. The latter's candidate wins."""
    rng, values, ys = np.random.default_rng(9), [], []
    for k in range(200):
        y = int(rng.random() < 0.5)
        noise = lambda: float(rng.random() < 0.5)
        for_val = float(y) if k < 140 else noise()
        for_eval = (float(y) if rng.random() < 0.9 else noise()) if k < 126 else noise() if k < 140 else float(y)
        values.append([for_val, for_eval])
        ys.append(y)
    table = table_of(spark, values, ys)
    tries = one_try(spark, *[({"max_depth": 1.0, "eta": 0.3}, [c]) for c in (0, 1)])
    fits = training.fit_models(table, tries, C)
    best = training.best_candidate(fits, C).first()
    assert best.cand == 1 and best.score > 0.9 and best.gains[1] > 0 == best.gains[0]
    one = training.fit_models(table.where("pos < 1").withColumn("inner", F.lit(False)), tries, C)
    assert one.count() == 0 and one.columns == fits.columns


def test_a_model_without_training_rows_gives_nothing(spark):
    panel, sensors, edges, targets = planted_panel(spark)
    out = jobs.local(panel.limit(0), targets.limit(0), replace(C, horizons=(120,)))
    assert out["results"].count() == 0


def test_cells_become_arrays_in_blocks(spark):
    from panelwright.operators import frames

    width, last = 3, 2 * frames.ARRAY_ROWS + 5
    cells = [(sid, pos, seq, width, float(pos * 10 + seq)) for sid in ("a", "b") for pos in (0, frames.ARRAY_ROWS - 1, frames.ARRAY_ROWS, last) for seq in range(width) if (pos + seq) % 4]
    cells.append(("a", 7, 1, width, None))
    found = frames.as_arrays(spark.createDataFrame(cells, "sid string, pos long, seq int, k int, value double")).collect()
    want = {}
    for sid, pos, seq, _, value in cells:
        want.setdefault((sid, pos), [float("nan")] * width)[seq] = float("nan") if value is None else value
    assert len(found) == len(want)
    assert all(repr(want[r.sid, r.pos]) == repr(list(r.features)) for r in found)


def test_constants_of_a_fit_are_exact(spark):
    values = [0.1, -1e-300, 1 / 3, 1e300, float("inf")]
    found = spark.range(1).selectExpr(f"{training.constants(values, 'DOUBLE')} AS a", f"{training.constants([], 'INT')} AS b", f"{training.number(1e-7)} AS c").first()
    assert (list(found.a), list(found.b), found.c) == (values, [], 1e-7)
    assert (training.class_ratio({0: 3, 1: 2}), training.class_ratio({0: 3}), training.class_ratio({1: 3})) == (1.5, 1.0, 1.0)


def test_wide_rows_are_the_melted_frames(spark, monkeypatch):
    """Where the filter leaves all columns no correlation is asked for, and rows are what cells put into arrays give; where it does not, rows are as before."""
    from panelwright.operators import clean, frames, graph, selection

    panel, sensors, edges, targets = planted_panel(spark)
    panel = panel.where("NOT (sid = '100000' AND pos IN (3, 200))")  # a part without a row
    upstream, own = graph.hop_sets(edges, C.hops, upstream=True), clean.only_targets(panel, targets, sensors)
    config = replace(C, horizons=(120,))
    melted = frames.wide_frame(panel, 120, config, upstream, targets)
    names = sorted(r[0] for r in melted.select("column_name").distinct().collect())
    cells = {(r.pos, r.column_name): r.value for r in melted.collect()}

    def check(top):
        rows, listed = jobs._wide_rows(panel, own, upstream, targets, replace(config, prefilter_top=top), None)
        listed = {r.seq: r for r in listed.collect()}
        assert all(names[r.col_idx] == r.column_name and r.n_full == len(names) for r in listed.values())
        found = rows.collect()
        assert len(found) == len({r.pos for r in found}) == 258 and {r.sid for r in found} == {"100001"}
        for r in found:
            want = [cells.get((r.pos, listed[k].column_name)) for k in range(len(listed))]
            assert [None if np.isnan(v) else v for v in r.features] == want
        return len(listed)

    assert check(len(names) - 5) == len(names) - 5
    monkeypatch.setattr(selection, "correlations", None)
    assert check(len(names)) == len(names)


def test_steps_count_a_tables_columns_once(spark, monkeypatch):
    """Two models and two steps: their columns are counted by one aggregation, not by one for each fit."""
    x, y = noisy()
    rows = table_of(spark, x, y, "a").unionByName(table_of(spark, x, y, "b"))
    asked, was = [], training.column_counts
    monkeypatch.setattr(training, "column_counts", lambda *a: asked.append(a) or was(*a))
    for _ in range(2):
        tries = one_try(spark, ({"max_depth": 2.0}, None), sid="a").unionByName(one_try(spark, ({"max_depth": 2.0}, None), sid="b"))
        fits = training.fit_models(rows, tries, replace(C, max_rounds=2))
        assert training.fitted(fits).count() == 2
    assert len(asked) == 1


def test_the_hourly_search_is_whole():
    """Rounds, patience, grid and stages are those of the job, not a part of them."""
    whole = PanelConfig()
    assert all(getattr(HOURLY, k) == getattr(whole, k) for k in ("fixed_params", "fixed_rounds", "grid", "stages", "max_rounds", "patience", "weights", "cross_budgets", "prefilter_top"))
    assert len(training.stage_choices({}, HOURLY.grid, HOURLY.stages[0])) == 9 and HOURLY.max_rounds == 2000 and HOURLY.fixed_rounds == 600 and HOURLY.patience == 50


def test_a_fit_that_grows_is_the_whole_fit(spark, monkeypatch):
    """Fits of 4, 8, 16 rounds, as patience asks for them, end with the model of one fit of all rounds; no round is asked for after patience has run out."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 4)), rng.random(200) < 0.5
    params = {"max_depth": 2.0, "eta": 0.1, "subsample": 0.6, "colsample_bytree": 0.6, "max_rounds": 24.0}
    asked, was = [], training.learner
    monkeypatch.setattr(training, "learner", lambda *a: asked.append(a[1]) or was(*a))
    config = replace(C, patience=2)
    fits = training.fit_models(table_of(spark, x, y), one_try(spark, (params, None)), config)
    rows = training.assembled(table_of(spark, x, y), None)[0].where("split = 'train'").withColumn("weight", F.lit(1.0))
    inner = y[:126]
    model = was(params, 24, config.seed).fit(training.weighted_targets(rows.where("inner"), (~inner).sum() / inner.sum()))
    losses = model.evaluateEachIteration(rows.where("NOT inner").withColumn("target", F.col("y").cast("double")))
    kept = training.first_minimum(losses, 2)
    assert training.fitted(fits).first().n_rounds == kept
    assert list(training.fitted(fits).first().gains) == pytest.approx(training.first_trees(model, kept).featureImportances.toArray().tolist())
    assert asked == [n for n in (4, 8, 16, 24) if n == 4 or n // 2 < kept + 2 and (n < 24 or 16 < kept + 2)]
