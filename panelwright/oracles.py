"""DuckDB SQL for the queries, on the same tables."""

from __future__ import annotations

import math

from panelwright.config import HOURLY as C
from panelwright.config import WEEK

H = 120
K = C.steps(H)
TARGETS = "idx IN (3, 5, 7, 9)"


def r(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}"


def part(n: str, share: float) -> str:
    return f"floor({n}::DOUBLE * {share}::DOUBLE)"


def over(first: str = "UNBOUNDED PRECEDING", last: str = "CURRENT ROW", by: str = "sid") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY pos ROWS BETWEEN {first} AND {last})"


def lag(column: str, rows: int) -> str:
    return f"lag({column}, {rows}) OVER (PARTITION BY sid ORDER BY pos)"


HOURLY_READINGS = """
raw AS (SELECT date_trunc('hour', ts) AS ts, user_id % 10 AS idx, sum(round(value * 100)::BIGINT)::DOUBLE AS cents, count(*)::DOUBLE AS k FROM events GROUP BY ALL),
readings AS (SELECT ts, (100000 + idx)::VARCHAR AS sid, idx, greatest(0.0::DOUBLE, 70.0::DOUBLE - cents / (k * 200.0::DOUBLE)) AS speed FROM raw)"""
WEEKLY_READINGS = """
raw AS (SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS ts, l_suppkey AS idx, sum(round(l_quantity)::BIGINT)::DOUBLE AS units, count(*)::DOUBLE AS k FROM lineitem GROUP BY ALL),
readings AS (SELECT ts, (100000 + idx)::VARCHAR AS sid, idx, greatest(0.0::DOUBLE, 70.0::DOUBLE - 1.5::DOUBLE * units / k) AS speed FROM raw)"""


def base(readings: str) -> str:
    return f"""WITH RECURSIVE {readings},
sensors AS (SELECT DISTINCT sid, idx::BIGINT AS idx FROM readings),
clean AS (SELECT ts, sid, nullif(speed, 0) AS speed FROM readings),
axis AS (SELECT ts, (row_number() OVER (ORDER BY ts) - 1)::BIGINT AS pos, count(*) OVER () AS n FROM (SELECT ts FROM clean GROUP BY ts HAVING count(speed) > 0)),
dense AS (SELECT s.sid, s.idx, a.pos, a.ts, a.n, c.speed FROM axis a CROSS JOIN sensors s LEFT JOIN clean c ON c.ts = a.ts AND c.sid = s.sid),
thr AS (SELECT sid, quantile_cont(speed, 0.9) * 0.65::DOUBLE AS thr FROM dense WHERE pos < {part('n', .7)} GROUP BY sid),
everything AS (SELECT dense.*, coalesce((speed < thr)::INT, 0) AS label FROM dense LEFT JOIN thr USING (sid)),
panel AS (SELECT * REPLACE ({part('n', .9999)}::BIGINT AS n) FROM everything WHERE pos < {part('n', .9999)}),
edges AS (SELECT a.sid AS src, b.sid AS dst, 1.0::DOUBLE AS weight FROM sensors a JOIN sensors b ON b.idx = a.idx OR b.idx = a.idx + 1 OR (a.idx % 2 = 0 AND b.idx = a.idx + 3)),
walk(sid, nb, hop) AS (SELECT sid, sid, 0 FROM sensors UNION SELECT walk.sid, edges.src, hop + 1 FROM walk JOIN edges ON edges.dst = walk.nb WHERE hop < 3),
hops AS (SELECT sid, nb, min(hop) AS hop FROM walk GROUP BY sid, nb HAVING min(hop) > 0),
walkdown(sid, nb, hop) AS (SELECT sid, sid, 0 FROM sensors UNION SELECT walkdown.sid, edges.dst, hop + 1 FROM walkdown JOIN edges ON edges.src = walkdown.nb WHERE hop < 3)"""


HOURLY, WEEKLY = base(HOURLY_READINGS), base(WEEKLY_READINGS)


def hourly(body: str) -> str:
    return f"{HOURLY}\n{body}"


def weekly(body: str) -> str:
    return f"{WEEKLY}\n{body}"


# features as SQL expressions over the panel


def rolling(column: str, k: int, kind: str) -> str:
    how = {"mean": "avg", "std": "stddev_samp", "min": "min"}[kind]
    w = over(f"{k - 1} PRECEDING")
    return f"CASE WHEN count({column}) {w} = {k} THEN {how}({column}) {w} END"


LAGS = {f"lag_{m}min": lag("speed", C.steps(m)) for m in C.lag_minutes(H)}
LONG_LAGS = {"lag_12h": lag("speed", 12), "lag_24h": lag("speed", 24 - K), "lag_48h": lag("speed", 48 - K), "lag_7d": lag("speed", 168 - K)}
ROLLS = {f"roll_{kind}_{m}min": rolling("speed", C.steps(m), kind) for m in C.roll_windows for kind in ("mean", "std")} | {f"roll_min_{m}min": rolling("speed", C.steps(m), "min") for m in C.roll_min_windows}
CHANGES = {"delta_1": f"speed - {lag('speed', 1)}", "delta_5": f"speed - {lag('speed', 5)}", "acceleration_1": f"speed - 2 * {lag('speed', 1)} + {lag('speed', 2)}"}
CONGESTION = {"cong_state": "label"} | {f"cong_mean_{m}min": rolling("label", C.steps(m), "mean") for m in C.roll_windows}
for _m in C.transition_minutes(H):
    _d = f"(label - {lag('label', C.steps(_m))})"
    CONGESTION |= {f"onset_{_m}min": f"({_d} = 1)::INT::DOUBLE", f"recovery_{_m}min": f"({_d} = -1)::INT::DOUBLE"}
NAIVE = {"label_yesterday": lag("label", 24 - K), "label_lastweek": lag("label", 168 - K)}
EMA = {
    f"ema_{m}min": f"CASE WHEN count(speed) {over()} >= {C.steps(m)} THEN sum(speed * power(2.0::DOUBLE, pos / {C.steps(m)}.0::DOUBLE)) {over()} / sum(CASE WHEN speed IS NOT NULL THEN power(2.0::DOUBLE, pos / {C.steps(m)}.0::DOUBLE) END) {over()} END"
    for m in C.half_lives
}
FUTURE = f"coalesce(max(label) {over('1 FOLLOWING', f'{K} FOLLOWING')}, 0)"
TOW = "((isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts))"
BIN = f"(floor({TOW} / {C.bin_minutes})::BIGINT * {C.bin_minutes})"
AHEAD = f"(floor((({TOW} + {H}) % {WEEK}) / {C.bin_minutes})::BIGINT * {C.bin_minutes})"
TURNS = {"day_of_week": ("(isodow(ts) - 1)", 7), "hour_of_day": ("hour(ts)", 24), "minute_of_day": ("(hour(ts) * 60 + minute(ts))", 1440)}
TIMES = {f"{n}_{f}": f"{f}({v}::DOUBLE * {2 * math.pi / p!r}::DOUBLE)" for n, (v, p) in TURNS.items() for f in ("sin", "cos")} | {
    "is_weekend": "(isodow(ts) IN (6, 7))::INT",
    "rushhour": "(hour(ts) IN (7, 8, 9, 16, 17, 18))::INT",
    "is_holiday": "(ts::DATE IN (DATE '2024-01-01', DATE '2024-01-15'))::INT",
}
WHOLE = {"cong_state", "label_yesterday", "label_lastweek", "is_weekend", "rushhour", "is_holiday"}


def columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"({e})::BIGINT AS {n}" if n in WHOLE else r(e, n) for n, e in exprs.items())


STATE = f"""
st1 AS (SELECT sid, pos, label, {lag('label', 1)} AS was FROM panel),
st2 AS (SELECT *, last_value(CASE WHEN was IS NULL OR was <> label THEN pos END IGNORE NULLS) {over()} AS began, last_value(CASE WHEN was = 0 AND label = 1 THEN pos END IGNORE NULLS) {over()} AS onset FROM st1),
st3 AS (SELECT *, CASE WHEN was = 1 AND label = 0 THEN pos - {lag('began', 1)} END AS len FROM st2),
state AS (SELECT sid, pos, ((pos - began) * 60)::BIGINT AS minutes_in_state, ((pos - onset) * 60)::BIGINT AS minutes_since_onset,
  (last_value(len IGNORE NULLS) {over()} * 60)::BIGINT AS previous_episode_minutes FROM st3)"""
PROFILE = f"""
binned AS (SELECT *, {BIN} AS bin, {AHEAD} AS ahead FROM panel),
prof AS (SELECT sid, bin, avg(label) AS cong, avg(speed) AS speed FROM binned WHERE pos < {part('n', .7)} GROUP BY sid, bin),
profiled AS (SELECT b.*, p.cong AS tow_cong_prob, q.cong AS tow_cong_prob_ahead, b.speed - p.speed AS speed_residual
  FROM binned b LEFT JOIN prof p ON p.sid = b.sid AND p.bin = b.bin LEFT JOIN prof q ON q.sid = b.sid AND q.bin = b.ahead)"""


def near(rows: str, measures: dict[str, str]) -> str:
    """CTEs that end in near(sid, pos, <prefix>_h<hop>); a measure has {hop} for the hop."""
    most = 3
    values = {f"{p}{h}": v.format(hop=h) for p, v in measures.items() for h in range(1, most + 1)}
    by = ", ".join(f"CASE hop WHEN 1 THEN {p}1 WHEN 2 THEN {p}2 WHEN 3 THEN {p}3 END AS {p}" for p in measures)
    means = ", ".join(f"CASE WHEN count({p}) = count(*) THEN avg({p}) END AS {p}" for p in measures)
    wide = ", ".join(f"max(CASE WHEN hop = {h} THEN {p} END) AS {p}_h{h}" for p in measures for h in range(1, most + 1))
    return f"""
vals AS (SELECT sid, pos, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in values.items())} FROM {rows}),
met AS (SELECT hops.sid, vals.pos, hops.hop, {by} FROM vals JOIN hops ON hops.nb = vals.sid),
byhop AS (SELECT sid, pos, hop, {means} FROM met GROUP BY sid, pos, hop),
near AS (SELECT sid, pos, {wide} FROM byhop GROUP BY sid, pos)"""


NOW = {"spd": "speed", "cong": "label"}
WAVE = {"wspd": "lag(speed, {hop}) OVER (PARTITION BY sid ORDER BY pos)", "wcong": "lag(label, {hop}) OVER (PARTITION BY sid ORDER BY pos)"}
TRANS = {"trans_on": f"(label - {lag('label', K)} = 1)::INT", "trans_off": f"(label - {lag('label', K)} = -1)::INT"}


def near_query(rows: str, measures: dict[str, str]) -> str:
    names = [f"{p}_h{h}" for p in measures for h in (1, 2, 3)]
    return hourly(f", {near(rows, measures)} SELECT sid, pos, {', '.join(r(n, n) for n in names)} FROM near")


OWN_EXTRA = ["minutes_in_state", "minutes_since_onset", "previous_episode_minutes"]


def own_frame(where: str = "TRUE", more: dict[str, str] | None = None) -> str:
    """CTEs that end in own(sid, idx, pos, ts, all own features): congestion and extra families."""
    exprs = CONGESTION | NAIVE | EMA | (more or {})
    return f"""{STATE}, {PROFILE},
thr_head AS (SELECT sid, quantile_cont(speed, 0.9) * 0.65::DOUBLE AS thr FROM panel WHERE pos < {part('n', .7)} GROUP BY sid),
windowed AS (SELECT sid, pos, {', '.join(f'({e}) AS {n}' for n, e in exprs.items())} FROM panel),
own AS (SELECT p.sid, p.idx, p.pos, p.ts, p.speed, windowed.* EXCLUDE (sid, pos), state.* EXCLUDE (sid, pos), tow_cong_prob, tow_cong_prob_ahead, p.speed - thr AS margin,
  CASE WHEN thr > 0 THEN p.speed / thr END AS margin_ratio, speed_residual
  FROM profiled p JOIN windowed ON windowed.sid = p.sid AND windowed.pos = p.pos JOIN state ON state.sid = p.sid AND state.pos = p.pos LEFT JOIN thr_head ON thr_head.sid = p.sid WHERE {where})"""


EXTRA = [*NAIVE, *OWN_EXTRA, "tow_cong_prob", "tow_cong_prob_ahead", "margin", "margin_ratio", "speed_residual", *EMA]


def melt(table: str, names: list[str], suffix: str | None) -> str:
    """SELECTs of (column_name, value) for each of a table's columns."""
    name = lambda n: f"'{n}'" if suffix is None else suffix if n == "speed" else f"'{n}_' || {suffix}"
    return " UNION ALL ".join(f"SELECT {name(n)} AS column_name, pos, ({n})::DOUBLE AS value FROM {table}" for n in names)


SPEED = LAGS | ROLLS | CHANGES
SPEED_LONG = LAGS | LONG_LAGS | ROLLS | CHANGES


def wide(speed: dict[str, str], measures: dict[str, str], where: str) -> str:
    """CTEs that end in wide(column_name, pos, value)."""
    names = [f"{p}_h{h}" for p in measures for h in (1, 2, 3)]
    return f""", {own_frame(where)}, {near('panel', measures)},
speeds AS (SELECT sid, pos, speed, {', '.join(f'({e}) AS {n}' for n, e in speed.items())} FROM panel),
nears AS (SELECT near.*, sensors.idx::VARCHAR AS idx FROM near JOIN sensors USING (sid)),
calendar AS (SELECT pos, {', '.join(f'({e}) AS {n}' for n, e in TIMES.items())} FROM (SELECT DISTINCT pos, ts FROM panel)),
wide AS ({melt('speeds', ['speed', *speed], 'sid')} UNION ALL {melt('nears', names, 'idx')} UNION ALL {melt('own', [*CONGESTION, *EXTRA], 'sid')} UNION ALL {melt('calendar', list(TIMES), None)})"""


SUMS = f"SELECT column_name, count(value) AS n_values, count(*) AS n_rows, {r('sum(value)', 'total')} FROM {{}} GROUP BY column_name"
ROWS = f"SELECT pos, count(value) AS n_values, count(*) AS n_rows, {r('sum(value)', 'total')} FROM {{}} GROUP BY pos"
FULL_WIDE = wide(SPEED, NOW | TRANS | WAVE, TARGETS)

# correlations of speed features with targets

CORR = f"""
speeds AS (SELECT sid, pos, n, speed, {', '.join(f'({e}) AS {n}' for n, e in SPEED.items())} FROM panel),
x AS ({melt('(SELECT * FROM speeds WHERE pos < ' + part('n', .7) + ')', ['speed', *SPEED], 'sid')}),
moments AS (SELECT column_name, count(value) AS n, avg(value) AS mean, coalesce(var_pop(value), 0) * count(value) AS sxx FROM x GROUP BY column_name),
target AS (SELECT sid, pos, y FROM (SELECT sid, idx, pos, n, {FUTURE} AS y FROM panel) WHERE {TARGETS} AND pos < {part('n', .7)}),
ystats AS (SELECT sid, var_pop(y) * count(y) AS syy FROM target GROUP BY sid),
cross_ AS (SELECT column_name, target.sid, sum(value * y) AS xy, sum(y) AS sy FROM x JOIN target USING (pos) WHERE value IS NOT NULL GROUP BY column_name, target.sid),
corr AS (SELECT ystats.sid, m.column_name, CASE WHEN sqrt(sxx * syy) > 0 THEN coalesce(abs((xy - mean * sy) / sqrt(sxx * syy)), 0) ELSE 0 END AS score
  FROM moments m CROSS JOIN ystats LEFT JOIN cross_ c ON c.column_name = m.column_name AND c.sid = ystats.sid),
cols AS (SELECT column_name, (row_number() OVER (ORDER BY column_name) - 1)::BIGINT AS col_idx FROM moments),
gain AS (SELECT sid, column_name, round(score, 4) AS gain FROM corr)"""


def is_own(name: str, sid: str) -> str:
    return f"({name} = {sid} OR ends_with({name}, '_' || {sid}) OR {name} IN ({', '.join(repr(n) for n in TIMES)}))"


TARGET_COLS = f"tcols AS (SELECT s.sid, cols.*, {is_own('column_name', 's.sid')} AS own FROM cols CROSS JOIN (SELECT sid FROM sensors WHERE {TARGETS}) s)"

# scores


def split_of(horizon_steps: str) -> str:
    m = f"(CASE WHEN n > {horizon_steps} THEN n - {horizon_steps} ELSE n END)"
    return f"CASE WHEN pos >= {m} THEN NULL WHEN pos < {part(m, .7)} THEN 'train' WHEN pos < {part(m, .7)} + {part(m, .1)} THEN 'eval' ELSE 'test' END"


def metrics_sql(scores: str, keys: str) -> str:
    """CTEs that end in metrics(keys, f1, transition_f1, trsp, precision, recall) of scores(keys, y, p, cur, changed)."""
    agg = []
    for g, cond in (("a", "TRUE"), ("m", "cur <> y"), ("t", "changed"), ("s", "NOT changed")):
        agg += [f"count(*) FILTER ({cond} AND y = 1 AND p = 1) AS {g}_tp", f"count(*) FILTER ({cond} AND y = 0 AND p = 1) AS {g}_fp", f"count(*) FILTER ({cond} AND y = 1 AND p = 0) AS {g}_fn", f"count(*) FILTER ({cond}) AS {g}_n", f"count(*) FILTER ({cond} AND y = 1) AS {g}_pos", f"count(*) FILTER ({cond} AND y = p) AS {g}_right"]
    f1 = lambda g: f"(CASE WHEN 2 * {g}_tp + {g}_fp + {g}_fn = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {g}_tp / (2 * {g}_tp + {g}_fp + {g}_fn) END)"
    region = lambda g: f"(CASE WHEN {g}_n = 0 THEN 1.0::DOUBLE WHEN {g}_pos = 0 OR {g}_pos = {g}_n THEN {g}_right::DOUBLE / {g}_n ELSE {f1(g)} END)"
    return f"""
counts AS (SELECT {keys}, {', '.join(agg)} FROM {scores} GROUP BY {keys}),
metrics AS (SELECT {keys}, {f1('a')} AS f1, CASE WHEN m_n > 0 THEN {f1('m')} END AS transition_f1,
  CASE WHEN {region('t')} <= 0 OR {region('s')} <= 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (0.5::DOUBLE / {region('t')} + 0.5::DOUBLE / {region('s')}) END AS trsp,
  CASE WHEN a_tp + a_fp = 0 THEN 0.0::DOUBLE ELSE a_tp::DOUBLE / (a_tp + a_fp) END AS precision, CASE WHEN a_tp + a_fn = 0 THEN 0.0::DOUBLE ELSE a_tp::DOUBLE / (a_tp + a_fn) END AS recall FROM counts)"""


def changed(rows: str, keys: str) -> str:
    flip = f"CASE WHEN y <> lag(y) OVER (PARTITION BY {keys} ORDER BY pos) THEN 1 ELSE 0 END"
    return f"flips AS (SELECT *, {flip} AS flip FROM {rows}), marked AS (SELECT *, max(flip) {over('1 PRECEDING', '1 FOLLOWING', keys)} = 1 AS changed FROM flips)"


def naive_scores(where: str) -> str:
    parts = []
    for h in C.horizons:
        k = C.steps(h)
        future = f"coalesce(max(label) {over('1 FOLLOWING', f'{k} FOLLOWING')}, 0)"
        parts.append(f"SELECT sid, pos, {h} AS horizon_min, label AS cur, {future} AS y, label AS naive_persistence, coalesce({lag('label', 24 - k)}, 0) AS naive_yesterday, coalesce({lag('label', 168 - k)}, 0) AS naive_lastweek, {split_of(str(k))} AS split FROM (SELECT * FROM panel WHERE {where})")
    methods = " UNION ALL ".join(f"SELECT '{m}' AS method, sid, horizon_min, pos, y, {m} AS p, cur, changed FROM marked" for m in ("naive_persistence", "naive_yesterday", "naive_lastweek"))
    return f""", allrows AS ({' UNION ALL '.join(parts)}), tests AS (SELECT * FROM allrows WHERE split = 'test'), {changed('tests', 'sid, horizon_min')}, scores AS ({methods}), {metrics_sql('scores', 'method, sid, horizon_min')}"""


METRICS = ", ".join(r(m, m) for m in ("f1", "transition_f1", "trsp", "precision", "recall"))


def summary(dataset: str) -> str:
    return f"""SELECT '{dataset}' AS dataset, 'naive' AS experiment, method, horizon_min::BIGINT AS horizon_min, {r('avg(f1)', 'f1_mean')}, {r('avg(transition_f1)', 'transition_f1_mean')}, {r('avg(trsp)', 'trsp')},
  {r('avg(precision)', 'prec_mean')}, {r('avg(recall)', 'rec_mean')}, NULL::DOUBLE AS inference_us_all_nodes, NULL::DOUBLE AS inference_us_per_node FROM metrics GROUP BY method, horizon_min"""


PROFILE_SCORES = f""", {PROFILE}, prows AS (SELECT sid, pos, label AS cur, coalesce(tow_cong_prob_ahead, 0) AS prob, {FUTURE} AS y, {split_of(str(K))} AS split FROM (SELECT * FROM profiled WHERE {TARGETS})),
erows AS (SELECT * FROM prows WHERE split IS NOT NULL), {changed('erows', 'sid, split')}"""
GRID = "(SELECT unnest(range(1, 49)) AS k) g"
CURVE = f"""{PROFILE_SCORES}, tried AS (SELECT sid, k, y, cur, changed, (prob >= 0.02::DOUBLE + 0.02::DOUBLE * (k - 1))::INT AS p FROM marked CROSS JOIN {GRID} WHERE split = 'eval'), {metrics_sql('tried', 'sid, k')}"""
LIMIT = "0.02::DOUBLE + 0.02::DOUBLE * (k - 1)"


def best(metric: str) -> str:
    return f"SELECT sid, '{metric}' AS metric, {LIMIT} AS threshold, {'coalesce(transition_f1, f1)' if metric == 'transition_f1' else metric} AS score, f1 FROM metrics QUALIFY row_number() OVER (PARTITION BY sid ORDER BY {'coalesce(transition_f1, f1)' if metric == 'transition_f1' else metric} DESC NULLS LAST, k) = 1"


# reports


def group_of(known: str) -> str:
    spatial = r"'^(spd|cong|trans_on|trans_off|wspd|wcong)_h(\d+)_(\d+)$'"
    end = r"coalesce(nullif(regexp_extract(column_name, '_(\d+)$', 1), ''), CASE WHEN regexp_full_match(column_name, '\d+') THEN column_name END)"
    return rf"""CASE WHEN column_name IN (SELECT sid FROM {known}) THEN 'sensor_current_speed'
  WHEN regexp_matches(column_name, {spatial}) THEN 'spatial_' || regexp_extract(column_name, {spatial}, 1) || '_h' || regexp_extract(column_name, {spatial}, 2)
  WHEN {end} IN (SELECT sid FROM {known}) THEN 'sensor_' || regexp_extract(column_name, '^(.+)_\d+$', 1)
  WHEN regexp_full_match(column_name, '(.+)_\d+') AND regexp_matches(column_name, '^(lag_|roll_|delta_|acceleration_)') THEN 'sensor_' || regexp_extract(column_name, '^(.+)_\d+$', 1)
  WHEN regexp_full_match(column_name, '\d+') THEN 'sensor_current_speed' ELSE column_name END"""


IMPORTANCE = hourly(
    f""", {CORR}, rows_ AS (SELECT 'global_W1' AS variant, {H}::BIGINT AS horizon_min, sid, gain, {group_of('sensors')} AS feature_group FROM gain WHERE gain >= 0.05),
permodel AS (SELECT variant, horizon_min, sid, feature_group, sum(gain) AS s, count(*) AS k FROM rows_ GROUP BY ALL),
rolled AS (SELECT variant, horizon_min, feature_group, sum(s) AS s, sum(k)::BIGINT AS k, count(*) AS models FROM permodel GROUP BY ALL),
picked AS (SELECT variant, horizon_min, feature_group, count(*) AS c FROM rows_ WHERE gain >= 0.15 GROUP BY ALL),
normed AS (SELECT *, c::DOUBLE / max(c) OVER (PARTITION BY variant, horizon_min) AS share FROM picked)
SELECT variant, horizon_min, 'gain' AS importance_type, feature_group, {r('s / k', 'mean_importance')}, {r('s', 'sum_importance')}, k AS n_columns, models AS n_models_with_feature,
  coalesce(c, 0) AS selected_count, {r('coalesce(share, 0)', 'selected_count_norm')} FROM rolled LEFT JOIN normed USING (variant, horizon_min, feature_group)"""
)
WEEKLY_OWN = SPEED | CONGESTION
WEEKLY_COLS = [*WEEKLY_OWN, *OWN_EXTRA]
ALL_NEAR = NOW | TRANS | WAVE

ORACLES = {
    "wide_csv_round_trip": hourly(f"SELECT ts, sid, {r('speed', 'speed')} FROM readings"),
    "wide_csv_sensors": hourly("SELECT s.sid, count(speed) AS n_readings, count(*) AS n_cells FROM (SELECT DISTINCT ts FROM readings) t CROSS JOIN sensors s LEFT JOIN readings USING (ts, sid) GROUP BY s.sid"),
    "graph_from_matrix": hourly("SELECT src, dst, weight FROM edges"),
    "zero_report": hourly(f"SELECT count(*) FILTER (speed = 0) AS n_zero, count(DISTINCT ts) * (SELECT count(*) FROM sensors) AS n_cells, {r('100.0 * count(*) FILTER (speed = 0) / (count(DISTINCT ts) * (SELECT count(*) FROM sensors))', 'percent')} FROM readings"),
    "choices_json_lines": hourly(f"SELECT 'hourly' AS dataset, '{' '.join(map(str, C.horizons))}' AS horizons, {r('thr', 'threshold')}, sid FROM thr"),
    "importance_csv": IMPORTANCE,
    "importance_report": IMPORTANCE,
    "time_axis": hourly("SELECT ts, pos, n FROM axis"),
    "time_axis_all_present": hourly("SELECT ts, (row_number() OVER (ORDER BY ts) - 1)::BIGINT AS pos, count(*) OVER () AS n FROM (SELECT ts FROM readings GROUP BY ts HAVING count(speed) = (SELECT count(*) FROM sensors))"),
    "thresholds": hourly(f"SELECT thr.sid, {r('thr', 'thr')}, {r('a.t', 'thr_all')} FROM thr JOIN (SELECT sid, quantile_cont(speed, 0.9) * 0.65::DOUBLE AS t FROM dense GROUP BY sid) a ON a.sid = thr.sid"),
    "labelled_panel": hourly(f"SELECT sid, idx, pos, ts, n, {r('speed', 'speed')}, label::BIGINT AS label FROM panel"),
    "target_splits": hourly(f"SELECT * FROM (SELECT sid, pos, label::BIGINT AS label, ({FUTURE})::BIGINT AS y, {split_of(str(K))} AS split FROM panel) WHERE split IS NOT NULL"),
    "inner_validation": hourly(f", train AS (SELECT * FROM (SELECT sid, pos, {split_of(str(K))} AS split FROM panel) WHERE split = 'train') SELECT sid, pos, pos >= greatest(1, least((SELECT max(pos) FROM train), floor((SELECT max(pos) + 1 FROM train)::DOUBLE * (1 - 0.1::DOUBLE)))) AS is_val FROM train"),
    "current_labels": hourly("SELECT a.sid, a.pos + 5 AS pos, coalesce(b.label, 0)::BIGINT AS current_label FROM everything a LEFT JOIN everything b ON b.sid = a.sid AND b.pos = a.pos + 5"),
    "target_sensor_rows": hourly(f"SELECT sid, count(*) AS n_rows, sum(label)::BIGINT AS n_congested FROM everything WHERE {TARGETS} GROUP BY sid"),
    "calendar_features": hourly(f"SELECT ts, pos, {columns(TIMES)} FROM axis"),
    "week_bins": hourly(f"SELECT pos, {TOW}::BIGINT AS minute_of_week, {BIN} AS bin, {AHEAD} AS bin_ahead FROM axis"),
    "speed_lags": hourly(f"SELECT sid, pos, {columns(LAGS | LONG_LAGS)} FROM panel"),
    "rolling_windows": hourly(f"SELECT sid, pos, {columns(ROLLS)} FROM panel"),
    "speed_changes": hourly(f"SELECT sid, pos, {columns(CHANGES)} FROM panel"),
    "congestion_windows": hourly(f"SELECT sid, pos, {columns(CONGESTION)} FROM panel"),
    "state_times": hourly(f", {STATE} SELECT sid, pos, minutes_in_state, minutes_since_onset, previous_episode_minutes FROM state"),
    "naive_label_features": hourly(f"SELECT sid, pos, {columns(NAIVE)} FROM panel"),
    "exponential_means": hourly(f"SELECT sid, pos, {columns(EMA)} FROM panel"),
    "threshold_margin": hourly(f", t AS (SELECT sid, quantile_cont(speed, 0.9) * 0.65::DOUBLE AS thr FROM panel WHERE pos < {part('n', .7)} GROUP BY sid) SELECT sid, pos, {r('speed - t.thr', 'margin')}, {r('CASE WHEN t.thr > 0 THEN speed / t.thr END', 'margin_ratio')} FROM panel LEFT JOIN t USING (sid)"),
    "congestion_profile": hourly(f", {PROFILE} SELECT sid, pos, {r('tow_cong_prob', 'tow_cong_prob')}, {r('tow_cong_prob_ahead', 'tow_cong_prob_ahead')} FROM profiled"),
    "speed_residual": hourly(f", {PROFILE} SELECT sid, pos, {r('speed_residual', 'speed_residual')} FROM profiled"),
    "downstream_hops": weekly("SELECT sid, nb AS nb_sid, min(hop)::BIGINT AS hop FROM walkdown GROUP BY sid, nb HAVING min(hop) > 0"),
    "upstream_hops": weekly("SELECT sid, nb AS nb_sid, hop::BIGINT AS hop FROM hops"),
    "neighbour_means": near_query("everything", NOW),
    "neighbour_waves": near_query("everything", WAVE),
    "neighbour_transitions": near_query("everything", TRANS),
    "graph_alignment": weekly(", known AS (SELECT (s_suppkey + 100000)::VARCHAR AS sid FROM supplier WHERE s_acctbal >= 0) SELECT coalesce(a.sid, b.sid) AS sid, CASE WHEN a.sid IS NULL THEN 'graph' ELSE 'readings' END AS only_in FROM sensors a FULL JOIN known b ON a.sid = b.sid WHERE a.sid IS NULL OR b.sid IS NULL"),
    "graph_order": weekly(", known AS (SELECT (s_suppkey + 100000)::VARCHAR AS sid, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS idx FROM supplier), own AS (SELECT sid, row_number() OVER (ORDER BY idx) - 1 AS idx FROM sensors) SELECT coalesce(a.sid, b.sid) AS sid, CASE WHEN a.sid IS NULL THEN 'graph' WHEN b.sid IS NULL THEN 'readings' ELSE 'order' END AS only_in FROM own a FULL JOIN known b ON a.sid = b.sid WHERE a.sid IS NULL OR b.sid IS NULL OR a.idx <> b.idx"),
    "training_time": hourly(f"SELECT 'hourly' AS dataset, 'naive' AS experiment, 'naive_persistence' AS method, {r('round(count(*)::DOUBLE / 60, 2)', 'tt_mins')} FROM everything"),
    "graph_report": weekly("SELECT (SELECT count(*) FROM edges a FULL JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) > 1e-8 + 1e-5 * abs(coalesce(b.weight, 0))) = 0 AS is_symmetric, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM sensors WHERE sid NOT IN (SELECT dst FROM edges WHERE src <> dst)) AS n_without_upstream"),
    "local_frame_columns": hourly(f", {own_frame(TARGETS, SPEED | {'y': FUTURE})}, timed AS (SELECT *, {', '.join(f'({e}) AS {n}' for n, e in TIMES.items())} FROM own), long AS ({melt('timed', [n for n in [*SPEED, *CONGESTION, *EXTRA, *TIMES, 'y']], None)} UNION ALL SELECT 'speed', pos, speed FROM timed) " + SUMS.format("long")),
    "local_frame_rows": hourly(f", {own_frame(TARGETS, SPEED | {'y': FUTURE})}, timed AS (SELECT *, {', '.join(f'({e}) AS {n}' for n, e in TIMES.items())} FROM own), long AS ({melt('timed', [n for n in [*SPEED, *CONGESTION, *EXTRA, *TIMES, 'y']], None)} UNION ALL SELECT 'speed', pos, speed FROM timed) " + ROWS.format("long")),
    "wide_frame_columns": hourly(f"{FULL_WIDE} {SUMS.format('wide')}"),
    "wide_frame_rows": hourly(f"{FULL_WIDE} {ROWS.format('wide')}"),
    "snapshot_frame_columns": hourly(f"{wide(SPEED_LONG, NOW, 'TRUE')} {SUMS.format('wide')}"),
    "snapshot_frame_rows": hourly(f"{wide(SPEED_LONG, NOW, 'TRUE')} {ROWS.format('wide')}"),
    "features_with_target": hourly(f", t AS (SELECT sid, pos, {FUTURE} AS y FROM panel) SELECT p.sid, p.pos + 3 AS pos, {r('speed', 'speed')}, t.y::BIGINT AS y FROM panel p LEFT JOIN t ON t.sid = p.sid AND t.pos = p.pos + 3"),
    "column_moments": hourly(f", {CORR} SELECT column_name, n, {r('mean', 'mean')}, {r('sxx', 'sxx')} FROM moments"),
    "target_correlations": hourly(f", {CORR} SELECT sid, column_name, {r('score', 'score')} FROM corr"),
    "prefiltered_columns": hourly(f", {CORR}, {TARGET_COLS} SELECT sid, column_name, own, {r('gain', 'score')} FROM tcols JOIN gain USING (sid, column_name) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY own DESC, gain DESC, col_idx DESC) <= greatest(40, count(*) FILTER (own) OVER (PARTITION BY sid))"),
    "own_and_cross_columns": hourly(f", {CORR}, {TARGET_COLS}, ranked AS (SELECT t.*, row_number() OVER (PARTITION BY t.sid ORDER BY own DESC, CASE WHEN own THEN 0 ELSE -coalesce(gain, 0) END, col_idx) AS rank, count(*) FILTER (own) OVER (PARTITION BY t.sid) AS n_own FROM tcols t LEFT JOIN (SELECT * FROM gain WHERE gain >= 0.1) g ON g.sid = t.sid AND g.column_name = t.column_name) SELECT sid, column_name, rank FROM ranked WHERE rank <= greatest(30, n_own)"),
    "top_gain_columns": hourly(f", {CORR}, {TARGET_COLS} SELECT t.sid, t.column_name, row_number() OVER (PARTITION BY t.sid ORDER BY gain IS NULL, gain DESC, col_idx) AS rank FROM tcols t LEFT JOIN (SELECT * FROM gain WHERE gain >= 0.1) g ON g.sid = t.sid AND g.column_name = t.column_name QUALIFY rank <= 20"),
    "row_weights": hourly(f", t AS (SELECT * FROM (SELECT sid, label, {FUTURE} AS y, {split_of(str(K))} AS split FROM panel) WHERE split IS NOT NULL) SELECT sid, split, {r('sum(CASE WHEN label <> y THEN 3.0 ELSE 1.0 END)', 'total_weight')}, max(n_raised) AS n_raised FROM t JOIN (SELECT sid, count(*) FILTER (label <> y) AS n_raised FROM t WHERE split = 'train' GROUP BY sid) q USING (sid) GROUP BY sid, split"),
    "class_weights": hourly(f", t AS (SELECT * FROM (SELECT sid, {FUTURE} AS y, {split_of(str(K))} AS split FROM panel) WHERE split = 'train') SELECT sid, {r('CASE WHEN sum(y) = 0 OR sum(y) = count(*) THEN 1 ELSE (count(*) - sum(y))::DOUBLE / sum(y) END', 'class_weight')} FROM t GROUP BY sid"),
    "soft_labels": hourly(f", {PROFILE}, t AS (SELECT sid, pos, speed, tow_cong_prob_ahead AS p, {FUTURE} AS y FROM profiled) SELECT sid, pos, y::BIGINT AS y, {r('0.3::DOUBLE * coalesce(CASE WHEN speed IS NOT NULL THEN p END, 0.5) + 0.7::DOUBLE * y', 'soft')} FROM t"),
    "naive_metrics": hourly(f"{naive_scores(TARGETS)} SELECT method, sid, horizon_min::BIGINT AS horizon_min, {METRICS} FROM metrics"),
    "naive_summary": hourly(f"{naive_scores(TARGETS)} {summary('hourly')}"),
    "weekly_naive_summary": weekly(f"{naive_scores('TRUE')} {summary('weekly')}"),
    "threshold_curve": hourly(f"{CURVE} SELECT 'profile' AS method, sid, {H}::BIGINT AS horizon_min, k::BIGINT AS k, {r(LIMIT, 'threshold')}, {METRICS} FROM metrics"),
    "best_thresholds": hourly(f"{CURVE} SELECT sid, metric, {r('threshold', 'threshold')}, {r('score', 'score')}, {r('f1', 'f1')} FROM ({best('f1')} UNION ALL {best('transition_f1')} UNION ALL {best('trsp')})"),
    "test_metrics_at_threshold": hourly(f"{CURVE}, chosen AS ({best('trsp')}), test AS (SELECT marked.sid, y, cur, changed, (prob >= threshold)::INT AS p FROM marked JOIN chosen USING (sid) WHERE split = 'test'), " + metrics_sql("test", "sid").replace("counts", "counts2").replace("metrics", "metrics2") + f" SELECT 'profile' AS method, sid, {H}::BIGINT AS horizon_min, {METRICS} FROM metrics2"),
    "feature_groups": hourly(f"{FULL_WIDE}, known AS (SELECT sid FROM sensors WHERE idx IN (3, 5, 7, 9)) SELECT column_name, {group_of('known')} AS feature_group FROM (SELECT DISTINCT column_name FROM wide)"),
    "horizon_suffixes": hourly(f""", {CORR}, s AS (SELECT CASE WHEN column_name = sid THEN '__current_speed__' WHEN ends_with(column_name, '_' || sid) THEN left(column_name, length(column_name) - length(sid) - 1) WHEN contains(column_name, sid) THEN replace(column_name, sid, '{{sid}}') END AS suffix, gain, col_idx FROM gain JOIN cols USING (column_name) WHERE gain >= 0.05),
t AS (SELECT suffix, sum(gain) AS score, min(col_idx) AS seq FROM s WHERE suffix IS NOT NULL GROUP BY suffix) SELECT 1.0::DOUBLE AS transition_weight, {H}::BIGINT AS horizon_min, suffix, {r('score', 'score')}, row_number() OVER (ORDER BY score DESC, seq, suffix) AS rank FROM t"""),
    "common_params": hourly(f""", t AS (SELECT sid, idx, sum(label) AS hot FROM everything GROUP BY sid, idx), u AS (SELECT '{{"eta":0.05,"max_depth":' || (3 + hot % 3)::VARCHAR || '.0}}' AS params, idx FROM t)
SELECT 1.0::DOUBLE AS transition_weight, {H}::BIGINT AS horizon_min, params, count(*) AS n_models FROM u GROUP BY params ORDER BY n_models DESC, min(idx) LIMIT 1"""),
    "weekly_local_features": weekly(f", {STATE}, f AS (SELECT sid, pos, {', '.join(f'({e}) AS {n}' for n, e in WEEKLY_OWN.items())} FROM panel) SELECT f.sid, {', '.join(f'count({n}) AS n_{n}' for n in WEEKLY_COLS)} FROM f JOIN state USING (sid, pos) GROUP BY f.sid"),
    "weekly_neighbours": weekly(f", {near('everything', ALL_NEAR)} SELECT sid, {', '.join(f'count({p}_h{h}) AS n_{p}_h{h}' for p in ALL_NEAR for h in (1, 2, 3))}, {', '.join(r(f'avg({p}_h{h})', f'{p}_h{h}') for p in ('cong', 'trans_on', 'trans_off') for h in (1, 2, 3))} FROM near GROUP BY sid"),
}

_ORIGINS = """, links AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), hot AS (SELECT ts, sid FROM everything WHERE label = 1),
scores AS (SELECT sensors.sid, sensors.idx, count(h.sid) AS score FROM sensors LEFT JOIN (
  SELECT * FROM hot h WHERE NOT EXISTS (SELECT 1 FROM links JOIN hot d ON d.sid = links.dst WHERE links.src = h.sid AND d.ts = h.ts)
    AND EXISTS (SELECT 1 FROM links JOIN hot u ON u.sid = links.src WHERE links.dst = h.sid AND u.ts = h.ts)) h ON h.sid = sensors.sid GROUP BY ALL)"""
ORACLES["origin_scores"] = weekly(f"{_ORIGINS} SELECT * FROM scores")
ORACLES["top_origins"] = hourly(f"{_ORIGINS} SELECT * FROM scores WHERE score > 0 ORDER BY score DESC, idx LIMIT 10")
ORACLES["result_append"] = hourly("SELECT * FROM (" + ORACLES["zero_report"].removeprefix(HOURLY).strip() + "), (SELECT unnest([1, 2]))").replace("SELECT * FROM (SELECT", "SELECT n_zero, n_cells, percent FROM (SELECT", 1)
TRIED = f"""{PROFILE_SCORES}, tried AS (SELECT sid, c, k, y, cur, changed, (CASE c WHEN 0 THEN prob WHEN 1 THEN prob * prob ELSE 1 - prob END >= 0.02::DOUBLE + 0.02::DOUBLE * (k - 1))::INT AS p
FROM marked CROSS JOIN {GRID} CROSS JOIN range(3) t(c) WHERE split = 'eval'), {metrics_sql('tried', 'sid, c, k')}"""
FIRST = "SELECT *, row_number() OVER (PARTITION BY sid, c ORDER BY trsp DESC NULLS LAST, k) AS place FROM metrics"
ORACLES |= {
    "search_choice": hourly(f"{TRIED} SELECT sid, c AS cand, {r(LIMIT, 'threshold')}, {r('trsp', 'score')}, {r('f1', 'f1')} FROM ({FIRST}) WHERE place = 1 QUALIFY row_number() OVER (PARTITION BY sid ORDER BY coalesce(trsp, -1) DESC, c) = 1"),
    "artifacts_round_trip": hourly(f"{PROFILE_SCORES} SELECT sid, {H}::BIGINT AS horizon_min, 3.0::DOUBLE AS transition_weight, pos, {r('prob * 3', 'prob')} FROM marked WHERE split = 'train'"),
    "boosted_fits": hourly(f"{PROFILE_SCORES} SELECT sid, 2::BIGINT AS n_rounds, 1.0::DOUBLE AS gain, 0::BIGINT AS n_left_out, count(*) AS n_rows, 0::BIGINT AS n_outside, count(DISTINCT pos) AS n_pos FROM marked GROUP BY sid"),
}
#: Queries on chunks of a long axis give what those on whole sensors do.
ORACLES |= {f"{name}_in_chunks": ORACLES[name] for name in ("speed_lags", "rolling_windows", "congestion_windows", "state_times", "exponential_means")}
ORACLES |= {f"{name}_by_ranges": ORACLES[name] for name in ("time_axis", "thresholds")}
