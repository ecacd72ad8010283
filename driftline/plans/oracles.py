"""DuckDB SQL that says independently what the queries of ``queries`` return."""

from __future__ import annotations


def r(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.500123) / 10000"


def fine(x: str) -> str:
    return f"floor(({x}) * 1e7 + 0.500123) / 1e7"


EMBED = "('view', 'click')"
#: Tables that queries share, in an order in which each needs only earlier ones.
PARTS = {
    "e0": "SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6::DOUBLE AS time, event_type, value FROM events",
    "ts0": "SELECT user_id, min(time) AS t_start FROM e0 WHERE event_type = 'signup' AND value >= 150 GROUP BY user_id",
    "dyn": """SELECT 'P' || e0.user_id AS pid, e0.time, CASE WHEN event_type = 'error' THEN 'Med_error' ELSE event_type END AS feature_name,
        CASE WHEN event_type = 'error' THEN CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE value END AS value,
        CASE WHEN t_start IS NOT NULL AND e0.time >= t_start THEN 1 ELSE 0 END AS treated FROM e0 LEFT JOIN ts0 USING (user_id)""",
    "sta": """SELECT 'P' || c_custkey AS pid, (45 + c_custkey % 40)::INT AS age, (c_nationkey % 2)::INT AS sex, (c_custkey % 6)::INT AS cci, (20 + c_custkey % 11)::DOUBLE AS Tmax
        FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""",
    "grid": """SELECT pid, i::INT AS bin_idx, i::DOUBLE AS "start", (i + 1)::DOUBLE AS "stop" FROM (SELECT pid, unnest(range(ceil(Tmax)::INT)) AS i FROM sta WHERE pid IN (SELECT pid FROM dyn))""",
    "tst": "SELECT pid, min(time) FILTER (WHERE treated = 1) AS t_start FROM dyn GROUP BY pid",
    "tgrid": 'SELECT g.*, CASE WHEN t_start IS NOT NULL AND "start" >= t_start THEN 1 ELSE 0 END AS treatment FROM grid g LEFT JOIN tst USING (pid)',
    "inb": 'SELECT d.*, g.bin_idx, g."start", g."stop" FROM dyn d JOIN grid g ON d.pid = g.pid AND d.time >= g."start" AND d.time < g."stop"',
    "bm": "SELECT pid, bin_idx, feature_name, avg(value) AS v FROM inb GROUP BY ALL",
    "lb": "SELECT pid, bin_idx, feature_name, max([time, value])[2] AS v FROM inb GROUP BY ALL",
    "kind": "SELECT pid, feature_name, (starts_with(feature_name, 'Med') OR bool_and(coalesce(value IN (0.0, 1.0), false))) AS is_binary FROM dyn GROUP BY pid, feature_name",
    "held": """SELECT pid, bin_idx, feature_name, coalesce(before_, first_)[2] AS v FROM (
        SELECT g.pid, g.bin_idx, d.feature_name, max([d.time, d.value]) FILTER (WHERE d.time <= g."start") AS before_, min([d.time, d.value]) AS first_ FROM grid g JOIN dyn d ON d.pid = g.pid GROUP BY ALL)""",
    "agg0": """SELECT g.*, CASE WHEN k.is_binary THEN h.v ELSE b.v END AS p, coalesce(m.v, 0.0) AS Med_error FROM tgrid g
        LEFT JOIN kind k ON k.pid = g.pid AND k.feature_name = 'purchase' LEFT JOIN bm b ON b.pid = g.pid AND b.bin_idx = g.bin_idx AND b.feature_name = 'purchase'
        LEFT JOIN held h ON h.pid = g.pid AND h.bin_idx = g.bin_idx AND h.feature_name = 'purchase' LEFT JOIN held m ON m.pid = g.pid AND m.bin_idx = g.bin_idx AND m.feature_name = 'Med_error'""",
    "agg1": "SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY pid ORDER BY bin_idx) AS p1 FROM agg0",
    "agg": 'SELECT pid, bin_idx, "start", "stop", treatment, coalesce(p1, (SELECT median(p1) FROM agg1)) AS purchase, Med_error FROM agg1',
    "sb": """SELECT a.*, age, sex, cci, Tmax, coalesce(bin_idx = f, false)::DOUBLE AS y_event, coalesce(bin_idx <= f, true)::DOUBLE AS at_risk,
        purchase * 0.02 + Med_error * -0.3 + age * 0.01 + sex * 0.2 + cci * -0.05 AS eta
        FROM (SELECT *, min(bin_idx) FILTER (WHERE treatment = 1) OVER (PARTITION BY pid) AS f FROM agg) a JOIN sta USING (pid)""",
    "win": """SELECT pid, feature_name, time, value, count(*) OVER w AS n, avg(value) OVER w AS mean, coalesce(nullif(stddev_pop(value) OVER w, 0.0), 1.0) AS sd, min(time) OVER w AS tmin,
        max(time) OVER w AS tmax, regr_slope(value, time) OVER w AS slope, sum(value) OVER w AS total FROM dyn
        WINDOW w AS (PARTITION BY pid, feature_name ORDER BY time RANGE BETWEEN 14.0 PRECEDING AND CURRENT ROW)""",
    "trend": f"SELECT DISTINCT pid AS patient_id, feature_name AS lab, time, {r('slope')} AS traj_prob_slope, {r('mean')} AS traj_prob_level FROM win WHERE n >= 6",
    "ali": """SELECT g.pid, g.bin_idx, CASE WHEN v.time IS NULL THEN 0.0 ELSE v.traj_prob_slope END AS traj_prob_slope__view, CASE WHEN v.time IS NULL THEN 0.0 ELSE v.traj_prob_level END AS traj_prob_level__view,
        CASE WHEN c.time IS NULL THEN 0.0 ELSE c.traj_prob_slope END AS traj_prob_slope__click, CASE WHEN c.time IS NULL THEN 0.0 ELSE c.traj_prob_level END AS traj_prob_level__click
        FROM grid g ASOF LEFT JOIN (SELECT * FROM trend WHERE lab = 'view') v ON g.pid = v.patient_id AND g."start" >= v.time
        ASOF LEFT JOIN (SELECT * FROM trend WHERE lab = 'click') c ON g.pid = c.patient_id AND g."start" >= c.time""",
    "idxm": f"""SELECT g.pid, g.bin_idx, (count(DISTINCT d.time) FILTER (WHERE d.time <= g."start") - 1)::INT AS idx FROM grid g LEFT JOIN (SELECT * FROM dyn WHERE feature_name IN {EMBED}) d ON g.pid = d.pid GROUP BY ALL""",
    "w3": "SELECT pid, bin_idx, coalesce(bin_idx = f, false)::DOUBLE AS y_event, coalesce(bin_idx <= f, true)::DOUBLE AS at_risk FROM (SELECT *, min(bin_idx) FILTER (WHERE treatment = 1) OVER (PARTITION BY pid) AS f FROM tgrid)",
    "visit": "SELECT 'C' || o_custkey AS patient_id, datediff('day', DATE '1995-01-01', o_orderdate::DATE) / 365.25::DOUBLE AS time, o_totalprice::DOUBLE / 1000.0::DOUBLE AS lab_value FROM orders",
    "ov": "SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY time) - 1 AS i FROM (SELECT patient_id, time, sum(lab_value) / 100.0::DOUBLE AS y FROM visit GROUP BY patient_id, time)",
    "iv": 'SELECT * FROM (SELECT lag(time) OVER w AS "start", time AS "stop", (y > 2)::INT AS treatment, lag(y) OVER w AS x0, lag(time) OVER w / 10 AS x1 FROM ov WINDOW w AS (PARTITION BY patient_id ORDER BY time)) WHERE "start" IS NOT NULL',
    "ivt": 'SELECT "stop" AS t, row_number() OVER (ORDER BY "stop") - 1 AS place, count(*) AS deaths, sum(exp(x0 * 0.3 + x1 * -0.2)) AS d_s0 FROM iv WHERE treatment = 1 GROUP BY "stop"',
    "sl": "SELECT patient_id, i - 1 AS i, (y - y0) / (time - t0) AS slope FROM (SELECT *, lag(y) OVER w AS y0, lag(time) OVER w AS t0 FROM ov WINDOW w AS (PARTITION BY patient_id ORDER BY time)) WHERE i > 0",
    "sv": "SELECT patient_id, list_sort(list(slope)) AS s, len(list(slope)) AS k, len(list(slope)) // 2 AS half FROM sl GROUP BY patient_id HAVING count(*) > 1",
    "emb": "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings",
}
NAMES = list(PARTS)


def needed(sql: str) -> list[str]:
    """The parts that a text names, and those that these name."""
    import re

    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in NAMES:
            if name not in found and re.search(rf"\b(FROM|JOIN) {name}\b", text):
                found.add(name)
                todo.append(PARTS[name])
    return [n for n in NAMES if n in found]


def full(sql: str) -> str:
    parts = ", ".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in needed(sql))
    return f"WITH {parts} {sql}" if parts else sql


def wide_means(fill: str) -> str:
    """Bin means of both embedded features on the grid."""
    v, c = "max(v) FILTER (WHERE feature_name = 'view')", "max(v) FILTER (WHERE feature_name = 'click')"
    return f"SELECT g.pid, g.bin_idx, {fill.format(v)} AS view, {fill.format(c)} AS click FROM grid g LEFT JOIN bm ON bm.pid = g.pid AND bm.bin_idx = g.bin_idx GROUP BY ALL"


FILLED = """(SELECT pid, bin_idx, last_value(view IGNORE NULLS) OVER w AS view, last_value(click IGNORE NULLS) OVER w AS click
    FROM ({}) WINDOW w AS (PARTITION BY pid ORDER BY bin_idx))""".format(wide_means("{}"))


def seen_at(left: str, keep: str, at: str) -> str:
    """Values, masks and gaps of both embedded features at a time of ``left``; dt is the last feature's that was seen."""
    return f"""SELECT {keep}, coalesce(v0[2], 0.0) AS x0, coalesce(v1[2], 0.0) AS x1, (v0 IS NOT NULL)::INT::DOUBLE AS m0, (v1 IS NOT NULL)::INT::DOUBLE AS m1,
      {r('CASE WHEN v1 IS NOT NULL THEN greatest(1e-6, at_ - v1[1]) WHEN v0 IS NOT NULL THEN greatest(1e-6, at_ - v0[1]) ELSE 1.0 END')} AS dt FROM (
        SELECT l.*, l.{at} AS at_, max([d.time, d.value]) FILTER (WHERE d.feature_name = 'view') AS v0, max([d.time, d.value]) FILTER (WHERE d.feature_name = 'click') AS v1
        FROM {left} l LEFT JOIN (SELECT * FROM dyn WHERE feature_name IN {EMBED}) d ON d.pid = l.pid AND d.time <= l.{at} GROUP BY ALL)"""


def flags(cases: dict[str, str]) -> str:
    return "SELECT patient_id, " + ", ".join(f"coalesce({c}, false)::INT AS {n}" for n, c in cases.items()) + " FROM sv"


def part_of(condition: str) -> str:
    return f"len(list_filter(s, lambda x: {condition})) / k"


APART = "abs(list_avg(s[1:half]) - list_avg(s[half + 1:]))"
DECLINE = {"prolonged_nonprogression": f"{part_of('x >= -2')} >= 0.8 AND list_avg(s) >= -1", "linear_decline": f"{part_of('x < -2')} >= 0.8", "nonlinear": f"CASE WHEN half > 0 THEN {APART} > 3 END"}
TIMELINE = f"(SELECT *, row_number() OVER (PARTITION BY pid ORDER BY time) - 1 AS step FROM (SELECT DISTINCT pid, time FROM dyn WHERE feature_name IN {EMBED}))"
SIGMOID = "1 / (1 + exp(-eta))"

RAW = {
    "s1_parquet_scan": "SELECT event_id, user_id, value FROM events WHERE event_type = 'view'",
    "s2_csv_scan": f"SELECT patient_id, {r('time')} AS time, {r('lab_value')} AS lab_value FROM visit",
    "s3_parquet_sink": f"SELECT pid, {r('time')} AS time, value, treated FROM dyn WHERE feature_name = 'view'",
    "s4_csv_sink": "SELECT pid, bin_idx, idx FROM idxm",
    "s5_embedding_sink": f"SELECT 'V' || vec_id AS pid, 0 AS t_idx, {r('x[1]')} AS h1, {r('x[64]')} AS h64 FROM emb",
    "s6_model_save_load": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {r(str(b))}, (SELECT {r(f'avg({c})')} FROM sb))" for c, b in (("purchase", 0.02), ("Med_error", -0.3), ("age", 0.01), ("sex", 0.2), ("cci", -0.05))) + ") v(name, beta, mean)",
    "p1_feature_slice": f"SELECT pid AS patient_id, {r('time')} AS time, {r('value')} AS lab_value FROM dyn WHERE feature_name = 'view'",
    "p2_lab_wide": f"SELECT pid AS patient_id, {r('time')} AS time, max(value) FILTER (WHERE feature_name = 'view') AS view, max(value) FILTER (WHERE feature_name = 'click') AS click FROM dyn WHERE feature_name IN {EMBED} GROUP BY pid, dyn.time",
    "p3_feature_set": f"SELECT pid, {r('time')} AS time, feature_name, value, treated FROM dyn WHERE feature_name IN ('view', 'click', 'purchase', 'Med_error')",
    "p4_prefix_columns": f"SELECT patient_id, {r('time')} AS time, traj_prob_slope, traj_prob_level FROM trend WHERE lab = 'view'",
    "p5_suffix_rename": f"SELECT patient_id, {r('time')} AS time, traj_prob_slope AS traj_prob_slope__click, traj_prob_level AS traj_prob_level__click FROM trend WHERE lab = 'click'",
    "p6_binary_features": "SELECT * FROM kind",
    "p7_treated_at_start": "SELECT pid, bin_idx, treatment FROM tgrid",
    "p8_min_points": f"SELECT DISTINCT pid, feature_name, {r('time')} AS time, n FROM win WHERE n >= 6",
    "p9_null_fill": f"SELECT pid, bin_idx, {r('coalesce(view, 0.0)')} AS view, {r('coalesce(click, 0.0)')} AS click FROM ({wide_means('{}')})",
    "p10_validation": "SELECT count(DISTINCT pid) AS n_rows, 0::BIGINT AS n_bad FROM grid",
    "p12_history_mask": "SELECT pid, bin_idx, CASE WHEN idx >= 0 THEN y_event ELSE 0.0 END AS y_event, CASE WHEN idx >= 0 THEN at_risk ELSE 0.0 END AS at_risk, idx AS idx_map FROM w3 JOIN idxm USING (pid, bin_idx)",
    "p13_failed_anchors": f"SELECT pid, {r('time')} AS time, v AS view_fit_success, c AS click_fit_success FROM (SELECT pid, time, max((n >= 6)::INT::DOUBLE) FILTER (WHERE feature_name = 'view') AS v, max((n >= 6)::INT::DOUBLE) FILTER (WHERE feature_name = 'click') AS c FROM win WHERE feature_name IN {EMBED} GROUP BY ALL) WHERE v = 1 OR c = 1",
    "p14_mark_treated": f"SELECT pid, {r('time')} AS time, feature_name, coalesce(time >= t_start, false)::INT AS treated FROM dyn JOIN tst USING (pid)",
    "r1_bin_edges": "SELECT pid, i::INT AS i, i::DOUBLE AS edge FROM (SELECT pid, unnest(range(ceil(Tmax)::INT + 1)) AS i FROM sta)",
    "r2_bin_grid": "SELECT * FROM grid",
    "r3_prediction_grid": f"SELECT pid, i::INT AS i, {r('lo + i * (hi - lo) / (n - 1)')} AS t FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT pid, min(time) AS lo, max(time) AS hi, greatest(2, round((max(time) - min(time)) * 2)::INT) AS n FROM dyn GROUP BY pid))",
    "r4_union_timeline": f"SELECT pid, {r('time')} AS time FROM (SELECT DISTINCT pid, time FROM dyn WHERE feature_name IN {EMBED})",
    "r5_distinct_anchors": f"SELECT pid, feature_name, {r('time')} AS time FROM (SELECT DISTINCT pid, feature_name, time FROM dyn)",
    "j1_static_attach": "SELECT g.*, age, sex, cci, Tmax FROM grid g LEFT JOIN sta USING (pid)",
    "j2_bins_trajectory": f'SELECT a.pid, a.bin_idx, "start", "stop", treatment, {r("purchase")} AS purchase, Med_error, traj_prob_slope__view, traj_prob_level__view, traj_prob_slope__click, traj_prob_level__click FROM agg a LEFT JOIN ali USING (pid, bin_idx)',
    "j3_lab_merge": f"SELECT patient_id, {r('time')} AS time, v.traj_prob_slope AS view_slope, v.traj_prob_level AS view_level, c.traj_prob_slope AS click_slope, c.traj_prob_level AS click_level FROM (SELECT * FROM trend WHERE lab = 'view') v FULL JOIN (SELECT * FROM trend WHERE lab = 'click') c USING (patient_id, time)",
    "j4_asof_zero": "SELECT * FROM ali",
    "j5_asof_rows": """SELECT g.pid, g.bin_idx, coalesce(t.view, 0.0) AS view, coalesce(t.click, 0.0) AS click FROM grid g ASOF LEFT JOIN (
        SELECT patient_id, time, max(traj_prob_slope) FILTER (WHERE lab = 'view') AS view, max(traj_prob_slope) FILTER (WHERE lab = 'click') AS click FROM trend WHERE lab IN ('view', 'click') GROUP BY ALL) t ON g.pid = t.patient_id AND g."start" >= t.time""",
    "j6_asof_first": "SELECT g.pid, g.bin_idx, coalesce(v, 0.0) AS value FROM grid g LEFT JOIN (SELECT * FROM held WHERE feature_name = 'Med_error') h ON h.pid = g.pid AND h.bin_idx = g.bin_idx",
    "j7_point_in_bin": f'SELECT pid, feature_name, {r("time")} AS time, value, bin_idx, "start", "stop" FROM inb',
    "j8_trailing_window": f"SELECT DISTINCT pid, feature_name, {r('time')} AS time, n, {r('total')} AS total, {r('tmin')} AS first_time FROM win WHERE n >= 6",
    "j9_asof_index": "SELECT pid, bin_idx, idx FROM idxm",
    "j10_asof_timeline": seen_at(TIMELINE, f"pid, step::INT AS step, {r('at_')} AS time", "time"),
    "j11_asof_grid": seen_at("(SELECT * FROM grid)", "pid, bin_idx", '"start"'),
    "j12_cohort": f"SELECT t.patient_id, {r('t.time')} AS time, traj_prob_slope, traj_prob_level, cci AS traj_class, treated FROM (SELECT * FROM trend WHERE lab = 'view') t JOIN sta s ON s.pid = t.patient_id JOIN (SELECT pid, time, max(treated) AS treated FROM dyn GROUP BY ALL) d ON d.pid = t.patient_id AND d.time = t.time",
    "j13_label_attach": f"SELECT t.patient_id, {r('t.time')} AS time, traj_prob_slope, traj_prob_level, cci AS label FROM (SELECT * FROM trend WHERE lab = 'view' QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY time DESC) = 1) t LEFT JOIN sta s ON s.pid = t.patient_id",
    "j14_risk_set": f"SELECT {r('t')} AS event_time, count(*) AS n_risk FROM (SELECT DISTINCT t_start AS t FROM tst WHERE t_start IS NOT NULL) x JOIN sta ON 0 < t AND t <= Tmax GROUP BY 1",
    "j15_time_attach": f"""SELECT 'P' || (vec_id + 1) AS pid, 0 AS t_idx, {r('x[1]')} AS h1, "start" AS time FROM emb LEFT JOIN (SELECT * FROM grid WHERE bin_idx = 0) g ON g.pid = 'P' || (vec_id + 1)""",
    "ag1_treatment_start": f"SELECT pid, {r('t_start')} AS t_start FROM tst",
    "ag2_binned_mean": f"SELECT pid, bin_idx, feature_name, {r('v')} AS value FROM bm",
    "ag3_last_in_bin": f"SELECT pid, bin_idx, feature_name, {r('v')} AS value FROM lb",
    "ag4_bin_aggregate": f'SELECT pid, bin_idx, "start", "stop", treatment, {r("purchase")} AS purchase, Med_error FROM agg',
    "ag5_bin_last": f"""SELECT pid, bin_idx, "start", "stop", treated, {r("coalesce(p, median(p) OVER ())")} AS purchase, coalesce(m, 0.0) AS Med_error FROM (
        SELECT g.pid, g.bin_idx, g."start", g."stop", g.treatment AS treated, last_value(b.v IGNORE NULLS) OVER w AS p, last_value(l.v IGNORE NULLS) OVER w AS m FROM tgrid g
        LEFT JOIN bm b ON b.pid = g.pid AND b.bin_idx = g.bin_idx AND b.feature_name = 'purchase' LEFT JOIN lb l ON l.pid = g.pid AND l.bin_idx = g.bin_idx AND l.feature_name = 'Med_error'
        WINDOW w AS (PARTITION BY g.pid ORDER BY g.bin_idx))""",
    "ag6_median_fill": f"SELECT pid, bin_idx, {r('coalesce(view, median(view) OVER ())')} AS view, {r('coalesce(click, median(click) OVER ())')} AS click FROM {FILLED}",
    "ag7_window_standardise": f"SELECT DISTINCT pid, feature_name, {r('time')} AS time, {r('mean')} AS mean, {r('sd')} AS sd FROM win WHERE n >= 6",
    "ag8_class_frequency": "SELECT ((k + 1) % 5)::INT AS grp, " + ", ".join(f"{r(f'avg(coalesce({c}, false)::INT::DOUBLE)')} AS {n}" for n, c in DECLINE.items()) + " FROM sv GROUP BY 1",
    "ag9_brier": f"SELECT {r(f'avg(pow({SIGMOID} - treatment, 2))')} AS brier FROM sb",
    "ag10_concordance": f"""SELECT concordant::BIGINT AS concordant, tied::BIGINT AS tied, comparable, {r('(concordant + tied / 2) / comparable')} AS c_index FROM (
        SELECT sum((b.s > a.s)::INT) AS concordant, sum((b.s = a.s)::INT) AS tied, count(*) AS comparable FROM (SELECT "stop", treatment, {r('eta')} AS s FROM sb) a
        JOIN (SELECT "stop", treatment, {r('eta')} AS s FROM sb) b ON a.treatment > 0 AND (b."stop" > a."stop" OR (b."stop" = a."stop" AND b.treatment = 0)))""",
    "ag13_mean_pool": f"SELECT label, i::INT AS dim, {r('sum(x[i + 1] * w) / sum(w)')} AS pooled FROM (SELECT label, x, greatest(((x[5] > 0)::INT + (x[6] > 0)::INT + (x[7] > 0)::INT + (x[8] > 0)::INT) / 4.0::DOUBLE, 1e-6::DOUBLE) AS w, unnest(range(4)) AS i FROM emb) GROUP BY ALL",
    "ag14_binned_cox_loss": f"SELECT {r('sum(d * coalesce(lse, 0.0) - e) / greatest(sum(d), 1.0)')} AS loss FROM (SELECT bin_idx, sum(y_event) AS d, sum(y_event * eta) AS e, ln(sum(exp(eta)) FILTER (WHERE at_risk > 0)) AS lse FROM sb GROUP BY bin_idx)",
    "ag15_pooled_cox_loss": f"SELECT {r('(sum(y_event) * ln(sum(exp(eta) * (at_risk + 1e-8::DOUBLE))) - sum(y_event * eta)) / greatest(sum(y_event), 1.0)')} AS loss FROM sb",
    "ag16_hazard_loss": f"SELECT {r('sum((2 * y_event * ln(1 + exp(-eta)) + (1 - y_event) * ln(1 + exp(eta))) * at_risk) / greatest(sum(at_risk), 1.0)')} AS loss FROM sb",
    "w1_running_max": f"SELECT pid, {r('time')} AS time, high FROM (SELECT DISTINCT pid, time, max((value >= 150)::INT) OVER (PARTITION BY pid ORDER BY time) AS high FROM dyn)",
    "w2_forward_fill": f"SELECT pid, bin_idx, {r('view')} AS view, {r('click')} AS click FROM {FILLED}",
    "w3_event_targets": "SELECT * FROM w3",
    "w4_trailing_statistics": "SELECT DISTINCT pid, feature_name, " + ", ".join(f"{r(c)} AS {c}" for c in ("time", "mean", "sd", "tmin", "tmax", "slope")) + ", n FROM win WHERE n >= 6",
    "w5_riskset_softmax": f"SELECT pid, bin_idx, {r('eta')} AS eta, at_risk, {fine('CASE WHEN at_risk > 0 THEN exp(eta) / sum(exp(eta)) FILTER (WHERE at_risk > 0) OVER (PARTITION BY bin_idx) ELSE 0.0 END')} AS ps FROM sb",
    "w7_batch_padding": f"""SELECT pid, batch_id, longest::INT AS n_time, longest::INT AS n_std, longest::INT AS n_index, (unseen + longest - n_agg)::INT AS n_filled, sum_time, {r('sum_std')} AS sum_std,
        (sum_idx - (longest - n_agg))::BIGINT AS sum_index FROM (SELECT *, max(n_agg) OVER (PARTITION BY batch_id) AS longest FROM (
          SELECT g.*, i.sum_idx, i.unseen, coalesce(h.sum_std, 0.0) AS sum_std, (('0x' || substr(md5(g.pid), 1, 8))::BIGINT % ceil(count(*) OVER () / 32.0)::BIGINT)::INT AS batch_id
          FROM (SELECT pid, count(*) AS n_agg, sum("start") AS sum_time FROM grid GROUP BY pid) g
          JOIN (SELECT pid, sum(idx) AS sum_idx, count(*) FILTER (WHERE idx = -1) AS unseen FROM idxm GROUP BY pid) i USING (pid)
          LEFT JOIN (SELECT pid, sum(v) AS sum_std FROM held WHERE feature_name IN ('purchase', 'Med_error') GROUP BY pid) h USING (pid)))""",
    "p11_patient_split": "SELECT pid, ('0x' || substr(md5(pid || '|0'), 1, 8))::BIGINT % 100 < 80 AS is_train FROM sta",
    "w6_row_index": f"SELECT pid, {r('time')} AS time, (row_number() OVER (PARTITION BY pid ORDER BY time) - 1)::INT AS t_idx FROM (SELECT DISTINCT pid, time FROM dyn)",
    "w8_latest": f"SELECT pid, {r('time')} AS time, feature_name, value FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY time DESC, feature_name DESC, value DESC) AS k FROM dyn) WHERE k = 1",
    "o1_ordering": f"SELECT pid, {r('dyn.time')} AS time, value FROM dyn WHERE feature_name = 'view' ORDER BY pid, dyn.time, value",
    "o2_array_sort": f"SELECT patient_id, (row_number() OVER (PARTITION BY patient_id ORDER BY slope) - 1)::INT AS i, {r('slope')} AS slope FROM sl",
    "a1_slopes": f"SELECT patient_id, i::INT AS i, {r('slope')} AS slope FROM sl",
    "a2_decline_flags": flags(DECLINE),
    "a3_increase_flags": flags({"prolonged_nonprogression": f"{part_of('x <= 1')} >= 0.8 AND list_avg(s) <= 0.5", "linear_decline": f"{part_of('x > 1')} >= 0.8", "nonlinear": f"CASE WHEN half > 0 THEN {APART} > 2 END"}),
    "a4_four_class_flags": flags({"prolonged_nonprogression": f"{part_of('x >= -0.5')} >= 0.8 AND list_avg(s) >= -0.3", "slow_linear_decline": f"{part_of('x >= -1.5 AND x < -0.5')} >= 0.8", "fast_linear_decline": f"{part_of('x < -1.5')} >= 0.8", "nonlinear": f"CASE WHEN half > 0 THEN {APART} > 1 END"}),
    "a5_unit_time": f"SELECT DISTINCT pid, feature_name, {r('time')} AS time, {r('((tmin + time) / 2 - tmin) / greatest(tmax - tmin, 1e-12)')} AS u FROM win WHERE n >= 6",
    "a6_back_transform": f"SELECT patient_id, i::INT AS i, {r('y * 2 + avg(y) OVER (PARTITION BY patient_id)')} AS y FROM ov",
    "a7_coefficient_block": "SELECT patient_id, " + ", ".join(f"{r(f'coalesce(max(y) FILTER (WHERE i = {k}), 0.0)')} AS orders_beta_{n}" for k, n in enumerate(["intercept", "s1", "s2", "s3", "s4", "s5", "s6"])) + " FROM ov GROUP BY patient_id",
    "a9_sigmoid_hazard": f"SELECT pid, bin_idx, {r(f'{SIGMOID} * at_risk')} AS hazard FROM sb",
    "a10_linear_predictor": f"SELECT pid, bin_idx, {r('eta')} AS eta, {r('exp(eta)')} AS partial_hazard FROM sb",
    "a12_gather": f"SELECT pid, bin_idx, x0 AS h1, x1 AS h2 FROM ({seen_at('(SELECT * FROM grid)', 'pid, bin_idx', chr(34) + 'start' + chr(34))})",
    "a13_embedding_rows": "SELECT vec_id, i::INT AS t_idx, " + ", ".join(f"{r(f'x[i * 8 + {k}]')} AS h{k}" for k in range(1, 9)) + " FROM (SELECT *, unnest(range(8)) AS i FROM emb)",
    "x1_custom_classifier": flags({"mostly_rising": f"{part_of('x > 0.5')} > 0.5"}),
    "m9_interval_pass": f"""SELECT place, {r('any_value(deaths)')} AS deaths, {r('sum(exp(x0 * 0.3 + x1 * -0.2))')} AS s0, {r('sum(exp(x0 * 0.3 + x1 * -0.2) * x0)')} AS s1_0, {r('sum(exp(x0 * 0.3 + x1 * -0.2) * x1)')} AS s1_1, {r('any_value(d_s0)')} AS d_s0
        FROM ivt JOIN iv ON "start" < t AND t <= "stop" GROUP BY place""",
    "m9_cox_pass": f"SELECT bin_idx, {r('sum(treatment)')} AS deaths, {r('sum(exp(eta))')} AS s0, " + ", ".join(f"{r(f'sum(exp(eta) * {c})')} AS s1_{i}" for i, c in enumerate(("purchase", "Med_error", "age", "sex", "cci"))) + " FROM sb GROUP BY bin_idx",
    "m10_cox_score": f"SELECT pid, bin_idx, {r('exp((purchase - 50) * 0.02 + (Med_error - 0.5) * -0.3 + (age - 60) * 0.01 + (sex - 0.5) * 0.2 + (cci - 2.5) * -0.05)')} AS ps FROM sb",
    "k1_counting_process": f'SELECT a.pid, a.bin_idx, "start", "stop", treatment, {r("purchase")} AS purchase, Med_error, coalesce(traj_prob_slope__view, 0.0) AS traj_prob_slope__view, traj_prob_level__view, coalesce(traj_prob_slope__click, 0.0) AS traj_prob_slope__click, traj_prob_level__click, age, sex, cci, Tmax FROM agg a JOIN ali USING (pid, bin_idx) JOIN sta USING (pid)',
    "k2_sequence_samples": f"""SELECT g.pid, n_raw, g.n_agg, raw_sum, g.events, g.risk, g.last_idx, age::DOUBLE AS age FROM (
        SELECT w3.pid, count(*)::INT AS n_agg, sum(y_event) AS events, sum(at_risk) AS risk, max(idx) AS last_idx FROM w3 JOIN idxm USING (pid, bin_idx) GROUP BY w3.pid) g JOIN sta USING (pid)
        JOIN (SELECT pid, count(*)::INT AS n_raw, {r('sum(time)')} AS raw_sum FROM {TIMELINE} GROUP BY pid) t USING (pid)""",
    "k6_prototype_preparation": "",
    "flagship_propensity": f"""SELECT pid, bin_idx, treatment, at_risk, {r('eta')} AS eta, {fine('CASE WHEN at_risk > 0 THEN exp(eta - top) / sum(exp(eta - top)) FILTER (WHERE at_risk > 0) OVER (PARTITION BY bin_idx) ELSE 0.0 END')} AS ps FROM (
        SELECT *, max(eta) FILTER (WHERE at_risk > 0) OVER (PARTITION BY bin_idx) AS top FROM (
        SELECT sb.pid, sb.bin_idx, treatment, at_risk, purchase * 0.02 + Med_error * -0.3 + coalesce(traj_prob_slope__view, 0.0) * 0.01 + traj_prob_level__click * 0.2 + age * -0.05 AS eta FROM sb JOIN ali USING (pid, bin_idx)))""",
}
TREATED = "SELECT pid AS who, min(time) AS since FROM dyn WHERE treated = 1 AND feature_name IN ('view', 'click', 'purchase', 'Med_error') GROUP BY pid"
RAW["k6_prototype_preparation"] = f"""SELECT a.pid, a.bin_idx, coalesce(a."start" >= since, false)::INT AS treated, purchase, Med_error, x0, m1, dt FROM ({RAW['ag5_bin_last']}) a JOIN ({RAW['j11_asof_grid']}) b USING (pid, bin_idx) LEFT JOIN ({TREATED}) ON who = a.pid"""
ORACLE = {name: full(sql) for name, sql in RAW.items()}
