"""Rule evaluation, episodes, scores and triage (2.E)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..catalog import rules as R
from ..catalog import signals as S
from ..operators import alerts, episodes, triage
from ..operators.features import rolling_features
from ..operators.prescribe import attach_diagnosis, diagnose_alerts
from ..session import broadcast_if_small, literal_table, shared_folder, stored
from ..sources.alert_table import AlertTable, upsert, as_table_rows
from ..sources.rules import builtin_rules, read_rules
from . import dataset as D
from .common import query, r, sr
from .ingest import batch_issues
from .tables import all_episodes, features, hits
from .tables import numbered as staged_numbered


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def number(value) -> str:
    return "NULL::DOUBLE" if value is None else f"{value!r}::DOUBLE"


_FIXED = ", ".join(
    f"({text(rid)}, {text(s)}, {text(sub)}, {text(cond)}, {number(thr)}, {number(lo)}, {number(hi)}, {text(sev)}, {text(title)}, {text(msg)})"
    for rid, s, sub, cond, thr, lo, hi, sev, title, msg in R.FIXED_RULES)
FIXED_SQL = f"fixed_rules(rule_id, signal, subsystem, cond, thr, lo, hi, severity, title, message) AS (VALUES {_FIXED})"
_RULE_SIGNALS = sorted({row[1] for row in R.FIXED_RULES})
NORMAL = f"mode_key = '{S.NORMAL_MODE}'"

FIXED_HITS = f"""{FIXED_SQL},
rule_rows AS (SELECT * FROM (SELECT asset_id, us, row_idx, mode_key, {', '.join(_RULE_SIGNALS)} FROM numbered) UNPIVOT (value FOR signal IN ({', '.join(_RULE_SIGNALS)}))),
fixed_hits AS (
  SELECT l.asset_id, us, row_idx, mode_key, rule_id, 'fixed_rule' AS layer, subsystem, l.signal, severity, title, message, value AS current_value,
    CASE WHEN cond = 'between' THEN lo::VARCHAR || '..' || hi::VARCHAR ELSE cond || ' ' || thr::VARCHAR END AS threshold
  FROM rule_rows l JOIN fixed_rules r ON l.signal = r.signal
  WHERE {NORMAL} AND CASE cond WHEN 'gt' THEN value > thr WHEN 'between' THEN NOT (lo <= value AND value <= hi) END)"""

TREND_WANTED = {row[1]: ["ma_15m", "ma_1h", "std_1h", "ewma", "ewma_gap_abs", row[3]] if row[3] != "ewma_gap_abs"
                else ["ma_15m", "ma_1h", "std_1h", "ewma", "ewma_gap_abs"] for row in R.TREND_RULES}


def _guard_sql(s: str, feature: str) -> str:
    v, ma15, ma1, sd, ew = s, f"{s}__ma_15m", f"{s}__ma_1h", f"{s}__std_1h", f"{s}__ewma"
    fv = f"{s}__{feature}"
    if feature.startswith("slope"):
        base = f"coalesce({ma1}, {ma15})"
        aligned = (f"({ma15} IS NULL OR {ma1} IS NULL OR CASE WHEN {fv} > 0 THEN {v} >= {ma15} AND {ma15} >= {ma1} "
                   f"ELSE {v} <= {ma15} AND {ma15} <= {ma1} END)")
        return f"{base} IS NOT NULL AND {aligned} AND abs({v} - {base}) >= greatest(abs({base}) * 0.02e0, 0.05e0, coalesce({sd}, 0))"
    if feature == "zscore_1h":
        return (f"{sd} >= greatest(abs({ma1}) * 0.005e0, 0.01e0) AND "
                f"abs({v} - {ma1}) >= greatest({sd} * 1.2e0, abs({ma1}) * 0.02e0, 0.05e0)")
    base = f"coalesce({ew}, {ma1})"
    return f"abs({v} - {base}) >= greatest(abs({base}) * 0.03e0, 0.1e0, coalesce({sd}, 0))"


def _trend_select(row) -> str:
    rid, s, sub, feature, cond, thr, sev, title, msg = row
    reason = (f"CASE WHEN {s}__{feature} > 0 THEN '{R.REASON_RISING}' ELSE '{R.REASON_FALLING}' END" if feature.startswith("slope")
              else f"'{R.REASON_OUTLIER}'" if feature == "zscore_1h" else f"'{R.REASON_DRIFT}'")
    return (f"SELECT asset_id, us, row_idx, mode_key, {text(rid)} AS rule_id, 'trend' AS layer, {text(sub)} AS subsystem, {text(s)} AS signal, "
            f"{text(sev)} AS severity, {text(title)} AS title, {text(msg)} AS message, {s} AS current_value, '{cond} ' || ({thr!r}::DOUBLE)::VARCHAR AS threshold, "
            f"{s}__{feature} AS feature_value, {reason} AS reason "
            f"FROM features WHERE {NORMAL} AND {s} IS NOT NULL AND {s}__{feature} > {thr!r} AND {_guard_sql(s, feature)}")


TREND_HITS = "trend_all AS (" + " UNION ALL ".join(_trend_select(row) for row in R.TREND_RULES) + """),
trend_hits AS (SELECT asset_id, us, row_idx, mode_key, rule_id, layer, subsystem, signal, severity, title, message, current_value, threshold FROM trend_all)"""

_SUBSYSTEM_CASE = "CASE signal " + " ".join(f"WHEN '{s}' THEN '{S.SUBSYSTEM_OF[s]}'" for s in S.STUCK_CANDIDATES) + " END"


def _unpivot(signals, source: str = "numbered") -> str:
    return (f"SELECT * FROM (SELECT asset_id, us, row_idx, mode_key, {', '.join(f'{s}::DOUBLE AS {s}' for s in signals)} FROM {source}) "
            f"UNPIVOT INCLUDE NULLS (value FOR signal IN ({', '.join(signals)}))")


STUCK_HITS = f"""stuck_rows AS ({_unpivot(S.STUCK_CANDIDATES)}),
stuck_steps AS (SELECT *, us - lag(us) OVER (PARTITION BY asset_id, signal ORDER BY row_idx) AS step FROM stuck_rows WHERE value IS NOT NULL),
stuck_obs AS (
  SELECT asset_id, signal, row_idx, value, count(*) OVER w AS n, max(value) OVER w - min(value) OVER w AS rng, stddev_pop(value) OVER w AS sd,
    min(row_idx) OVER w AS first_row, max(us) OVER w - min(us) OVER w AS span,
    median(step) OVER (PARTITION BY asset_id, signal ORDER BY row_idx ROWS BETWEEN 43 PRECEDING AND CURRENT ROW) AS med
  FROM stuck_steps WINDOW w AS (PARTITION BY asset_id, signal ORDER BY row_idx ROWS BETWEEN 44 PRECEDING AND CURRENT ROW)),
stuck_found AS (
  SELECT r.asset_id, r.us, r.row_idx, r.mode_key, r.signal, o.value AS repeated, o.n, o.rng, o.sd, (span + med) / 6e7 AS minutes
  FROM stuck_rows r ASOF JOIN stuck_obs o ON r.asset_id = o.asset_id AND r.signal = o.signal AND r.row_idx >= o.row_idx
  WHERE o.n >= 45 AND o.first_row >= r.row_idx - 180 AND (span + med) / 6e7 >= 45 AND rng <= greatest(abs(o.value) * 0.001e0, 0.01e0)
    AND sd <= greatest(abs(o.value) * 0.001e0, 0.01e0) / 2e0),
stuck_hits AS (
  SELECT asset_id, us, row_idx, mode_key, 'sensor_stuck::' || signal AS rule_id, 'operational_anomaly' AS layer, {_SUBSYSTEM_CASE} AS subsystem, signal,
    'low' AS severity, '{R.STUCK_TITLE}' || signal AS title, '{R.STUCK_MESSAGE}' AS message, repeated AS current_value, '{R.STUCK_THRESHOLD}' AS threshold
  FROM stuck_found)"""

_ZERO_RULE, _HINT_RULE = R.ANOMALY_RULES
_ZERO_SIGNAL, _HINT_SIGNAL = _ZERO_RULE[1], _HINT_RULE[1]


def zero_found_sql(signals) -> str:
    return f"""zero_rows AS ({_unpivot(signals)}),
zero_obs AS (SELECT *, list({{'i': row_idx, 'v': value}}) OVER (PARTITION BY asset_id, signal ORDER BY row_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent
  FROM zero_rows WHERE value IS NOT NULL),
zero_near AS (
  SELECT r.asset_id, r.us, r.row_idx, r.mode_key, r.signal, r.value, list_filter(o.recent, lambda x: x.i >= r.row_idx - 180) AS recent
  FROM zero_rows r ASOF JOIN zero_obs o ON r.asset_id = o.asset_id AND r.signal = o.signal AND r.row_idx >= o.row_idx),
zero_found AS (SELECT * FROM zero_near WHERE len(recent) >= 3 AND len(list_filter(recent, lambda x: x.v <> 0)) = 0)"""


ANOMALY_HITS = f"""{zero_found_sql([_ZERO_SIGNAL])},
anomaly_hits AS (
  SELECT asset_id, us, row_idx, mode_key, '{_ZERO_RULE[0]}' AS rule_id, 'operational_anomaly' AS layer, '{_ZERO_RULE[2]}' AS subsystem, signal,
    '{_ZERO_RULE[4]}' AS severity, '{_ZERO_RULE[5]}' AS title, '{_ZERO_RULE[6]}' AS message, value AS current_value, 'zero_abnormal' AS threshold FROM zero_found
  UNION ALL
  SELECT asset_id, us, row_idx, mode_key, '{_HINT_RULE[0]}', 'operational_anomaly', '{_HINT_RULE[2]}', '{_HINT_SIGNAL}', '{_HINT_RULE[4]}',
    '{_HINT_RULE[5]}', '{_HINT_RULE[6]} {S.CALIBRATION_HINTS[_HINT_SIGNAL]}', {_HINT_SIGNAL}, 'engineering_hint'
  FROM numbered WHERE {_HINT_SIGNAL} < 8e0 OR {_HINT_SIGNAL} > 12e0)"""

HITS = f"""{D.features_sql(TREND_WANTED)}, {FIXED_HITS}, {TREND_HITS}, {STUCK_HITS}, {ANOMALY_HITS},
hits AS (SELECT *, sha1(rule_id || '|' || subsystem || '|' || coalesce(signal, '') || '|' || layer) AS alert_id FROM (
  SELECT * FROM fixed_hits UNION ALL SELECT * FROM trend_hits UNION ALL SELECT * FROM stuck_hits UNION ALL SELECT * FROM anomaly_hits))"""

WEIGHT = "CASE severity WHEN 'low' THEN 20 WHEN 'medium' THEN 45 WHEN 'high' THEN 75 WHEN 'critical' THEN 95 ELSE 0 END"

EPISODES = f"""{HITS},
islands AS (SELECT *, row_idx - row_number() OVER (PARTITION BY asset_id, alert_id ORDER BY row_idx) AS island FROM hits),
newest AS (SELECT asset_id, max(us) AS newest FROM readings GROUP BY 1),
episodes AS (
  SELECT i.asset_id, alert_id, any_value(rule_id) AS rule_id, any_value(layer) AS layer, any_value(subsystem) AS subsystem, any_value(signal) AS signal,
    arg_min(severity, row_idx) AS severity, arg_min(title, row_idx) AS title, arg_min(message, row_idx) AS message,
    arg_max({{'v': current_value}}, row_idx).v AS current_value, arg_max(threshold, row_idx) AS threshold, arg_max(mode_key, row_idx) AS mode_key,
    min(us) AS triggered_us, max(us) AS last_seen_us, min(row_idx) AS first_row, max(row_idx) AS last_row, count(*) AS readings,
    max(us) = any_value(newest) AS is_active
  FROM islands i JOIN newest n ON i.asset_id = n.asset_id GROUP BY i.asset_id, alert_id, island)"""


_HIT = ["asset_id", "us", "row_idx", "mode_key", "alert_id", "rule_id", "layer", "subsystem", "signal", "severity", "title", "message", "threshold"]
_HIT_SQL = ", ".join(_HIT)


@query("e1_fixed_rule_hits", f"""
WITH {D.SEGMENTS_SQL}, {FIXED_HITS}
SELECT {_HIT_SQL.replace('alert_id', "sha1(rule_id || '|' || subsystem || '|' || signal || '|' || layer) AS alert_id")}, {sr('current_value', 'current_value')}
FROM fixed_hits""")
def fixed_rule_hits(spark, sf):
    return alerts.fixed_rule_hits(D.numbered(spark, sf), builtin_rules(spark)).select(*_HIT, r("current_value"))


@query("e2_e3_conditions_and_mode_gate", f"""
WITH {D.SEGMENTS_SQL},
c(cond, thr, lo, hi, modes) AS (VALUES ('gt', 150e0, NULL::DOUBLE, NULL::DOUBLE, ''), ('gte', 181e0, NULL, NULL, 'n'), ('lt', 110e0, NULL, NULL, 'n'),
  ('lte', 120e0, NULL, NULL, ''), ('between', NULL, 120e0, 150e0, 'n'))
SELECT cond, asset_id, count(*) AS fired FROM numbered, c
WHERE (modes = '' OR {NORMAL}) AND CASE cond WHEN 'gt' THEN pv_corr_motor_a > thr WHEN 'gte' THEN pv_corr_motor_a >= thr WHEN 'lt' THEN pv_corr_motor_a < thr
  WHEN 'lte' THEN pv_corr_motor_a <= thr ELSE pv_corr_motor_a < lo OR pv_corr_motor_a > hi END GROUP BY 1, 2""")
def conditions_and_gate(spark, sf):
    common = {"signal": "pv_corr_motor_a", "subsystem": "motor", "severity": "low", "title": "t", "message": "m"}
    rows = [
        {"rule_id": "gt", "condition": "gt", "threshold": 150.0, "allowed_modes": []},
        {"rule_id": "gte", "condition": "gte", "threshold": 181.0, "allowed_modes": [S.NORMAL_MODE]},
        {"rule_id": "lt", "condition": "lt", "threshold": 110.0, "allowed_modes": [S.NORMAL_MODE]},
        {"rule_id": "lte", "condition": "lte", "threshold": 120.0},
        {"rule_id": "between", "condition": "between", "min_value": 120.0, "max_value": 150.0, "allowed_modes": [S.NORMAL_MODE]},
    ]
    rules = literal_table(spark, R.RULE_SCHEMA, [common | row for row in rows]).withColumn("layer", F.lit("fixed_rule"))
    fired = alerts.fixed_rule_hits(D.numbered(spark, sf), rules)
    return fired.groupBy(F.col("rule_id").alias("cond"), "asset_id").agg(F.count(F.lit(1)).alias("fired"))


@query("a10_rules_from_json", f"""
WITH {D.SEGMENTS_SQL}, {FIXED_HITS}
SELECT rule_id, signal, severity, count(*) AS fired, count(DISTINCT asset_id) AS assets FROM fixed_hits GROUP BY 1, 2, 3""")
def rules_from_json(spark, sf):
    path = shared_folder(spark)
    document = literal_table(spark, "body string", [{"body": json.dumps(R.rule_documents(), indent=1)}])
    document.coalesce(1).write.text(path)
    found = alerts.fixed_rule_hits(D.numbered(spark, sf), read_rules(spark, path))
    return found.groupBy("rule_id", "signal", "severity").agg(F.count(F.lit(1)).alias("fired"), F.countDistinct("asset_id").alias("assets"))


@query("e5_trend_rule_hits", f"""
WITH {D.features_sql(TREND_WANTED)}, {TREND_HITS}
SELECT asset_id, us, rule_id, signal, threshold, {sr('current_value', 'current_value')}, {sr('feature_value', 'feature_value')}, reason FROM trend_all""")
def trend_rule_hits(spark, sf):
    featured = rolling_features(D.readings(spark, sf), alerts.trend_feature_plan(), D.WIDTHS)
    found = alerts.trend_rule_hits(featured, builtin_rules(spark))
    return found.select("asset_id", "us", "rule_id", "signal", "threshold", r("current_value"),
                        r(F.col("metadata")["feature_value"].cast("double"), 4, "feature_value"), F.col("metadata")["analysis_reason"].alias("reason"))


def _guard_counts(name, signal, feature, spark_guard):
    wanted = {signal: ["ma_15m", "ma_1h", "std_1h", "ewma", "ewma_gap_abs"] + ([] if feature == "ewma_gap_abs" else [feature])}
    sql = f"""
WITH {D.features_sql(wanted)}
SELECT asset_id, us, CASE WHEN coalesce({_guard_sql(signal, feature)}, false) THEN 1 ELSE 0 END AS passes FROM features
WHERE {signal} IS NOT NULL AND {signal}__{feature} IS NOT NULL"""

    @query(name, sql)
    def run(spark, sf):
        rows = rolling_features(D.readings(spark, sf), wanted, D.WIDTHS)
        col = lambda n: F.col(f"{signal}__{n}")
        rows = rows.where(F.col(signal).isNotNull() & col(feature).isNotNull())
        return rows.select("asset_id", "us", spark_guard(F.col(signal), col).cast("int").alias("passes"))


_guard_counts("e6_slope_guardrail", "pv_temp_oleo_lubrificacao_c", "slope_15m",
              lambda v, c: alerts.slope_guard(v, c("slope_15m"), c("ma_15m"), c("ma_1h"), c("std_1h")))
_guard_counts("e7_zscore_guardrail", "pv_vib_max_mils", "zscore_1h", lambda v, c: alerts.zscore_guard(v, c("ma_1h"), c("std_1h")))
_guard_counts("e8_weighted_average_guardrail", "pv_pres_descarga_bar", "ewma_gap_abs",
              lambda v, c: alerts.ewma_guard(v, c("ewma"), c("ma_1h"), c("std_1h")))


@query("e10_rolling_stuck_sensor", f"""
WITH {D.SEGMENTS_SQL}, {STUCK_HITS}
SELECT asset_id, us, signal, {sr('repeated', 'repeated_value')}, n AS window_points, {sr('minutes', 'window_minutes', 1)},
  {sr('rng', 'observed_range', 6)}, {sr('sd', 'observed_std', 6)} FROM stuck_found""")
def rolling_stuck(spark, sf):
    return alerts.rolling_stuck(D.numbered(spark, sf)).select(
        "asset_id", "us", "signal", r("repeated_value"), "window_points", r("window_minutes", 1), r("observed_range", 6), r("observed_std", 6))


@query("e11_rolling_recurrent_zero", f"""
WITH {D.SEGMENTS_SQL}, {zero_found_sql(S.ZERO_ABNORMAL)}
SELECT asset_id, us, signal, len(recent) AS window_points FROM zero_found""")
def rolling_zero(spark, sf):
    return alerts.rolling_zeros(D.numbered(spark, sf)).select("asset_id", "us", "signal", "window_points")


@query("e12_engineering_inconsistency", f"""
WITH {D.SEGMENTS_SQL}, {ANOMALY_HITS}
SELECT asset_id, us, rule_id, mode_key, message, {sr('current_value', 'current_value')} FROM anomaly_hits WHERE threshold = 'engineering_hint'""")
def engineering(spark, sf):
    found = alerts.anomaly_hits(D.numbered(spark, sf), builtin_rules(spark)).where(F.col("threshold") == "engineering_hint")
    return found.select("asset_id", "us", "rule_id", "mode_key", "message", r("current_value"))


@query("e13_quality_issue_alerts", f"""
WITH {HITS}, latest AS (SELECT asset_id, max(us) AS us FROM readings GROUP BY 1)
SELECT h.asset_id, h.us, h.alert_id, h.rule_id, h.signal, h.severity FROM hits h JOIN latest l ON h.asset_id = l.asset_id AND h.us = l.us
WHERE h.layer = 'operational_anomaly' AND h.threshold <> 'engineering_hint'""")
def quality_issue_alerts(spark, sf):
    numbered = D.numbered(spark, sf)
    nothing = alerts.fixed_rule_hits(numbered, builtin_rules(spark)).where(F.lit(False))
    issues = batch_issues(spark, sf).where(F.col("issue_type").isin("sensor_stuck", "zero_abnormal"))
    found = alerts.issue_hits(numbered, issues, builtin_rules(spark), nothing)
    return found.select("asset_id", "us", "alert_id", "rule_id", "signal", "severity")


@query("e13_issues_not_raised_by_the_reading", f"""
WITH {HITS}, latest AS (SELECT asset_id, max(us) AS us FROM readings GROUP BY 1)
SELECT h.asset_id, h.us, h.alert_id, h.rule_id, h.signal, h.severity FROM hits h JOIN latest l ON h.asset_id = l.asset_id AND h.us = l.us
WHERE h.layer = 'operational_anomaly' AND h.threshold <> 'engineering_hint' AND (h.rule_id LIKE 'sensor_stuck::%') <> (h.asset_id % 2 = 0)""")
def issues_not_raised(spark, sf):
    """Stuck hits of the even assets' readings and zero hits of the others' have raised their issues; these are not raised again."""
    numbered = D.numbered(spark, sf)
    even = F.pmod("asset_id", F.lit(2)) == 0
    raised = alerts.stuck_hits(numbered).where(even).unionByName(alerts.anomaly_hits(numbered, builtin_rules(spark)).where(~even))
    issues = batch_issues(spark, sf).where(F.col("issue_type").isin("sensor_stuck", "zero_abnormal"))
    found = alerts.issue_hits(numbered, issues, builtin_rules(spark), raised)
    return found.select("asset_id", "us", "alert_id", "rule_id", "signal", "severity")


@query("e14_e15_alert_identity", f"""
WITH {HITS}
SELECT alert_id, rule_id, layer, subsystem, signal, count(DISTINCT asset_id || ':' || row_idx) AS readings FROM hits GROUP BY 1, 2, 3, 4, 5""")
def alert_identity(spark, sf):
    found = hits(spark, sf)
    doubled = alerts.unique_hits(found.unionByName(found))
    return doubled.groupBy("alert_id", "rule_id", "layer", "subsystem", "signal").agg(F.count(F.lit(1)).alias("readings"))


_EPISODE = ["asset_id", "alert_id", "rule_id", "layer", "subsystem", "signal", "severity", "title", "message", "threshold", "mode_key",
            "triggered_us", "last_seen_us", "first_row", "last_row", "readings"]


@query("e16_alert_episodes", f"WITH {EPISODES} SELECT {', '.join(_EPISODE)}, {sr('current_value', 'current_value')} FROM episodes")
def alert_episodes(spark, sf):
    return episodes.build_episodes(hits(spark, sf)).select(*_EPISODE, r("current_value"))


@query("e17_active_alerts", f"WITH {EPISODES} SELECT {', '.join(_EPISODE)}, {sr('current_value', 'current_value')} FROM episodes WHERE is_active")
def active_alerts(spark, sf):
    return episodes.active_alerts(all_episodes(spark, sf)).select(*_EPISODE, r("current_value"))


@query("e18_event_history_order", f"""
WITH {EPISODES}
SELECT asset_id, alert_id, last_seen_us, severity, row_number() OVER (PARTITION BY asset_id ORDER BY last_seen_us DESC, {WEIGHT} DESC, alert_id, triggered_us DESC) AS place
FROM episodes""")
def event_history(spark, sf):
    return episodes.placed_events(all_episodes(spark, sf)).select("asset_id", "alert_id", "last_seen_us", "severity", "place")


SCORES = f"""{EPISODES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id, subsystem ORDER BY last_seen_us DESC, {WEIGHT} DESC, alert_id) AS place FROM episodes WHERE is_active),
scores AS (SELECT asset_id, subsystem, round(least(100e0, max({WEIGHT}) + 8e0 * (count(*) - 1)), 1) + 0e0 AS score, count(*) AS active_alerts,
  arg_max(severity, {WEIGHT}) AS highest_severity, string_agg(title, ' / ' ORDER BY place) FILTER (WHERE place <= 3) AS rationale FROM ranked GROUP BY 1, 2)"""


@query("e19_risk_scores", f"WITH {SCORES} SELECT * FROM scores")
def risk_scores(spark, sf):
    scores = episodes.risk_scores(all_episodes(spark, sf).where("is_active"))
    return scores.select("asset_id", "subsystem", r("score", 1), "active_alerts", "highest_severity", F.array_join("rationale", " / ").alias("rationale"))


_SUBSYSTEMS = ", ".join(f"('{s}')" for s in S.SUBSYSTEMS)


@query("e20_zero_filled_scores", f"""
WITH {SCORES}, sub(subsystem) AS (VALUES {_SUBSYSTEMS}), a AS (SELECT DISTINCT asset_id FROM readings)
SELECT a.asset_id, sub.subsystem, coalesce(score, 0e0) AS score, coalesce(active_alerts, 0) AS active_alerts, coalesce(highest_severity, '') AS highest_severity
FROM a CROSS JOIN sub LEFT JOIN scores s ON s.asset_id = a.asset_id AND s.subsystem = sub.subsystem""")
def zero_filled_scores(spark, sf):
    scores = episodes.risk_scores(all_episodes(spark, sf).where("is_active"))
    full = episodes.complete_scores(scores, D.readings(spark, sf))
    return full.select("asset_id", "subsystem", r("score", 1), "active_alerts", F.coalesce("highest_severity", F.lit("")).alias("highest_severity"))


@query("e21_subsystem_lookup", f"""
WITH {D.READINGS_SQL},
n AS (SELECT * FROM (SELECT pv_corr_motor_a, pv_vib_max_mils, pv_pres_oleo_bar, g_extra FROM (SELECT *, eid::DOUBLE AS g_extra FROM readings))
  UNPIVOT (value FOR signal IN (pv_corr_motor_a, pv_vib_max_mils, pv_pres_oleo_bar, g_extra)))
SELECT signal, CASE signal WHEN 'pv_corr_motor_a' THEN 'motor' WHEN 'pv_vib_max_mils' THEN 'vibracao' WHEN 'pv_pres_oleo_bar' THEN 'lubrificacao'
  ELSE 'operacao' END AS subsystem, count(*) AS n FROM n GROUP BY 1, 2""")
def subsystem_lookup(spark, sf):
    from ..functions.columns import long_rows

    rows = D.readings(spark, sf).withColumn("g_extra", F.col("eid").cast("double"))
    long = rows.select(long_rows(["pv_corr_motor_a", "pv_vib_max_mils", "pv_pres_oleo_bar", "g_extra"])).where(F.col("value").isNotNull())
    return alerts.infer_subsystem(long).groupBy("signal", "subsystem").agg(F.count(F.lit(1)).alias("n"))


_LIST = "asset_id, alert_id, severity, last_seen_us, triggered_us"


@query("e22_recent_alerts", f"""
WITH {EPISODES} SELECT {_LIST} FROM episodes WHERE subsystem = 'lubrificacao' AND severity = 'medium'
ORDER BY last_seen_us DESC, asset_id, alert_id, triggered_us DESC LIMIT 200""")
def recent_alerts(spark, sf):
    return triage.recent_alerts(all_episodes(spark, sf), 200, "lubrificacao", "medium").select(*_LIST.split(", "))


@query("e23_triage_active", f"""
WITH {EPISODES} SELECT {_LIST} FROM episodes WHERE is_active
AND contains(lower(title || ' ' || message || ' ' || rule_id || ' ' || subsystem || ' ' || signal), 'sensor')""")
def triage_active(spark, sf):
    return triage.triage_active(all_episodes(spark, sf), text="Sensor").select(*_LIST.split(", "))


@query("e23_triage_recent", f"""
WITH {EPISODES} SELECT {_LIST} FROM episodes WHERE NOT is_active AND layer = 'fixed_rule' AND severity = 'high' AND subsystem = 'lubrificacao'""")
def triage_recent(spark, sf):
    return triage.triage_recent(all_episodes(spark, sf), layer="fixed_rule", severity="high", subsystem="lubrificacao").select(*_LIST.split(", "))


CANDIDATES = f"""{EPISODES},
eligible AS (SELECT *, ({WEIGHT}) AS w FROM episodes WHERE layer IN ('fixed_rule', 'trend') OR (layer = 'operational_anomaly' AND rule_id NOT LIKE 'sensor_stuck::%')),
single AS (SELECT * FROM eligible QUALIFY row_number() OVER (PARTITION BY asset_id, alert_id ORDER BY is_active DESC, w DESC, last_seen_us DESC) = 1),
candidates AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY is_active DESC, w DESC, last_seen_us DESC, alert_id) AS place FROM single QUALIFY place <= 8)"""


@query("e24_explanation_candidates", f"WITH {CANDIDATES} SELECT {_LIST}, place FROM candidates")
def explanation_candidates(spark, sf):
    return triage.explanation_candidates(all_episodes(spark, sf)).select(*_LIST.split(", "), F.col("place").cast("bigint").alias("place"))


@query("e25_asof_snapshot", f"""
WITH {CANDIDATES}, shown AS (SELECT * FROM readings WHERE pv_pres_sistema_bar IS NOT NULL)
SELECT c.asset_id, c.alert_id, c.last_seen_us, s.us AS snap_us, {sr('s.pv_pres_sistema_bar', 'snap_pv_pres_sistema_bar')}, s.mode_key AS snap_mode_key
FROM candidates c ASOF LEFT JOIN shown s ON c.asset_id = s.asset_id AND c.last_seen_us >= s.us""")
def asof_snapshot(spark, sf):
    candidates = triage.explanation_candidates(all_episodes(spark, sf))
    shown = D.readings(spark, sf).where(F.col("pv_pres_sistema_bar").isNotNull())
    found = triage.attach_snapshot(candidates, shown, ["pv_pres_sistema_bar", "mode_key"])
    return found.select("asset_id", "alert_id", "last_seen_us", "snap_us", r("snap_pv_pres_sistema_bar"), "snap_mode_key")


_KEY_SQL = """alert_id || '|' || rule_id || '|' || layer || '|' || signal || '|' || severity || '|' ||
  regexp_replace(strftime(make_timestamp(triggered_us), '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"""


@query("e26_evidence_documents", f"""
WITH {CANDIDATES}
SELECT c.asset_id, {_KEY_SQL} AS insight_key, {sr('r.pv_pres_sistema_bar', 'p')}, {sr('r.pv_corr_motor_a', 'a')}, r.mode_key AS m, c.rule_id AS rule
FROM candidates c JOIN readings r ON r.asset_id = c.asset_id AND r.us = c.last_seen_us""")
def evidence_documents(spark, sf):
    candidates = triage.explanation_candidates(all_episodes(spark, sf))
    requests = triage.explanation_requests(candidates, D.readings(spark, sf))
    snap = F.from_json("snapshot", "pv_pres_sistema_bar double, pv_corr_motor_a double, mode_key string")
    evidence = F.from_json("evidence", "rule_id string")
    return requests.select("asset_id", "insight_key", r(snap["pv_pres_sistema_bar"], 4, "p"), r(snap["pv_corr_motor_a"], 4, "a"),
                           snap["mode_key"].alias("m"), evidence["rule_id"].alias("rule"))


def _known_insights(candidates):
    """Insights already held: those of the even ranks, as a cache table would have them."""
    return candidates.where(F.pmod("place", F.lit(2)) == 0).select("asset_id", triage.insight_key().alias("insight_key"))


@query("e27_new_explanations_only", f"WITH {CANDIDATES} SELECT asset_id, {_KEY_SQL} AS insight_key FROM candidates WHERE place % 2 = 1")
def new_explanations(spark, sf):
    candidates = stored(triage.explanation_candidates(all_episodes(spark, sf)))
    return triage.explanation_requests(candidates, D.readings(spark, sf), _known_insights(candidates)).select("asset_id", "insight_key")


@query("e28_explanation_coverage", f"""
WITH {CANDIDATES},
newest50 AS (SELECT * FROM episodes QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY last_seen_us DESC, {WEIGHT} DESC, alert_id, triggered_us DESC) <= 50),
pool AS (SELECT * FROM episodes WHERE is_active UNION ALL SELECT * FROM newest50),
uniq AS (SELECT *, {_KEY_SQL} AS k FROM pool QUALIFY row_number() OVER (PARTITION BY asset_id, alert_id ORDER BY last_seen_us, triggered_us) = 1),
known AS (SELECT DISTINCT asset_id, {_KEY_SQL} AS k FROM candidates WHERE place % 2 = 0)
SELECT u.asset_id, count(*) AS alerts, count(*) FILTER (WHERE layer IN ('fixed_rule', 'trend') OR (layer = 'operational_anomaly' AND rule_id NOT LIKE 'sensor_stuck::%')) AS eligible_alerts,
  count(n.k) AS alerts_with_insight FROM uniq u LEFT JOIN known n ON u.asset_id = n.asset_id AND u.k = n.k GROUP BY 1""")
def explanation_coverage(spark, sf):
    history = all_episodes(spark, sf)
    return triage.explanation_coverage(history, _known_insights(triage.explanation_candidates(history)))


@query("e29_operational_guidance", f"""
WITH {EPISODES}, a AS (SELECT DISTINCT asset_id FROM readings UNION ALL SELECT 9),
top AS (SELECT * FROM episodes WHERE is_active QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY {WEIGHT} DESC, last_seen_us DESC, alert_id DESC) = 1),
words AS (SELECT asset_id, bool_or(regexp_matches(lower(title || ' ' || message || ' ' || rule_id), 'sensor|instrument|escala|zerad')) AS odd FROM episodes WHERE is_active GROUP BY 1)
SELECT a.asset_id, coalesce(severity, 'ok') AS level, CASE WHEN severity IS NULL THEN '{triage.QUIET_TITLE}' ELSE 'Direcionamento operacional: ' || subsystem END AS title,
  CASE WHEN severity IS NULL THEN '{triage.QUIET_FOCUS}' WHEN odd THEN '{triage.INSTRUMENT_FOCUS}' ELSE 'Focar primeiro em ' || subsystem END AS focus
FROM a LEFT JOIN top t ON a.asset_id = t.asset_id LEFT JOIN words w ON a.asset_id = w.asset_id""")
def operational_guidance(spark, sf):
    history = all_episodes(spark, sf)
    assets = D.readings(spark, sf).select("asset_id").unionByName(spark.range(9, 10).toDF("asset_id"))
    return triage.operational_guidance(history, episodes.risk_scores(history.where("is_active")), assets).select("asset_id", "level", "title", "focus")


@query("e30_signal_events", f"""
WITH {EPISODES}, s AS (SELECT * FROM episodes WHERE signal = 'pv_pres_vacuo_cx_engran_inh2o'),
recent AS (SELECT * FROM s ORDER BY last_seen_us DESC, {WEIGHT} DESC, asset_id, alert_id, triggered_us DESC LIMIT 200)
SELECT DISTINCT asset_id, alert_id, last_seen_us FROM (SELECT * FROM s WHERE is_active UNION ALL SELECT * FROM recent)""")
def signal_events(spark, sf):
    return triage.signal_events(all_episodes(spark, sf), "pv_pres_vacuo_cx_engran_inh2o").select("asset_id", "alert_id", "last_seen_us")


@query("e31_diagnosis_pick", f"""
WITH {EPISODES}, supported AS (SELECT * FROM episodes WHERE signal IN ('pv_pres_vacuo_cx_engran_inh2o', 'pv_pres_oleo_bar', 'pv_temp_oleo_lubrificacao_c', 'pv_pres_oleo_antes_filtro_bar')),
p AS (SELECT *, CASE WHEN signal = 'pv_temp_oleo_lubrificacao_c' AND is_active THEN 0 WHEN signal = 'pv_temp_oleo_lubrificacao_c' THEN 1
  WHEN subsystem = 'lubrificacao' AND is_active THEN 2 WHEN subsystem = 'lubrificacao' THEN 3 END AS priority FROM supported)
SELECT asset_id, alert_id, signal, last_seen_us FROM p WHERE priority IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY priority, CASE WHEN is_active THEN -({WEIGHT}) ELSE 0 END, last_seen_us DESC, alert_id) = 1""")
def diagnosis_pick(spark, sf):
    history = all_episodes(spark, sf)
    diagnosed = attach_diagnosis(history, diagnose_alerts(history, features(spark, sf)))
    return triage.diagnosed_alert(diagnosed, "pv_temp_oleo_lubrificacao_c", "lubrificacao").select("asset_id", "alert_id", "signal", "last_seen_us")


def _as_of_day(spark, sf, day):
    """Active alerts as they stood when the given day ended."""
    numbered = staged_numbered(spark, sf).where(F.col("day") <= day)
    limited = numbered.groupBy("asset_id").agg(F.max("us").alias("_end"))
    plain = (F.col("layer") == "fixed_rule") | ((F.col("layer") == "operational_anomaly") & ~F.col("rule_id").startswith("sensor_stuck::"))
    found = hits(spark, sf).where(plain).join(broadcast_if_small(limited), "asset_id").where(F.col("us") <= F.col("_end")).drop("_end")
    return episodes.mark_active(episodes.build_episodes(found), numbered).where("is_active")


def _active_sql(day: int, name: str) -> str:
    return f"""{name}_n AS (SELECT * FROM numbered WHERE day <= {day}),
{name}_h AS (SELECT h.* FROM hits h JOIN {name}_n n ON h.asset_id = n.asset_id AND h.us = n.us WHERE layer = 'fixed_rule' OR (layer = 'operational_anomaly' AND rule_id NOT LIKE 'sensor_stuck::%')),
{name}_i AS (SELECT *, row_idx - row_number() OVER (PARTITION BY asset_id, alert_id ORDER BY row_idx) AS island FROM {name}_h),
{name}_l AS (SELECT asset_id, max(us) AS newest FROM {name}_n GROUP BY 1),
{name} AS (SELECT i.asset_id, alert_id, any_value(rule_id) AS rule_id, arg_max(current_value, row_idx) AS v, min(us) AS triggered_us, max(us) AS last_seen_us
  FROM {name}_i i JOIN {name}_l l ON i.asset_id = l.asset_id GROUP BY i.asset_id, alert_id, island HAVING max(us) = any_value(newest))"""


UPSERT_SQL = f"""WITH {HITS}, {_active_sql(19737, 'old_alerts')}, {_active_sql(19752, 'new_alerts')},
merged AS (SELECT coalesce(n.asset_id, o.asset_id) AS asset_id, coalesce(n.alert_id, o.alert_id) AS alert_id, coalesce(o.rule_id, n.rule_id) AS rule_id,
  coalesce(o.triggered_us, n.triggered_us) AS triggered_us, coalesce(n.last_seen_us, o.last_seen_us) AS last_seen_us,
  round(coalesce(n.v, o.v), 4) + 0e0 AS v, CASE WHEN n.alert_id IS NULL THEN 0 ELSE 1 END AS active
  FROM old_alerts o FULL OUTER JOIN new_alerts n ON o.asset_id = n.asset_id AND o.alert_id = n.alert_id)"""


def _table_view(rows):
    return rows.select("asset_id", "alert_id", "rule_id", "triggered_us", "last_seen_us", r(F.col("current_value").cast("double"), 4, "v"),
                       F.col("is_active").cast("int").alias("active"))


@query("a7_alert_upsert", f"{UPSERT_SQL} SELECT * FROM merged")
def alert_upsert(spark, sf):
    old, new = (as_table_rows(_as_of_day(spark, sf, day)) for day in (19737, 19752))
    return _table_view(upsert(old, new))


@query("a8_alert_table_read", f"{UPSERT_SQL} SELECT * FROM merged WHERE active = 1")
def alert_table_read(spark, sf):
    table = AlertTable(spark, shared_folder(spark))
    for batch, day in enumerate((19737, 19752)):
        table.replace_active(_as_of_day(spark, sf, day), batch)
    return _table_view(table.list_alerts())
