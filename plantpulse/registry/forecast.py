"""Forecast layer (2.F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import rules as R
from ..catalog import signals as S
from ..operators import episodes, forecast
from ..sources.rules import forecast_rules
from . import dataset as D
from .alerts import EPISODES, NORMAL, TREND_WANTED, WEIGHT, number, text
from .common import query, r, sr
from .tables import all_episodes, features

_SIGNALS = [row[0] for row in R.FORECAST_RULES]
_RULES = ", ".join(
    f"({text(s)}, {text(sub)}, {text(label)}, {text(way)}, {number(thr)}, {text(crit)}, {back}, {horizon}, {trip}, {number(slope)}, {number(ratio)}, {str(related).lower()})"
    for s, sub, label, way, thr, crit, back, horizon, trip, slope, ratio, related in R.FORECAST_RULES)
RULES_SQL = f"outlook(signal, subsystem, label, way, thr, crit, back, horizon, trip, min_slope, min_ratio, related) AS (VALUES {_RULES})"

_LAST_SQL = f"""{RULES_SQL},
normal_rows AS (SELECT * FROM (SELECT asset_id, us, {', '.join(_SIGNALS)} FROM readings WHERE {NORMAL}) UNPIVOT (value FOR signal IN ({', '.join(_SIGNALS)}))),
last_k AS (SELECT n.* FROM normal_rows n JOIN outlook o ON n.signal = o.signal QUALIFY row_number() OVER (PARTITION BY asset_id, n.signal ORDER BY us DESC) <= any_value(greatest(back, 18)) OVER (PARTITION BY asset_id, n.signal)),
steps AS (SELECT *, (us - min(us) OVER (PARTITION BY asset_id, signal)) / 6e7 AS x, value - lag(value) OVER (PARTITION BY asset_id, signal ORDER BY us) AS step FROM last_k),
stats AS (SELECT asset_id, signal, count(*) AS points, regr_slope(value, x) * 60e0 AS slope_per_hour, regr_intercept(value, x) AS intercept,
    CASE WHEN var_pop(value) > 0 THEN regr_r2(value, x) ELSE 0e0 END AS r2,
    greatest(avg(CASE WHEN step IS NOT NULL THEN (step > 0)::INT END), avg(CASE WHEN step IS NOT NULL THEN (step < 0)::INT END)) AS consistency
  FROM steps GROUP BY 1, 2 HAVING count(*) >= 24)"""

_FEATURES = {s: ["zscore_1h", "ewma", "ewma_gap_abs"] for s in _SIGNALS}
_MEASURES_SQL = f"""{_LAST_SQL},
latest AS (SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY us DESC) = 1),
current AS ({' UNION ALL '.join(f"SELECT asset_id, us, mode_key, '{s}' AS signal, {s} AS value, coalesce(abs({s}__zscore_1h), 0e0) AS z, coalesce({s}__ewma_gap_abs, 0e0) AS gap FROM latest WHERE {NORMAL} AND {s} IS NOT NULL" for s in _SIGNALS)}),
joined AS (SELECT c.*, s.* EXCLUDE (asset_id, signal), o.* EXCLUDE (signal), value / thr AS ratio,
    CASE WHEN abs(slope_per_hour / 60e0) >= 1e-9 AND slope_per_hour > 0 AND value < thr THEN (thr - value) / (slope_per_hour / 60e0) END AS minutes
  FROM current c JOIN stats s ON c.asset_id = s.asset_id AND c.signal = s.signal JOIN outlook o ON c.signal = o.signal),
urgent AS (SELECT *, greatest(0e0, 1e0 - minutes / horizon) AS urg FROM joined),
scored AS (SELECT *, least(100e0, greatest(0e0, 28e0 * least(greatest(ratio, 0e0), 1.25e0) / 1.25e0 + 18e0 * least(abs(slope_per_hour) / greatest(min_slope, 1e-6), 2e0) / 2e0
    + 18e0 * r2 + 14e0 * consistency + 12e0 * least(z / 3e0, 1e0) + 5e0 * least(gap / greatest(abs(thr) * 0.03e0, 0.1e0), 1e0) + 5e0 * urg)) AS score FROM urgent WHERE minutes IS NOT NULL),
measures AS (SELECT *, least(0.99e0, greatest(0e0, score / 100e0 * 0.45e0 + r2 * 0.25e0 + consistency * 0.2e0 + urg * 0.1e0)) AS confidence FROM scored),
decided AS (SELECT *, CASE WHEN related AND minutes <= trip THEN 'possible_trip' ELSE 'critical_alarm' END AS event,
    CASE WHEN related AND minutes <= trip THEN CASE WHEN minutes <= 30 THEN 'critical' ELSE 'high' END WHEN crit = 'critica' THEN 'high' ELSE 'medium' END AS severity
  FROM measures WHERE ratio >= min_ratio AND slope_per_hour >= min_slope AND r2 >= 0.55 AND minutes <= horizon AND confidence >= 0.68)"""

_UNION = {s: list(dict.fromkeys([*TREND_WANTED.get(s, []), *_FEATURES.get(s, [])])) for s in [*TREND_WANTED, *_FEATURES]}
_EPISODES_AND_FEATURES = EPISODES.replace(D.features_sql(TREND_WANTED), D.features_sql(_UNION))


@query("f1_forecast_gate", f"""
WITH {EPISODES}, {RULES_SQL}, l AS (SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY us DESC) = 1),
c AS ({' UNION ALL '.join(f"SELECT asset_id, '{s}' AS signal FROM l WHERE {NORMAL} AND {s} IS NOT NULL" for s in _SIGNALS)})
SELECT c.* FROM c ANTI JOIN (SELECT asset_id, signal FROM episodes WHERE is_active) e ON c.asset_id = e.asset_id AND c.signal = e.signal""")
def forecast_gate(spark, sf):
    return forecast.forecast_measures(features(spark, sf), forecast_rules(spark), all_episodes(spark, sf).where("is_active")).select("asset_id", "signal")


@query("f2_f3_regression_statistics", f"""
WITH {D.READINGS_SQL}, {_LAST_SQL}
SELECT asset_id, signal, points, {sr('slope_per_hour', 'slope_per_hour')}, {sr('intercept', 'intercept')}, {sr('r2', 'r2')}, {sr('consistency', 'consistency')} FROM stats""")
def regression_statistics(spark, sf):
    stats = forecast.regression_stats(forecast.regression_window(D.readings(spark, sf), forecast_rules(spark)))
    return stats.select("asset_id", "signal", "points", *[r(c) for c in ("slope_per_hour", "intercept", "r2", "consistency")])


@query("f4_f8_forecast_measures", f"""
WITH {D.features_sql(_FEATURES)}, {_MEASURES_SQL}
SELECT asset_id, signal, {sr('ratio', 'closeness')}, {sr('minutes', 'forecast_minutes', 2)}, {sr('score', 'score')}, {sr('confidence', 'confidence')},
  CASE WHEN slope_per_hour >= min_slope THEN 1 ELSE 0 END AS risky FROM measures""")
def forecast_measures(spark, sf):
    measures = forecast.forecast_measures(features(spark, sf), forecast_rules(spark)).where(F.col("forecast_minutes").isNotNull())
    risky = forecast.risky_slope(F.col("slope_per_hour"), F.col("min_slope_per_hour"), F.col("direction"))
    return measures.select("asset_id", "signal", r("closeness"), r("forecast_minutes", 2), r("score"), r("confidence"), risky.cast("int").alias("risky"))


@query("f9_f10_forecast_alerts", f"""
WITH {D.features_sql(_FEATURES)}, {_MEASURES_SQL}
SELECT asset_id, sha1('predictive::' || signal || '::' || event) AS alert_id, 'predictive::' || signal AS rule_id, subsystem, severity,
  CASE WHEN event = 'possible_trip' THEN 'Risco antecipado de trip por tendencia em ' ELSE 'Risco antecipado de alarme critico em ' END || label AS title,
  'A tendencia estatistica de ' || label || ' sugere risco de ' || CASE WHEN event = 'possible_trip' THEN 'trip' ELSE 'alarme critico' END || ' em aproximadamente '
    || round_even(minutes, 0)::BIGINT || ' min se a degradacao persistir. Valor atual ' || printf('%.3f', value) || ' | limiar ' || printf('%.3f', thr) || '.' AS message,
  way || ' ' || regexp_replace(thr::VARCHAR, '\\.0$', '') AS threshold, {sr('value', 'current_value')}, us AS triggered_us FROM decided""")
def forecast_alerts(spark, sf):
    measures = forecast.forecast_measures(features(spark, sf), forecast_rules(spark))
    rows = forecast.forecast_alerts(forecast.forecast_decision(measures))
    return rows.select("asset_id", "alert_id", "rule_id", "subsystem", "severity", "title", "message", "threshold", r("current_value"), "triggered_us")


@query("f11_merged_scores", f"""
WITH {_EPISODES_AND_FEATURES}, {_MEASURES_SQL},
gone AS (SELECT DISTINCT asset_id, signal FROM episodes WHERE is_active),
pool AS (SELECT asset_id, subsystem, severity, title, alert_id, last_seen_us, 0 AS late FROM episodes WHERE is_active
  UNION ALL SELECT d.asset_id, d.subsystem, d.severity,
    CASE WHEN event = 'possible_trip' THEN 'Risco antecipado de trip por tendencia em ' ELSE 'Risco antecipado de alarme critico em ' END || label,
    sha1('predictive::' || d.signal || '::' || event), us, 1 FROM decided d ANTI JOIN gone g ON d.asset_id = g.asset_id AND d.signal = g.signal),
ranked_pool AS (SELECT *, row_number() OVER (PARTITION BY asset_id, subsystem ORDER BY late, last_seen_us DESC, {WEIGHT} DESC, alert_id) AS place FROM pool)
SELECT asset_id, subsystem, round(least(100e0, max({WEIGHT}) + 8e0 * (count(*) - 1)), 1) + 0e0 AS score, count(*) AS active_alerts,
  string_agg(title, ' / ' ORDER BY place) FILTER (WHERE place <= 3) AS rationale FROM ranked_pool GROUP BY 1, 2""")
def merged_scores(spark, sf):
    history = all_episodes(spark, sf)
    measures = forecast.forecast_measures(features(spark, sf), forecast_rules(spark), history.where("is_active"))
    merged = forecast.merge_alerts(history, forecast.forecast_alerts(forecast.forecast_decision(measures)))
    scores = episodes.risk_scores(merged.where("is_active"))
    return scores.select("asset_id", "subsystem", r("score", 1), "active_alerts", F.array_join("rationale", " / ").alias("rationale"))
