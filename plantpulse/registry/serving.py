"""Snapshots, slices, trends, catalogue and coverage (2.I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import signals as S
from ..config import DAY_US, HOUR_US
from ..operators import asof, serving
from ..operators.features import rolling_features
from ..session import small_side
from ..sources.rules import builtin_rules
from . import dataset as D
from .alerts import EPISODES, FIXED_SQL
from .common import query, r, sr
from .tables import _stage, all_episodes, numbered

_SHOWN = ["pv_pres_sistema_bar", "pv_corr_motor_a", "pv_vib_max_mils", "qn_m3h"]
_SHOWN_SQL = ", ".join(sr(c, c) for c in _SHOWN)


@query("i1_latest_snapshot", f"""
WITH {D.READINGS_SQL} SELECT asset_id, us, mode_key, {_SHOWN_SQL} FROM readings QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY us DESC) = 1""")
def latest_snapshot(spark, sf):
    return serving.latest_snapshot(D.readings(spark, sf)).select("asset_id", "us", "mode_key", *[r(c) for c in _SHOWN])


@query("i2_latest_readings", f"""
WITH {D.READINGS_SQL} SELECT asset_id, us, {_SHOWN_SQL} FROM readings QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY us DESC) <= 20""")
def latest_readings(spark, sf):
    return serving.latest_readings(D.readings(spark, sf), 20).select("asset_id", "us", *[r(c) for c in _SHOWN])


@query("i3_time_range", f"""
WITH {D.READINGS_SQL} SELECT asset_id, us, {_SHOWN_SQL} FROM readings QUALIFY us >= max(us) OVER (PARTITION BY asset_id) - {5 * DAY_US}""")
def time_range(spark, sf):
    return serving.time_range(D.readings(spark, sf), 5, "days").select("asset_id", "us", *[r(c) for c in _SHOWN])


@query("i3_time_range_one_asset", f"""
WITH {D.READINGS_SQL} SELECT asset_id, us, {_SHOWN_SQL} FROM readings WHERE asset_id = 2 QUALIFY us >= max(us) OVER () - {36 * HOUR_US}""")
def time_range_one_asset(spark, sf):
    return serving.time_range_of_asset(D.readings(spark, sf), 2, 36, "hours").select("asset_id", "us", *[r(c) for c in _SHOWN])


@query("i4_last_points", f"""
WITH {D.READINGS_SQL} SELECT asset_id, us, eid FROM readings QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY us DESC) <= 1500""")
def last_points(spark, sf):
    return serving.last_points(D.readings(spark, sf).select("asset_id", "us", "eid"), 1500)


_MULTI = ["pv_pres_sistema_bar", "pv_corr_motor_a", "pv_temp_oleo_lubrificacao_c"]
_MULTI_WANTED = {s: ["ma_15m", "ewma", "std_1h", "slope_15m", "slope_1h", "zscore_1h"] for s in _MULTI}
_TREND = "pv_corr_motor_a"
_WANTED = {_TREND: ["ma_15m", "ewma", "std_1h", "slope_15m", "slope_1h", "zscore_1h"]}
_NAMES = [*serving.TREND_MEANS, *serving.TREND_LASTS]


def _trend_features(spark, sf):
    """Readings with every trend feature of the plotted signals."""
    return _stage("trend_features", spark, sf, lambda: rolling_features(numbered(spark, sf), _MULTI_WANTED, D.WIDTHS, numbered=True))


def _series(spark, sf, signals=(_TREND,)):
    return serving.trend_rows(_trend_features(spark, sf), list(signals))


@query("i5_time_buckets", f"""
WITH {D.features_sql(_WANTED)}
SELECT asset_id, us - us % {HOUR_US} AS us, {sr(f'avg({_TREND})', 'value')}, {', '.join(sr(f'avg({_TREND}__{n})', n) for n in serving.TREND_MEANS)},
  {', '.join(sr(f'arg_max({_TREND}__{n}, us)', n, 5) for n in serving.TREND_LASTS)}, arg_max(mode_key, us) AS mode_key
FROM features GROUP BY 1, us - us % {HOUR_US} HAVING avg({_TREND}) IS NOT NULL""")
def time_buckets(spark, sf):
    rows = serving.bucketed(_series(spark, sf), "hours", means=serving.TREND_MEANS, lasts=[*serving.TREND_LASTS, "mode_key"])
    return rows.select("asset_id", "us", r("value"), *[r(n) for n in serving.TREND_MEANS], *[r(n, 5) for n in serving.TREND_LASTS], "mode_key")


def _thin_sql(source: str, m: int, keys: str) -> str:
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY us) - 1 AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
idx AS (SELECT DISTINCT {keys}, floor(i * (n - 1) / {m - 1})::BIGINT AS rn FROM (SELECT DISTINCT {keys}, n FROM placed) c, range({m}) t(i)),
thin AS (SELECT p.* FROM placed p LEFT JOIN idx USING ({keys}, rn) WHERE p.n <= {m} OR EXISTS (SELECT 1 FROM idx x WHERE {' AND '.join(f'x.{k.strip()} = p.{k.strip()}' for k in keys.split(','))} AND x.rn = p.rn))"""


@query("i6_even_thinning", f"""
WITH {D.READINGS_SQL}, s AS (SELECT asset_id, us, eid FROM readings), {_thin_sql('s', 333, 'asset_id')} SELECT asset_id, us, eid FROM thin""")
def even_thinning(spark, sf):
    return serving.thinned(D.readings(spark, sf).select("asset_id", "us", "eid"), 333, ("asset_id",)).select("asset_id", "us", "eid")




def _trend_sql(signals, wanted, days: int, m: int) -> str:
    one = [f"""SELECT asset_id, us, '{s}' AS signal, {s} AS value, {S.SETPOINT_OF.get(s, 'NULL::DOUBLE')} AS target, {', '.join(f'{s}__{n} AS {n}' for n in _NAMES)} FROM ranged""" for s in signals]
    return f"""{D.features_sql(wanted)}, {FIXED_SQL},
ranged AS (SELECT * FROM features QUALIFY us >= max(us) OVER (PARTITION BY asset_id) - {days * DAY_US}),
lng AS ({' UNION ALL '.join(one)}),
buckets AS (SELECT asset_id, signal, us - us % {HOUR_US} AS us, avg(value) AS value, avg(target) AS target, {', '.join(f'avg({n}) AS {n}' for n in serving.TREND_MEANS)},
    {', '.join(f'arg_max({n}, us) AS {n}' for n in serving.TREND_LASTS)} FROM lng GROUP BY 1, 2, us - us % {HOUR_US} HAVING avg(value) IS NOT NULL),
{_thin_sql('buckets', m, 'asset_id, signal')},
limits AS (SELECT signal, coalesce(max(lo) FILTER (WHERE cond = 'between'), max(thr) FILTER (WHERE cond IN ('lt', 'lte'))) AS lower_limit,
    coalesce(min(hi) FILTER (WHERE cond = 'between'), min(thr) FILTER (WHERE cond IN ('gt', 'gte'))) AS upper_limit FROM fixed_rules GROUP BY 1)"""


_POINT = ["value", "target", "ma_15m", "ewma", "lower_limit", "upper_limit"]


@query("i7_trend_series", f"""
WITH {_trend_sql(['pv_pres_sistema_bar'], {'pv_pres_sistema_bar': _MULTI_WANTED['pv_pres_sistema_bar']}, 20, 100)}
SELECT asset_id, us, {', '.join(sr(c, c) for c in _POINT)} FROM thin LEFT JOIN limits USING (signal)""")
def trend_series(spark, sf):
    points = serving.trend_series(_trend_features(spark, sf), ["pv_pres_sistema_bar"], builtin_rules(spark), 20, "days", "hours", 100)
    return points.select("asset_id", "us", *[r(c) for c in _POINT])


@query("i8_trend_summary", f"""
WITH {_trend_sql(['pv_pres_sistema_bar'], {'pv_pres_sistema_bar': _MULTI_WANTED['pv_pres_sistema_bar']}, 20, 100)},
w AS (SELECT *, lag(value) OVER (PARTITION BY asset_id ORDER BY us) AS prev, row_number() OVER (PARTITION BY asset_id ORDER BY us DESC) AS last,
    avg(value) OVER (PARTITION BY asset_id) AS m, min(value) OVER (PARTITION BY asset_id) AS lo, max(value) OVER (PARTITION BY asset_id) AS hi, count(*) OVER (PARTITION BY asset_id) AS points FROM thin)
SELECT asset_id, {sr('value', 'latest')}, {sr('prev', 'previous')}, {sr('target', 'target_current')}, {sr('m', 'mean')}, {sr('lo', 'minimum')}, {sr('hi', 'maximum')}, {sr('value - prev', 'delta')},
  {sr('slope_15m', 'slope_15m', 5)}, {sr('slope_1h', 'slope_1h', 5)}, {sr('zscore_1h', 'zscore_1h')}, {sr('std_1h', 'std_1h')}, points FROM w WHERE last = 1""")
def trend_summary(spark, sf):
    points = serving.trend_series(_trend_features(spark, sf), ["pv_pres_sistema_bar"], builtin_rules(spark), 20, "days", "hours", 100)
    summary = serving.trend_summary(points)
    return summary.select("asset_id", *[r(c) for c in ("latest", "previous", "target_current", "mean", "minimum", "maximum", "delta")],
                          r("slope_15m", 5), r("slope_1h", 5), r("zscore_1h"), r("std_1h"), "points")


@query("i9_limits_and_rules", f"""
WITH {D.READINGS_SQL}, {FIXED_SQL},
limits AS (SELECT signal, coalesce(max(lo) FILTER (WHERE cond = 'between'), max(thr) FILTER (WHERE cond IN ('lt', 'lte'))) AS lower_limit,
    coalesce(min(hi) FILTER (WHERE cond = 'between'), min(thr) FILTER (WHERE cond IN ('gt', 'gte'))) AS upper_limit FROM fixed_rules GROUP BY 1),
n AS (SELECT * FROM (SELECT asset_id, us, pv_pres_sistema_bar, pv_corr_motor_a, pv_temp_oleo_lubrificacao_c, pv_pres_oleo_bar FROM readings) UNPIVOT (value FOR signal IN (pv_pres_sistema_bar, pv_corr_motor_a, pv_temp_oleo_lubrificacao_c, pv_pres_oleo_bar)))
SELECT n.signal, lower_limit, upper_limit, (SELECT count(*) FROM fixed_rules f WHERE f.signal = n.signal)::BIGINT + CASE WHEN n.signal IN ('pv_corr_motor_a', 'pv_temp_oleo_lubrificacao_c') THEN 1 ELSE 0 END AS rules,
  count(*) FILTER (WHERE value < lower_limit) AS below, count(*) FILTER (WHERE value > upper_limit) AS above FROM n JOIN limits ON n.signal = limits.signal GROUP BY 1, 2, 3""")
def limits_and_rules(spark, sf):
    from ..functions.columns import long_rows

    rules = builtin_rules(spark)
    listed = serving.signal_rules(rules).groupBy("signal").agg(F.count(F.lit(1)).alias("rules"))
    long = D.readings(spark, sf).select(long_rows(["pv_pres_sistema_bar", "pv_corr_motor_a", "pv_temp_oleo_lubrificacao_c", "pv_pres_oleo_bar"])).where(F.col("value").isNotNull())
    limits = serving.signal_limits(rules)
    return long.join(F.broadcast(limits), "signal").groupBy("signal", "lower_limit", "upper_limit").agg(
        F.count_if(F.col("value") < F.col("lower_limit")).alias("below"), F.count_if(F.col("value") > F.col("upper_limit")).alias("above")).join(F.broadcast(listed), "signal")


@query("i10_multi_signal_trend", f"""
WITH {_trend_sql(_MULTI, _MULTI_WANTED, 20, 100)}
SELECT asset_id, signal, us, 'normalized' AS correlation_mode, {', '.join(sr(c, c) for c in _POINT)} FROM thin LEFT JOIN limits USING (signal)""")
def multi_signal_trend(spark, sf):
    points = serving.trend_series(_trend_features(spark, sf), [" pv_pres_sistema_bar", "pv_corr_motor_a", "pv_corr_motor_a", "pv_temp_oleo_lubrificacao_c"],
                                  builtin_rules(spark), 20, "days", "hours", 100)
    return points.select("asset_id", "signal", "us", "correlation_mode", *[r(c) for c in _POINT])


_CATALOGUE = ", ".join(
    f"({i}, '{sub}', '{s}', '{label}', {'NULL' if unit is None else repr(unit)}, {int(s in S.DERIVED_SIGNALS)}, {repr(S.SETPOINT_OF[s]) if s in S.SETPOINT_OF else 'NULL'})"
    for i, (sub, s, label, unit) in enumerate(S.SIGNALS) if s in S.NUMERIC_SIGNALS)


@query("i11_signal_catalogue", f"""
WITH {EPISODES}, cat(ordinal, subsystem, signal, label, unit, derived, target) AS (VALUES {_CATALOGUE}),
limits AS (SELECT signal, coalesce(max(lo) FILTER (WHERE cond = 'between'), max(thr) FILTER (WHERE cond IN ('lt', 'lte'))) AS lower_limit,
    coalesce(min(hi) FILTER (WHERE cond = 'between'), min(thr) FILTER (WHERE cond IN ('gt', 'gte'))) AS upper_limit FROM fixed_rules GROUP BY 1),
n AS (SELECT asset_id, signal, count(*) AS k FROM episodes WHERE is_active GROUP BY 1, 2)
SELECT a.asset_id, c.signal, label, c.subsystem, unit, CASE WHEN c.signal LIKE 'sp\\_%' ESCAPE '\\' THEN 1 ELSE 0 END AS is_setpoint, derived AS is_derived, coalesce(target, '') AS target_signal,
  lower_limit, upper_limit, coalesce(k, 0) AS active_alerts, 'pv_pres_sistema_bar' AS default_signal
FROM (SELECT DISTINCT asset_id FROM readings) a CROSS JOIN cat c LEFT JOIN limits l ON c.signal = l.signal LEFT JOIN n ON n.asset_id = a.asset_id AND n.signal = c.signal""")
def signal_catalogue(spark, sf):
    catalogue = serving.signal_catalogue(D.readings(spark, sf), all_episodes(spark, sf).where("is_active"), builtin_rules(spark))
    return catalogue.join(serving.default_signal(catalogue), "asset_id").select(
        "asset_id", "signal", "label", "subsystem", "unit", F.col("is_setpoint").cast("int").alias("is_setpoint"), F.col("is_derived").cast("int").alias("is_derived"),
        F.coalesce("target_signal", F.lit("")).alias("target_signal"), "lower_limit", "upper_limit", "active_alerts", "default_signal")


@query("i12_alerts_per_signal", f"WITH {EPISODES} SELECT asset_id, signal, count(*) AS active_alerts FROM episodes WHERE is_active GROUP BY 1, 2")
def alerts_per_signal(spark, sf):
    return serving.alert_counts(all_episodes(spark, sf).where("is_active"))


@query("i13_service_coverage", f"""
WITH {EPISODES}
SELECT (SELECT min(us) FROM readings) AS earliest_us, (SELECT max(us) FROM readings) AS latest_us, (SELECT count(*) FROM readings) AS history_rows,
  (SELECT count(*) FROM episodes) AS alert_events, (SELECT count(*) FROM episodes WHERE is_active) AS active_alerts, 'ok' AS status""")
def service_coverage(spark, sf):
    return serving.service_coverage(D.readings(spark, sf), all_episodes(spark, sf))


@query("i14_current_flow", f"""
WITH {D.READINGS_SQL}, l AS (SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY us DESC) = 1)
SELECT asset_id, us, {sr('pv_corr_motor_a', 'current_a')}, {sr('qn_m3h', 'qn_m3h')}, {sr('q_perda_m3h', 'q_perda_m3h')}, {sr('q_utilizacao_pct', 'q_utilizacao_pct')}, {sr('qa_m3h', 'qa_m3h')},
  0.87658e0 AS factor, {sr('0.9e0 * 3.7831e0', 'vapor_kpa')}, {sr('101.325e0 - 0.9e0 * 3.7831e0', 'dry_air_kpa')},
  {sr('(101.325e0 - 0.9e0 * 3.7831e0) / 101.325e0 * (273.15e0 / 301.15e0)', 'normal_factor')} FROM l""")
def current_flow(spark, sf):
    rows = D.readings(spark, sf).drop("qa_m3h").withColumn("q_perda_m3h", F.lit(None).cast("double"))
    return serving.current_flow(rows).select("asset_id", "us", *[r(c) for c in (
        "current_a", "qn_m3h", "q_perda_m3h", "q_utilizacao_pct", "qa_m3h")], "factor", *[r(c) for c in ("vapor_kpa", "dry_air_kpa", "normal_factor")])


@query("i15_normalised_series", f"""
WITH {D.READINGS_SQL}, w AS (SELECT asset_id, us, pv_pres_sistema_bar, pv_corr_motor_a, sp_pres_sistema_bar FROM readings),
n AS (SELECT * FROM w UNPIVOT INCLUDE NULLS (value FOR signal IN (pv_pres_sistema_bar, pv_corr_motor_a, sp_pres_sistema_bar))),
b AS (SELECT *, min(value) OVER p AS lo, max(value) OVER p AS hi FROM n WINDOW p AS (PARTITION BY asset_id, signal))
SELECT asset_id, signal, us, {sr('CASE WHEN value IS NOT NULL THEN CASE WHEN hi = lo THEN 50e0 ELSE (value - lo) / (hi - lo) * 100e0 END END', 'normalized')} FROM b""")
def normalised_series(spark, sf):
    from ..functions.columns import long_rows

    long = D.readings(spark, sf).select("asset_id", "us", long_rows(["pv_pres_sistema_bar", "pv_corr_motor_a", "sp_pres_sistema_bar"]))
    return serving.normalised(long).select("asset_id", "signal", "us", r("normalized"))


_EVENTS_OF = "pv_temp_oleo_lubrificacao_c"
_NEAR_SQL = f"""{EPISODES},
marks AS (SELECT asset_id, alert_id, last_seen_us - 90000000 AS us FROM episodes WHERE signal = '{_EVENTS_OF}'),
points AS (SELECT asset_id, us - us % {HOUR_US} AS us, avg({_EVENTS_OF}) AS value FROM readings GROUP BY 1, us - us % {HOUR_US})"""


def _marks_and_points(spark, sf):
    marks = all_episodes(spark, sf).where(F.col("signal") == _EVENTS_OF).select("asset_id", "alert_id", (F.col("last_seen_us") - 90000000).alias("us"))
    long = D.readings(spark, sf).select("asset_id", "us", F.lit(_EVENTS_OF).alias("signal"), F.col(_EVENTS_OF).alias("value"))
    return marks, serving.bucketed(long, "hours").drop("signal")


@query("i16_nearest_point", f"""
WITH {_NEAR_SQL}
SELECT m.asset_id, m.alert_id, m.us, p.us AS near_us, {sr('p.value', 'near_value')} FROM marks m JOIN points p ON m.asset_id = p.asset_id AND abs(m.us - p.us) <= {12 * HOUR_US}
QUALIFY row_number() OVER (PARTITION BY m.asset_id, m.alert_id, m.us ORDER BY abs(m.us - p.us), p.us) = 1""")
def nearest_point(spark, sf):
    marks, points = _marks_and_points(spark, sf)
    return asof.nearest_join(marks, points, payload=["value"]).select("asset_id", "alert_id", "us", "near_us", r("near_value"))


@query("i17_alerts_within_tolerance", f"""
WITH {_NEAR_SQL}, spans AS (SELECT asset_id, greatest((max(us) - min(us)) // 80, 60000000) AS tol FROM points GROUP BY 1)
SELECT p.asset_id, p.us, (SELECT count(*) FROM marks m WHERE m.asset_id = p.asset_id AND m.us BETWEEN p.us - s.tol AND p.us + s.tol) AS nearby FROM points p JOIN spans s ON p.asset_id = s.asset_id""")
def within_tolerance(spark, sf):
    marks, points = _marks_and_points(spark, sf)
    spans = points.groupBy("asset_id").agg(F.greatest(F.expr("(max(us) - min(us)) div 80"), F.lit(60_000_000)).alias("tol"))
    probe = points.join(small_side(spans), "asset_id")
    return asof.count_within(probe, marks, F.col("tol")).select("asset_id", "us", "nearby")


@query("i19_effective_target", f"""
WITH {D.READINGS_SQL}
SELECT asset_id, us, {sr("coalesce(CASE WHEN eid % 9 <> 0 THEN sp_pres_sistema_bar END, CASE WHEN eid % 2 = 0 THEN 6.5e0 END, pv_pres_sistema_bar)", 'target')} FROM readings""")
def effective_target(spark, sf):
    rows = D.readings(spark, sf)
    live = F.when(F.pmod("eid", F.lit(9)) != 0, F.col("sp_pres_sistema_bar"))
    static = F.when(F.pmod("eid", F.lit(2)) == 0, F.lit(6.5))
    return rows.select("asset_id", "us", r(serving.effective_target(live, static, F.col("pv_pres_sistema_bar")), 4, "target"))
