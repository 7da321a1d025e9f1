"""Scans, cleaning and data quality (2.A to 2.C of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import signals as S
from ..config import DAY_US, FlowParameters
from ..functions.columns import ambient_columns, epoch_micros, flow_columns
from ..operators import cleaning, quality
from ..operators.timeslice import newest_rows
from ..session import literal_table, shared_folder
from ..sources import telemetry
from . import dataset as D
from .common import query, r, sr

END_US = 1706659200000000  # first instant after the month the events cover
MARK_SQL = "SELECT asset_id, max(us) AS mark_us FROM readings WHERE day % 30 <> (asset_id + 5) AND us < 1706000000000000 GROUP BY 1"

RAW_TAGS = ["PV_PRES_SISTEMA_BAR", "PV_CORR_MOTOR_A", "PV_POS_ABERT_VALV_ADMISSAO_%", "PV_POSIÇÃO_ALIVIO%"]
RAW_COLUMNS = ["pv_pres_sistema_bar", "pv_corr_motor_a", "pv_pos_abert_valv_admissao_pct", "pv_pos_alivio_pct"]


def _raw_export(spark, sf):
    """Readings as an export would hold them: raw headers, day-first text times, decimal commas."""
    rows = D.raw_readings(spark, sf)
    text = F.concat_ws("", F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    values = [F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(f"7A1_{tag}") for c, tag in zip(RAW_COLUMNS, RAW_TAGS)]
    return rows.select(
        F.col("eid").alias("Id"), text.alias("TimeStamp"), "asset_id", F.lit("B").alias("dsTurno"), F.lit("1").alias("Status"),
        F.col("st_oper").alias("7A1_ST_OPER"), F.col("st_carga_oper").alias("7A1_ST_CARGA_OPER"), *values)


@query("a1_csv_history_scan", f"""
WITH {D.READINGS_SQL},
stamped AS (SELECT *, (us // 1000000) * 1000000 AS us_s FROM raw)
SELECT asset_id, eid AS id, us_s AS us, {sr('pv_pres_sistema_bar', 'pv_pres_sistema_bar')}, {sr('pv_corr_motor_a', 'pv_corr_motor_a')},
  {sr('pv_pos_abert_valv_admissao_pct', 'pv_pos_abert_valv_admissao_pct')}, {sr('pv_pos_alivio_pct', 'pv_pos_alivio_pct')}
FROM stamped WHERE us_s > 1705000000000000
QUALIFY row_number() OVER (PARTITION BY asset_id, us_s ORDER BY eid DESC) = 1""")
def csv_history_scan(spark, sf):
    folder = shared_folder(spark)
    _raw_export(spark, sf).write.csv(folder, sep=";", header=True, encoding="UTF-8")
    rows = telemetry.csv_history(spark, folder, ";", since_us=1705000000000000)
    return rows.select("asset_id", "id", "us", *[r(c) for c in RAW_COLUMNS])


@query("a3_column_normalisation", f"""
WITH {D.READINGS_SQL}
SELECT name, count(*) AS values_present FROM (
  UNPIVOT (SELECT eid::VARCHAR AS id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS "timestamp", asset_id::VARCHAR AS asset_id, 'B' AS ds_turno,
    '1' AS status, st_oper, st_carga_oper, pv_pres_sistema_bar::VARCHAR AS pv_pres_sistema_bar, pv_corr_motor_a::VARCHAR AS pv_corr_motor_a,
    pv_pos_abert_valv_admissao_pct::VARCHAR AS pv_pos_abert_valv_admissao_pct, pv_pos_alivio_pct::VARCHAR AS pv_pos_alivio_pct FROM raw)
  ON * INTO NAME name VALUE v) GROUP BY name""")
def column_normalisation(spark, sf):
    named = telemetry.normalise_columns(_raw_export(spark, sf))
    counts = named.agg(*[F.count(c).alias(c) for c in named.columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("values_present")) for c in named.columns])))


@query("a4_recent_window_scan", f"""
WITH {D.READINGS_SQL}
SELECT asset_id, us, {sr('pv_corr_motor_a', 'pv_corr_motor_a')} FROM readings WHERE us >= {END_US - 3 * DAY_US}""")
def recent_window_scan(spark, sf):
    rows = telemetry.recent_window(D.readings(spark, sf), END_US - 3 * DAY_US)
    return rows.select("asset_id", "us", r("pv_corr_motor_a"))


@query("a4_recent_window_oldest_first", f"""
WITH {D.READINGS_SQL}
SELECT asset_id, us, eid FROM readings WHERE us >= {END_US - 9 * DAY_US} ORDER BY us, asset_id LIMIT 500""")
def recent_window_oldest(spark, sf):
    return telemetry.recent_window(D.readings(spark, sf), END_US - 9 * DAY_US, oldest=500).select("asset_id", "us", "eid")


def _marks(spark, sf):
    known = D.readings(spark, sf).where((F.pmod("day", F.lit(30)) != F.col("asset_id") + 5) & (F.col("us") < 1706000000000000))
    return telemetry.high_water_marks(known.where(F.col("asset_id") != 3))


@query("a5_incremental_scan", f"""
WITH {D.READINGS_SQL},
marks AS ({MARK_SQL} HAVING asset_id <> 3)
SELECT r.asset_id, r.us, r.eid FROM readings r LEFT JOIN marks m ON r.asset_id = m.asset_id
WHERE m.mark_us IS NULL OR r.us > m.mark_us""")
def incremental_scan(spark, sf):
    return telemetry.after_mark(D.readings(spark, sf), _marks(spark, sf)).select("asset_id", "us", "eid")


@query("a6_empty_window_fallback", f"""
WITH {D.READINGS_SQL},
cut AS (SELECT * FROM readings WHERE asset_id <> 2 OR us < {END_US - 5 * DAY_US}),
silent AS (SELECT asset_id FROM cut GROUP BY 1 HAVING max(us) < {END_US - 2 * DAY_US})
SELECT asset_id, us, eid FROM cut WHERE us >= {END_US - 2 * DAY_US}
UNION ALL
SELECT asset_id, us, eid FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY us DESC) AS n FROM cut WHERE asset_id IN (SELECT asset_id FROM silent))
WHERE n <= 5000""")
def empty_window_fallback(spark, sf):
    rows = D.readings(spark, sf).where((F.col("asset_id") != 2) | (F.col("us") < END_US - 5 * DAY_US))
    return telemetry.window_or_newest(rows.select("asset_id", "us", "eid"), END_US - 2 * DAY_US)


@query("a9_newest_rows_per_asset", f"""
WITH {D.READINGS_SQL}
SELECT asset_id, us, eid, row_number() OVER (PARTITION BY asset_id ORDER BY us DESC) AS rank_desc FROM readings
QUALIFY rank_desc <= 50""")
def newest_per_asset(spark, sf):
    return newest_rows(D.readings(spark, sf).select("asset_id", "us", "eid"), 50).withColumn("rank_desc", F.col("rank_desc").cast("bigint"))


_LAYOUTS = ["dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "dd-MM-yyyy HH:mm"]


def _text_times(spark, sf):
    rows = D.raw_readings(spark, sf)
    kind = F.pmod("eid", F.lit(6))
    text = F.when(kind == 5, F.lit("sem leitura")).when(kind == 4, F.lit(None))
    for i, layout in enumerate(_LAYOUTS):
        text = text.when(kind == i, F.concat(F.lit(" "), F.date_format("ts", layout)))
    return rows.withColumn("timestamp", text.cast("string")).drop("ts", "us")


_TIME_SQL = """
CASE eid % 6 WHEN 0 THEN (us // 1000000) * 1000000 WHEN 1 THEN (us // 1000000) * 1000000 WHEN 2 THEN us
  WHEN 3 THEN (us // 60000000) * 60000000 END"""


@query("b1_timestamp_parsing", f"WITH {D.READINGS_SQL} SELECT eid, {_TIME_SQL} AS us FROM raw WHERE eid % 6 < 4")
def timestamp_parsing(spark, sf):
    return cleaning.valid_times(_text_times(spark, sf)).select("eid", "us")


@query("b2_invalid_and_duplicate_time_counts", f"""
WITH {D.READINGS_SQL}, t AS (SELECT asset_id, {_TIME_SQL} AS us FROM raw)
SELECT asset_id, count(*) FILTER (WHERE us IS NULL) AS invalid_timestamp,
  count(us) - count(DISTINCT us) AS duplicate_timestamp FROM t GROUP BY 1""")
def time_counts(spark, sf):
    rows = _text_times(spark, sf)
    parsed = rows.withColumn("us", epoch_micros(cleaning.parse_timestamp(F.col("timestamp"))))
    return cleaning.time_issue_counts(parsed)


@query("b3_keep_last_per_timestamp", """
SELECT l_returnflag AS asset, epoch_us(l_shipdate) AS us, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC,
  l_extendedprice DESC, l_partkey DESC) = 1""")
def keep_last(spark, sf):
    rows = D.table(spark, sf, "lineitem").withColumn("us", epoch_micros("l_shipdate")).withColumnRenamed("l_returnflag", "asset")
    kept = cleaning.keep_last(rows, ("asset", "us"), ("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"))
    return kept.select("asset", "us", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("b4_b5_b6_type_coercion", f"""
WITH {D.READINGS_SQL}
SELECT eid, CASE WHEN eid % 5 = 0 THEN NULL ELSE round(pv_corr_motor_a, 2) + 0e0 END AS pv_corr_motor_a,
  CASE WHEN eid % 7 = 0 THEN -1 ELSE (eid % 3)::INT END AS status,
  CASE eid % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE 'missing' END AS st_plc, eid::VARCHAR AS ds_turno
FROM raw""")
def type_coercion(spark, sf):
    rows = D.raw_readings(spark, sf)
    text = F.replace(F.round("pv_corr_motor_a", 2).cast("string"), F.lit("."), F.lit(","))
    raw = rows.select(
        "eid", F.when(F.pmod("eid", F.lit(5)) == 0, F.lit("falha")).otherwise(F.concat(F.lit(" "), text)).alias("pv_corr_motor_a"),
        F.when(F.pmod("eid", F.lit(7)) == 0, F.lit("x")).otherwise(F.pmod("eid", F.lit(3)).cast("string")).alias("status"),
        F.element_at(F.array(F.lit("True "), F.lit("SIM"), F.lit("false"), F.lit(None)), (F.pmod("eid", F.lit(4)) + 1).cast("int")).alias("st_plc"),
        F.col("eid").alias("ds_turno"))
    typed = cleaning.coerce_types(raw)
    return typed.select(
        "eid", r("pv_corr_motor_a", 2), F.coalesce("status", F.lit(-1)).alias("status"),
        F.when(F.col("st_plc"), "yes").when(~F.col("st_plc"), "no").otherwise("missing").alias("st_plc"), "ds_turno")


@query("b7_b8_derived_columns", f"""
WITH {D.READINGS_SQL}
SELECT asset_id, us, {sr('delta_filtro_oleo_bar', 'delta_filtro_oleo_bar')}, {sr('pv_vib_max_mils', 'pv_vib_max_mils')},
  {sr('pv_temp_estator_max_c', 'pv_temp_estator_max_c')} FROM readings""")
def derived_columns(spark, sf):
    return D.readings(spark, sf).select("asset_id", "us", r("delta_filtro_oleo_bar"), r("pv_vib_max_mils"), r("pv_temp_estator_max_c"))


_FLOW_PARAMETERS = [
    dict(asset_id=0, nominal_flow=12000.0, nominal_current=180.0, no_load_current=0.0, current_to_normal=0.87658),
    dict(asset_id=1, nominal_flow=9000.0, nominal_current=160.0, no_load_current=40.0, current_to_normal=0.9),
    dict(asset_id=2, nominal_flow=9000.0, nominal_current=100.0, no_load_current=100.0, current_to_normal=0.9),
    dict(asset_id=3, nominal_flow=9000.0, nominal_current=160.0, no_load_current=40.0, current_to_normal=0.0),
]
_FLOW_VALUES = ", ".join(
    f"({p['asset_id']}, {p['nominal_flow']!r}::DOUBLE, {p['nominal_current']!r}::DOUBLE, {p['no_load_current']!r}::DOUBLE, {p['current_to_normal']!r}::DOUBLE)"
    for p in _FLOW_PARAMETERS)


@query("b9_flow_estimate", f"""
WITH {D.READINGS_SQL},
p(asset_id, qnom, i_n, i_0, f) AS (VALUES {_FLOW_VALUES}),
q AS (SELECT r.asset_id, r.us, p.*, CASE WHEN i_n > i_0 AND f > 0 AND pv_corr_motor_a IS NOT NULL
    THEN least(greatest(qnom * ((pv_corr_motor_a - i_0) / (i_n - i_0)), 0e0), qnom) END AS qn
  FROM raw r JOIN p ON r.asset_id = p.asset_id)
SELECT asset_id, us, {sr('qn', 'qn_m3h')}, {sr('CASE WHEN qn IS NOT NULL THEN greatest(qnom - qn, 0e0) END', 'q_perda_m3h')},
  {sr('qn / qnom * 100e0', 'q_utilizacao_pct')}, {sr('CASE WHEN f > 0 THEN qn / f END', 'qa_m3h')} FROM q""")
def flow_estimate(spark, sf):
    parameters = literal_table(spark, "asset_id bigint, nominal_flow double, nominal_current double, no_load_current double, current_to_normal double", _FLOW_PARAMETERS)
    rows = cleaning.add_derived(D.raw_readings(spark, sf), parameters)
    return rows.select("asset_id", "us", *[r(c) for c in ("qn_m3h", "q_perda_m3h", "q_utilizacao_pct", "qa_m3h")])


@query("b10_ambient_conversion", f"""
WITH {D.READINGS_SQL}, a AS (SELECT asset_id, us, 50e0 + 40e0 * q AS rh, 18e0 + 14e0 * u AS t FROM base),
p AS (SELECT asset_id, us, t, rh / 100e0 * 3.7831e0 AS pv FROM a)
SELECT asset_id, us, {sr('pv', 'vapor_kpa', 6)}, {sr('101.325e0 - pv', 'dry_air_kpa', 6)},
  {sr('(101.325e0 - pv) / 101.325e0 * (273.15e0 / (t + 273.15e0))', 'normal_factor', 6)} FROM p""")
def ambient_conversion(spark, sf):
    events = D.table(spark, sf, "events").select(
        F.pmod("user_id", F.lit(4)).cast("bigint").alias("asset_id"), epoch_micros("ts").alias("us"),
        (50.0 + 40.0 * (F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 1e2)).alias("rh"),
        (18.0 + 14.0 * (F.col("value") / (F.col("value") + 50.0))).alias("t"))
    p = FlowParameters()
    columns = ambient_columns(F.col("rh"), F.lit(p.saturation_vapor_kpa), F.lit(p.atmospheric_pressure_kpa), F.col("t"))
    return events.select("asset_id", "us", *[r(c, 6, n) for n, c in columns.items()])


@query("b11_operating_mode", f"""
WITH {D.READINGS_SQL}
SELECT asset_id, mode_key, count(*) AS readings, count(*) FILTER (WHERE is_normal_operation) AS normal FROM readings GROUP BY 1, 2""")
def operating_mode(spark, sf):
    return D.readings(spark, sf).groupBy("asset_id", "mode_key").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if("is_normal_operation").alias("normal"))


@query("b12_b13_analysis_filters", f"""
WITH {D.READINGS_SQL}
SELECT asset_id, us, eid FROM readings
WHERE NOT coalesce(st_oper IN ('PARTINDO', 'PARANDO', 'DESACELERANDO', 'INICIALIZANDO PARTIDA'), false)
  AND st_oper = 'EM FUNCIONAMENTO' AND st_carga_oper = 'CARREGADO'""")
def analysis_filters(spark, sf):
    from ..functions.columns import is_normal_operation, is_transition

    return D.readings(spark, sf).where(~is_transition() & is_normal_operation()).select("asset_id", "us", "eid")


@query("b14_history_merge", f"""
WITH {D.READINGS_SQL},
parts AS (
  SELECT asset_id, us, eid, pv_corr_motor_a AS a, 0 AS src FROM raw WHERE us < 1706500000000000
  UNION ALL SELECT asset_id, us, eid, pv_corr_motor_a + 1e0, 1 FROM raw WHERE us >= 1706400000000000),
kept AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY asset_id, us ORDER BY src DESC) = 1)
SELECT asset_id, us, eid, {sr('a', 'pv_corr_motor_a')} FROM kept
QUALIFY us >= max(us) OVER (PARTITION BY asset_id) - {4 * DAY_US}""")
def history_merge(spark, sf):
    rows = D.raw_readings(spark, sf).select("asset_id", "us", "eid", "pv_corr_motor_a")
    fresh = rows.where(F.col("us") >= 1706400000000000).withColumn("pv_corr_motor_a", F.col("pv_corr_motor_a") + 1.0)
    merged = cleaning.merge_history(rows.where(F.col("us") < 1706500000000000), fresh, 4 * DAY_US)
    return merged.select("asset_id", "us", "eid", r("pv_corr_motor_a"))


_NULL_COLUMNS = ["st_oper", "st_carga_oper", "pv_pres_sistema_bar", "pv_pres_descarga_bar", "pv_corr_motor_a", "qn_m3h"]


@query("c1_null_profile", f"""
WITH {D.READINGS_SQL},
n AS (SELECT asset_id, {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS {c}' for c in _NULL_COLUMNS)} FROM readings GROUP BY 1)
SELECT asset_id, signal, null_count FROM (UNPIVOT n ON {', '.join(_NULL_COLUMNS)} INTO NAME signal VALUE null_count) WHERE null_count > 0""")
def null_profile(spark, sf):
    return quality.null_profile(D.readings(spark, sf), _NULL_COLUMNS)


def long_sql(signals, source: str = "readings", name: str = "long") -> str:
    """Long rows without missing values."""
    picked = ", ".join(f"{s}::DOUBLE AS {s}" for s in signals)
    return (f"{name} AS (SELECT asset_id, us, signal, value FROM (UNPIVOT (SELECT asset_id, us, {picked} FROM {source}) "
            f"ON {', '.join(signals)} INTO NAME signal VALUE value))")


@query("c2_recurrent_zeros", f"""
WITH {D.READINGS_SQL}, {long_sql(S.ZERO_ABNORMAL)},
t AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY asset_id, signal ORDER BY us DESC) <= 5)
SELECT asset_id, signal, count(*) AS window_points FROM t GROUP BY 1, 2 HAVING count(*) >= 3 AND max(abs(value)) = 0""")
def recurrent_zeros(spark, sf):
    return quality.recurrent_zeros(D.readings(spark, sf))


_STUCK_SQL = f"""{long_sql(S.STUCK_CANDIDATES)},
t AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY asset_id, signal ORDER BY us DESC) <= 45),
s AS (SELECT *, (us - lag(us) OVER (PARTITION BY asset_id, signal ORDER BY us)) / 6e7 AS step FROM t),
g AS (SELECT asset_id, signal, arg_max(value, us) AS v, count(*) AS n, (max(us) - min(us)) / 6e7 + median(step) AS m,
    max(value) - min(value) AS rng, stddev_pop(value) AS sd FROM s GROUP BY 1, 2),
stuck AS (SELECT * FROM g WHERE n >= 45 AND m >= 45 AND rng <= greatest(abs(v) * 0.001e0, 0.01e0)
    AND sd <= greatest(abs(v) * 0.001e0, 0.01e0) / 2e0)"""


@query("c3_stuck_sensors", f"""
WITH {D.READINGS_SQL}, {_STUCK_SQL}
SELECT asset_id, signal, {sr('v', 'repeated_value')}, n AS window_points, {sr('m', 'window_minutes', 1)},
  {sr('rng', 'observed_range', 6)}, {sr('sd', 'observed_std', 6)} FROM stuck""")
def stuck_sensors(spark, sf):
    return quality.stuck_sensors(D.readings(spark, sf)).select(
        "asset_id", "signal", r("repeated_value"), "window_points", r("window_minutes", 1), r("observed_range", 6), r("observed_std", 6))


_RANGE_VALUES = ", ".join(f"('{s}', {low}::DOUBLE, {high}::DOUBLE)" for s, low, high in S.PLAUSIBLE_RANGES)


@query("c4_implausible_values", f"""
WITH {D.READINGS_SQL}, {long_sql([s for s, _l, _h in S.PLAUSIBLE_RANGES])}, ranges(signal, lo, hi) AS (VALUES {_RANGE_VALUES})
SELECT l.asset_id, l.signal, {sr('arg_max(value, us)', 'last_value')}, max(us) AS us, any_value(lo) AS "min", any_value(hi) AS "max",
  CASE WHEN l.signal = 'pv_pres_vacuo_cx_engran_inh2o' THEN '{S.CALIBRATION_HINTS['pv_pres_vacuo_cx_engran_inh2o']}' END AS engineering_hint
FROM long l JOIN ranges g ON l.signal = g.signal WHERE value < lo OR value > hi GROUP BY 1, 2""")
def implausible_values(spark, sf):
    return quality.implausible_values(D.readings(spark, sf)).select(
        "asset_id", "signal", r("last_value"), "us", "min", "max", "engineering_hint")


_ISSUE_COLUMNS = ["pv_pres_sistema_bar", "pv_pres_descarga_bar", "st_oper"]
_ISSUES_SQL = f"""{_STUCK_SQL},
zlong AS (SELECT asset_id, us, signal, value FROM (UNPIVOT (SELECT asset_id, us, {', '.join(S.ZERO_ABNORMAL)} FROM readings)
  ON {', '.join(S.ZERO_ABNORMAL)} INTO NAME signal VALUE value)),
zt AS (SELECT * FROM zlong QUALIFY row_number() OVER (PARTITION BY asset_id, signal ORDER BY us DESC) <= 5),
zeros AS (SELECT asset_id, signal, count(*) AS n FROM zt GROUP BY 1, 2 HAVING count(*) >= 3 AND max(abs(value)) = 0),
nulls AS (SELECT asset_id, signal, n FROM (UNPIVOT (SELECT asset_id, {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS {c}' for c in _ISSUE_COLUMNS)}
  FROM readings GROUP BY 1) ON {', '.join(_ISSUE_COLUMNS)} INTO NAME signal VALUE n) WHERE n > 0),
ranges(signal, lo, hi) AS (VALUES {_RANGE_VALUES}),
plong AS (SELECT asset_id, us, signal, value FROM (UNPIVOT (SELECT asset_id, us, {', '.join(f'{s}::DOUBLE AS {s}' for s, _l, _h in S.PLAUSIBLE_RANGES)} FROM readings)
  ON {', '.join(s for s, _l, _h in S.PLAUSIBLE_RANGES)} INTO NAME signal VALUE value)),
outside AS (SELECT p.asset_id, p.signal, max(us) AS us FROM plong p JOIN ranges g ON p.signal = g.signal WHERE value < lo OR value > hi GROUP BY 1, 2),
newest AS (SELECT asset_id, max(us) AS us FROM readings GROUP BY 1),
times AS (SELECT asset_id, {_TIME_SQL} AS us FROM raw),
counts AS (SELECT asset_id, count(*) FILTER (WHERE us IS NULL) AS bad, count(us) - count(DISTINCT us) AS dup FROM times GROUP BY 1),
issues AS (
  SELECT asset_id, 'invalid_timestamp' AS issue_type, '' AS signal, -1 AS us, bad::VARCHAR AS measure FROM counts WHERE bad > 0
  UNION ALL SELECT asset_id, 'duplicate_timestamp', '', -1, dup::VARCHAR FROM counts WHERE dup > 0
  UNION ALL SELECT asset_id, 'nulls', signal, -1, n::VARCHAR FROM nulls
  UNION ALL SELECT z.asset_id, 'zero_abnormal', signal, w.us, n::VARCHAR FROM zeros z JOIN newest w ON z.asset_id = w.asset_id
  UNION ALL SELECT s.asset_id, 'sensor_stuck', signal, w.us, n::VARCHAR FROM stuck s JOIN newest w ON s.asset_id = w.asset_id
  UNION ALL SELECT asset_id, 'plausibility', signal, us, '' FROM outside)"""


def text_times_us(spark, sf):
    """(asset_id, us) of every raw row, ``us`` NULL where the text is no time."""
    return _text_times(spark, sf).select("asset_id", epoch_micros(cleaning.parse_timestamp(F.col("timestamp"))).alias("us"))


def batch_issues(spark, sf):
    return quality.collect_issues(text_times_us(spark, sf), D.readings(spark, sf), _ISSUE_COLUMNS)


def _issue_rows(issues):
    measure = F.coalesce(F.col("details")["count"], F.col("details")["window_points"], F.lit(""))
    return issues.select("asset_id", "issue_type", F.coalesce("signal", F.lit("")).alias("signal"), F.coalesce("us", F.lit(-1)).alias("us"), measure.alias("measure"))


@query("c5_issue_collection", f"WITH {D.READINGS_SQL}, {_ISSUES_SQL} SELECT * FROM issues")
def issue_collection(spark, sf):
    return _issue_rows(batch_issues(spark, sf))


@query("c6_current_issues", f"""
WITH {D.READINGS_SQL}, {_ISSUES_SQL}
SELECT i.* FROM issues i JOIN newest w ON i.asset_id = w.asset_id WHERE i.us = -1 OR i.us = w.us""")
def current_issues(spark, sf):
    return _issue_rows(quality.current_issues(batch_issues(spark, sf), D.readings(spark, sf)))
