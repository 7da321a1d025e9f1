"""Telemetry derived from the ``events`` table, once as DataFrames and once as SQL text for the oracle.

Every event becomes one reading of one of four assets. All signals are arithmetic on the event's own columns, so the
work grows with the table. States, gaps, zeros, constant stretches and a daily ramp are functions of event id and day.
The SQL expressions below are written once and used by both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import signals as S
from ..config import DAY_US, HOUR_US, WindowWidths
from ..functions.columns import epoch_micros
from ..operators.cleaning import add_derived, add_mode
from ..operators.features import numbered_readings
from ..operators.timeslice import SLICE

#: event cadence per asset is minutes to a quarter of an hour, so frames are wider than for minute data
WIDTHS = WindowWidths(short=HOUR_US // 2, medium=2 * HOUR_US, long=6 * HOUR_US)

STATES = {
    "st_oper": "CASE WHEN eid % 97 = 0 THEN NULL WHEN day % 7 = 0 THEN 'PARTINDO' ELSE 'EM FUNCIONAMENTO' END",
    "st_carga_oper": "CASE WHEN hour < 3 THEN 'SEM CARGA' ELSE 'CARREGADO' END",
}

MEASURED = {
    "sp_pres_sistema_bar": "6.7e0",
    "pv_pres_sistema_bar": "CASE WHEN eid % 17 = 0 THEN NULL ELSE 5.6e0 + 1.2e0 * q + 0.9e0 * u END",
    "sp_pres_setpoint_descarga_bar": "7.0e0",
    "pv_pres_descarga_bar": "CASE WHEN eid % 19 = 0 THEN NULL ELSE 6.0e0 + 1.0e0 * q + 1.1e0 * u END",
    "pv_temp_ar_estagio_3_c": "CASE WHEN day % 11 = 7 OR eid % 23 = 0 THEN 0e0 ELSE 44e0 + 9e0 * q + 4e0 * u END",
    "pv_pos_abert_valv_admissao_pct": "58e0 + 34e0 * q + 3e0 * u",
    "pv_pos_valv_bypass_pct": "26e0 * u",
    "pv_pos_alivio_pct": "9e0 + 14e0 * u * q",
    "pv_pres_oleo_antes_filtro_bar": "9.5e0 + 2.4e0 * u",
    "pv_pres_oleo_bar": "8.2e0 - 1.5e0 * q + 0.3e0 * u",
    "pv_temp_oleo_lubrificacao_c": "44e0 + 6e0 * g + 11e0 * u",
    "pv_niv_interruptor_oleo_bar": "CASE WHEN eid % 29 = 0 THEN 0e0 ELSE 1e0 END",
    "pv_pres_vacuo_cx_engran_inh2o": "CASE WHEN day % 13 = 3 THEN 350e0 + u ELSE 8.2e0 + 3.2e0 * q + 0.9e0 * u END",
    "pv_vib_estagio_1_mils": "0.3e0 + 1.05e0 * u + 0.05e0 * q",
    "pv_vib_estagio_2_mils": "0.5e0 + CASE WHEN sod >= 43200e0 THEN 0.78e0 * (sod - 43200e0) / 43200e0 ELSE 0e0 END + 0.005e0 * u",
    "pv_vib_estagio_3_mils": "0.45e0 + 0.6e0 * q * u + 0.1e0 * g",
    "pv_temp_fase_a_do_estator_c": "118e0 + 52e0 * u + 6e0 * q",
    "pv_temp_fase_b_do_estator_c": "117e0 + 48e0 * u + 5e0 * q",
    "pv_temp_fase_c_do_estator_c": "116e0 + 44e0 * u + 9e0 * q",
    "pv_temp_rolamento_dianteiro_motor": "66e0 + 8e0 * g + 15e0 * u",
    "pv_corr_motor_a": "CASE WHEN day % 9 = 6 THEN 181e0 WHEN eid % 41 = 0 THEN 190e0 + u ELSE 104e0 + 44e0 * q + 19e0 * (1e0 - u) END",
    "pv_hor_operacao": "1000e0 + 720e0 * g",
    "pv_hor_carregada": "900e0 + 630e0 * g",
    "pv_num_partidas": "40e0 + day % 30 + 0e0",
}

_BASE_SPARK = {
    "eid": "event_id",
    "day": f"us div {DAY_US}",
    "hour": f"(us div {HOUR_US}) % 24",
    "sod": f"(us % {DAY_US}) / 1e6",
    "q": "cast(regexp_extract(props, '([0-9]+)', 1) as double) / 1e2",
    "u": "value / (value + 5e1)",
    "g": "(us - 1704067200000000) / 2.592e12",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed_events(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """Asset, id and time of each event and the columns that signals are derived from."""
    events = table(spark, sf_dir, "events")
    events = events.repartition(files) if files else events
    return events.select(F.pmod("user_id", F.lit(4)).cast("bigint").alias("asset_id"), F.col("event_id").alias("eid"), "ts",
                         epoch_micros("ts").alias("us"), "value", "props")


def _measured(events: DataFrame, *kept: str) -> DataFrame:
    base = events.withColumns({k: F.expr(v) for k, v in _BASE_SPARK.items() if k != "eid"})
    columns = {k: F.expr(v) for k, v in (STATES | MEASURED).items()}
    return base.select("asset_id", "eid", "ts", "us", "day", *kept, *[c.alias(k) for k, c in columns.items()])


def raw_readings(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """Measured signals and states, before derivation; with ``files``, events are dealt to that many tasks while they are narrow."""
    return _measured(_timed_events(spark, sf_dir, files))


def readings(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """Readings with derived quantities and operating mode."""
    return add_mode(add_derived(raw_readings(spark, sf_dir, files)))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered readings. Events are shuffled and numbered with their mode while they are narrow, their signals are derived behind that."""
    events = _timed_events(spark, sf_dir)
    placed = numbered_readings(add_mode(_measured(events, "value", "props")).select(*events.columns, "mode_key"))
    places = [c for c in placed.columns if c not in (*events.columns, "mode_key")]
    wide = add_mode(add_derived(_measured(placed, *places)))
    signals = [c for c in wide.columns if c not in ("asset_id", *places)]
    return wide.select("asset_id", SLICE, *signals, *[c for c in places if c != SLICE])


def _select(columns: dict[str, str]) -> str:
    return ",\n    ".join(f"{expression} AS {name}" for name, expression in columns.items())


#: the same readings for the oracle, as a list of CTEs to put after WITH
READINGS_SQL = f"""
base AS (
  SELECT event_id AS eid, (user_id % 4)::BIGINT AS asset_id, ts, epoch_us(ts) AS us, event_type, user_id,
    epoch_us(ts) // {DAY_US} AS day, (epoch_us(ts) // {HOUR_US}) % 24 AS hour, (epoch_us(ts) % {DAY_US}) / 1e6 AS sod,
    regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 1e2 AS q, value / (value + 5e1) AS u,
    (epoch_us(ts) - 1704067200000000) / 2.592e12 AS g
  FROM events
),
raw AS (
  SELECT asset_id, eid, ts, us, day,
    {_select(STATES | MEASURED)}
  FROM base
),
flow AS (
  SELECT *, least(greatest(12000e0 * (pv_corr_motor_a - 0e0) / 180e0, 0e0), 12000e0) AS qn_m3h FROM raw
),
readings AS (
  SELECT *,
    pv_pres_oleo_antes_filtro_bar - pv_pres_oleo_bar AS delta_filtro_oleo_bar,
    greatest(pv_vib_estagio_1_mils, pv_vib_estagio_2_mils, pv_vib_estagio_3_mils) AS pv_vib_max_mils,
    greatest(pv_temp_fase_a_do_estator_c, pv_temp_fase_b_do_estator_c, pv_temp_fase_c_do_estator_c) AS pv_temp_estator_max_c,
    greatest(12000e0 - qn_m3h, 0e0) AS q_perda_m3h, qn_m3h / 12000e0 * 100e0 AS q_utilizacao_pct,
    qn_m3h / 0.87658e0 AS qa_m3h,
    coalesce(st_oper, 'DESCONHECIDO') || '|' || coalesce(st_carga_oper, 'DESCONHECIDO') AS mode_key,
    coalesce(st_oper = 'EM FUNCIONAMENTO' AND st_carga_oper = 'CARREGADO', false) AS is_normal_operation
  FROM flow
)"""

SEGMENTS_SQL = READINGS_SQL + """,
turns AS (
  SELECT *, row_number() OVER series AS row_idx,
    CASE WHEN mode_key = lag(mode_key) OVER series THEN 0 ELSE 1 END AS turn
  FROM readings WINDOW series AS (PARTITION BY asset_id ORDER BY us)
),
numbered AS (
  SELECT *, sum(turn) OVER (PARTITION BY asset_id ORDER BY us ROWS UNBOUNDED PRECEDING)::BIGINT AS segment_id FROM turns
)"""

_FRAMES = {"5m": WIDTHS.short, "15m": WIDTHS.medium, "1h": WIDTHS.long}


def feature_sql(signal: str, feature: str) -> str:
    """One window feature for the oracle (the weighted average has its own CTE)."""
    kind, _, frame = feature.partition("_")
    run = "PARTITION BY asset_id, segment_id ORDER BY us RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
    over = f"OVER ({run.format(_FRAMES.get(frame, WIDTHS.long) - 1)})"
    if kind in ("ma", "std", "min", "max"):
        name = {"ma": "avg", "std": "stddev_samp"}.get(kind, kind)
        return f"{name}({signal}) {over}"
    if kind == "slope":
        closed = f"OVER ({run.format(_FRAMES[frame])})"
        minute = f"((us - (us // {DAY_US}) * {DAY_US}) / 6e7 + (us // {DAY_US} - 19723) * 1440e0)"
        return f"CASE WHEN count({signal}) {closed} >= 3 THEN regr_slope({signal}, {minute}) {closed} END"
    if kind == "zscore":
        over = f"OVER ({run.format(WIDTHS.long - 1)})"
        return f"({signal} - avg({signal}) {over}) / nullif(stddev_samp({signal}) {over}, 0)"
    raise ValueError(feature)


def features_sql(wanted: dict[str, list[str]], name: str = "features") -> str:
    """CTEs ending in ``features`` with ``<signal>__<feature>`` columns."""
    ewma = [s for s, fs in wanted.items() if any(f in ("ewma", "ewma_gap_abs") for f in fs)]
    source, ctes = "numbered", SEGMENTS_SQL
    for s in ewma:
        ctes += f""",
obs_{s} AS (
  SELECT asset_id, us, segment_id, row_idx, list({{'p': row_idx, 'v': {s}}}) OVER (
      PARTITION BY asset_id, segment_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS seen
  FROM numbered
),
ewma_{s} AS (
  SELECT asset_id, us, list_reduce(list_filter(seen, lambda o: o.v IS NOT NULL), lambda a, o:
      {{'p': o.p, 'v': (pow(0.875e0, o.p - a.p) * a.v + 0.125e0 * o.v) / (pow(0.875e0, o.p - a.p) + 0.125e0)}}).v AS {s}__ewma
  FROM obs_{s} WHERE len(list_filter(seen, lambda o: o.v IS NOT NULL)) > 0
),
with_{s} AS (
  SELECT {source}.*, e.{s}__ewma, abs({source}.{s} - e.{s}__ewma) AS {s}__ewma_gap_abs
  FROM {source} LEFT JOIN ewma_{s} e ON {source}.asset_id = e.asset_id AND {source}.us = e.us
)"""
        source = f"with_{s}"
    columns = [f"{feature_sql(s, f)} AS {s}__{f}" for s, fs in wanted.items() for f in fs if not f.startswith("ewma")]
    listed = "".join(f", {c}" for c in columns)
    return ctes + f""",
{name} AS (SELECT *{listed} FROM {source})"""
