"""Forecast and root-cause ranking on the acceptance cases."""

import pytest
from pyspark.sql import functions as F

from plantpulse.catalog import signals as S
from plantpulse.config import ForecastParameters
from plantpulse.operators import forecast, prescribe
from plantpulse.operators.features import rolling_features
from plantpulse.registry import QUERIES, tables
from plantpulse.sources.rules import forecast_rules

from .helpers import minutes, to_spark

STEADY = {
    "pv_temp_oleo_lubrificacao_c": 48.0, "pv_corr_motor_a": 172.0, "pv_vib_estagio_1_mils": 0.55, "pv_vib_estagio_2_mils": 0.62,
    "pv_vib_estagio_3_mils": 0.58, "pv_pres_descarga_bar": 7.05, "pv_pres_sistema_bar": 6.65, "pv_temp_fase_a_do_estator_c": 118.0,
    "pv_temp_fase_b_do_estator_c": 117.0, "pv_temp_fase_c_do_estator_c": 116.0, "pv_temp_rolamento_dianteiro_motor": 63.0,
}


def _forecast(spark, values, mode="EM FUNCIONAMENTO|CARREGADO", active=None):
    frame = minutes({s: [v] * len(values) for s, v in STEADY.items()} | {"pv_vib_estagio_2_mils": values}, mode=mode)
    features = rolling_features(to_spark(spark, frame), {s: ["zscore_1h", "ewma_gap_abs"] for s in ("pv_vib_estagio_2_mils",)})
    p = ForecastParameters(min_confidence=0.6, min_r2=0.5)
    measures = forecast.forecast_measures(features, forecast_rules(spark), active, p)
    return forecast.forecast_alerts(forecast.forecast_decision(measures, p))


def test_rising_vibration_is_forecast_unless_it_already_alerts(spark):
    rising = [0.45 + 0.025 * i for i in range(24)]
    rows = _forecast(spark, rising).collect()
    assert [r.signal for r in rows] == ["pv_vib_estagio_2_mils"]
    alert = rows[0]
    assert float(alert.metadata["confidence"]) > 0.6 and alert.metadata["predicted_event"] == "possible_trip" and alert.severity == "critical"
    assert alert.title == "Risco antecipado de trip por tendencia em Vibracao 2o estagio" and alert.threshold == "up 1.3"
    known = spark.createDataFrame([(1, "pv_vib_estagio_2_mils")], "asset_id bigint, signal string")
    assert _forecast(spark, rising, active=known).count() == 0


@pytest.mark.parametrize("values, mode", [([0.55] * 24, "EM FUNCIONAMENTO|CARREGADO"), ([0.45 + 0.03 * i for i in range(24)], "PARTINDO|CARREGADO"),
                                          ([0.45 + 0.025 * i for i in range(23)], "EM FUNCIONAMENTO|CARREGADO")])
def test_flat_transition_and_short_series_are_not_forecast(spark, values, mode):
    assert _forecast(spark, values, mode).count() == 0


def _diagnose(spark, signal, changes):
    base = {
        "pv_temp_oleo_lubrificacao_c": 48.0, "pv_temp_oleo_lubrificacao_c__ma_1h": 48.0, "pv_corr_motor_a": 170.0, "pv_corr_motor_a__ma_1h": 170.0,
        "pv_vib_estagio_1_mils": 0.5, "pv_vib_estagio_1_mils__ma_1h": 0.5, "pv_vib_estagio_2_mils": 0.6, "pv_vib_estagio_2_mils__ma_1h": 0.6,
        "pv_vib_estagio_3_mils": 0.55, "pv_vib_estagio_3_mils__ma_1h": 0.55, "pv_vib_max_mils": 0.6, "pv_vib_max_mils__ma_1h": 0.6,
        "pv_pres_sistema_bar": 7.0, "sp_pres_sistema_bar": 7.0, "pv_pres_descarga_bar": 7.2, "sp_pres_setpoint_descarga_bar": 7.2,
        "pv_pres_oleo_bar": 9.0, "pv_pres_oleo_antes_filtro_bar": 10.0, "delta_filtro_oleo_bar": 1.0, "pv_temp_ar_estagio_3_c": 45.0,
        "pv_temp_ar_estagio_3_c__ma_1h": 45.0, "pv_temp_ar_estagio_3_c__std_1h": 0.4, "pv_temp_ar_estagio_3_c__max_1h": 46.0,
        "pv_pres_vacuo_cx_engran_inh2o": 10.0, "pv_temp_fase_a_do_estator_c": 118.0, "pv_temp_fase_b_do_estator_c": 117.0,
        "pv_temp_fase_c_do_estator_c": 116.0, "pv_temp_rolamento_dianteiro_motor": 63.0, "pv_pos_valv_bypass_pct": 5.0,
        "pv_pos_abert_valv_admissao_pct": 65.0, "pv_pos_alivio_pct": 0.0, "pv_niv_interruptor_oleo_bar": 1.0,
        "pv_pres_sistema_bar__std_15m": 0.05, "pv_pres_sistema_bar__min_15m": 6.9, "pv_pres_sistema_bar__max_15m": 7.2,
    }
    frame = minutes({k: [v] for k, v in (base | changes).items()}, mode=changes.pop("mode", "EM FUNCIONAMENTO|CARREGADO"))
    flags = prescribe.flag_table(to_spark(spark, frame))
    return prescribe.diagnose(flags.withColumns({"alert_id": F.lit("x"), "signal": F.lit(signal)})).first()


def test_hot_oil_with_steady_current_is_peripheral(spark):
    d = _diagnose(spark, "pv_temp_oleo_lubrificacao_c", {"pv_temp_oleo_lubrificacao_c": 60.0, "pv_temp_oleo_lubrificacao_c__ma_1h": 56.0})
    assert d.score_peripheral > d.score_internal and {"pv_corr_motor_a_estavel", "vibracao_estavel"} <= set(d.flags)


def test_stage_2_vibration_with_high_current_and_oil_is_internal(spark):
    d = _diagnose(spark, "pv_vib_estagio_2_mils", {
        "pv_vib_estagio_2_mils": 1.9, "pv_vib_estagio_2_mils__ma_1h": 1.4, "pv_vib_max_mils": 1.9, "pv_vib_max_mils__ma_1h": 1.4, "pv_corr_motor_a": 195.0,
        "pv_corr_motor_a__ma_1h": 186.0, "pv_temp_oleo_lubrificacao_c": 58.0, "pv_temp_oleo_lubrificacao_c__ma_1h": 55.0})
    assert d.score_internal > d.score_peripheral and d.hypotheses[0].side == "interno"


def test_discharge_gap_is_peripheral(spark):
    d = _diagnose(spark, "pv_pres_descarga_bar", {"pv_pres_descarga_bar": 8.6, "sp_pres_setpoint_descarga_bar": 7.0, "pv_pres_sistema_bar": 7.1})
    assert d.score_peripheral > d.score_internal and "delta_descarga_sistema_alto" in d.flags


def test_hot_phase_is_an_asymmetry(spark):
    d = _diagnose(spark, "pv_temp_fase_a_do_estator_c", {"pv_temp_fase_a_do_estator_c": 160.0, "pv_temp_fase_b_do_estator_c": 120.0, "pv_temp_fase_c_do_estator_c": 118.0})
    assert {"assimetria_estator", "fase_a_assimetrica"} <= set(d.flags) and any("assimetria" in o for o in d.observations)


def test_odd_vacuum_points_to_the_sensor(spark):
    d = _diagnose(spark, "pv_pres_vacuo_cx_engran_inh2o", {"pv_pres_vacuo_cx_engran_inh2o": 60.0})
    assert d.hypotheses[0].cause == "erro_de_escala_ou_sensor" and S.CALIBRATION_HINTS["pv_pres_vacuo_cx_engran_inh2o"] in d.observations
    assert d.actions[0].startswith("validar instrumentacao") and d.actions[1].startswith("priorizar validacao")


def test_zero_air_temperature_suspects_instruments(spark):
    zero = {f"pv_temp_ar_estagio_3_c{s}": 0.0 for s in ("", "__ma_1h", "__std_1h", "__max_1h")}
    d = _diagnose(spark, "pv_temp_ar_estagio_3_c", zero)
    assert "temp_ar_estagio_3_zerada" in d.flags and any("instrumentacao" in o for o in d.observations) and "validar sensor da temperatura" in d.actions


def test_transition_reduces_scores_but_never_below_one(spark):
    d = _diagnose(spark, "pv_pres_descarga_bar", {"pv_pres_descarga_bar": 8.6, "pv_pres_sistema_bar": 7.1, "mode": "PARTINDO|CARREGADO"})
    assert {h.cause: h.score for h in d.hypotheses}["secador_restritivo"] == round(7 * 0.7) and min(h.score for h in d.hypotheses) == 1
    assert any("reducao de confianca" in o for o in d.observations)


def test_actions_come_from_stored_flags_not_features(spark, tmp_path, monkeypatch):
    """g8 stored every feature of every signal with the readings; it reads the flags of a reading only."""
    spark.sql("SELECT id AS event_id, timestamp_micros(1704067200000000 + id * 173000000)::timestamp_ntz AS ts, id % 7 AS user_id, 'a' AS event_type, "
              "(id * 37 % 101) * 2.0D AS value, concat('{\"k\": ', id * 13 % 97, '}') AS props FROM range(1500)").write.parquet(f"{tmp_path}/events.parquet")
    written = []
    plain = tables.stored
    monkeypatch.setattr(tables, "_STAGES", {})
    monkeypatch.setattr(tables, "stored", lambda df: written.append(df.columns) or plain(df))
    found = QUERIES["g8_recommended_actions"](spark, str(tmp_path))
    assert ["asset_id", "us", "flags"] in written and not any("__" in c for columns in written for c in columns)
    whole = prescribe.diagnose_alerts(tables.all_episodes(spark, str(tmp_path)), tables.features(spark, str(tmp_path)))
    expected = whole.select("asset_id", "alert_id", "us", F.array_join("actions", "|").alias("actions"))
    rows = sorted(map(tuple, found.collect()))
    assert len(rows) > 100 and rows == sorted(map(tuple, expected.collect()))
