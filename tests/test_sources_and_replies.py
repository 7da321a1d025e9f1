"""Raw rows, flow formulas, serving answers and reply parsing on the acceptance cases."""

import pytest
from pyspark.sql import functions as F

from plantpulse.config import FlowParameters
from plantpulse.functions import replies as P
from plantpulse.functions.columns import ambient_columns, flow_columns
from plantpulse.operators import cleaning, serving
from plantpulse.sources import telemetry
from plantpulse.sources.rules import builtin_rules

from .helpers import irregular, minutes, to_spark


def test_export_headers_and_values(spark):
    raw = spark.createDataFrame([(1, "09/04/2026 16:30:51", "B", "0", "True", "7,15", "6,9")],
                                "asset_id bigint, TimeStamp string, dsTurno string, Status string, st_plc string, `7A1_PV_PRES_SISTEMA_BAR` string, `X9_PV_POSIÇÃO_ALIVIO%` string")
    row = cleaning.clean_readings(telemetry.normalise_columns(raw), order=("asset_id",)).first()
    assert str(row.ts) == "2026-04-09 16:30:51" and row.pv_pres_sistema_bar == 7.15 and row.st_plc is True and row.status == 0 and row.ds_turno == "B"
    assert row.pv_pos_alivio_pct == 6.9 and row.mode_key == "DESCONHECIDO|DESCONHECIDO" and row.pv_corr_motor_a is None


@pytest.mark.parametrize("text, expected", [
    ("09/04/2026 16:30:51", "2026-04-09 16:30:51"), ("2026-04-09 16:30:51", "2026-04-09 16:30:51"), (" 04/09/2026 16:30:51", "2026-09-04 16:30:51"),
    ("2026-04-09 16:30:51.123", "2026-04-09 16:30:51.123000"), ("12/31/2026 10:00:00", "2026-12-31 10:00:00"), ("sem data", "None"), ("", "None")])
def test_timestamp_layouts(spark, text, expected):
    assert str(spark.createDataFrame([(text,)], "t string").select(cleaning.parse_timestamp(F.col("t"))).first()[0]) == expected


def test_flow_formulas(spark):
    one = spark.range(1)
    p = FlowParameters()
    ambient = one.select(*[c.alias(n) for n, c in ambient_columns(F.lit(90.0), F.lit(3.7831), F.lit(101.325), F.lit(28.0)).items()]).first()
    assert (round(ambient.vapor_kpa, 5), round(ambient.dry_air_kpa, 5), round(ambient.normal_factor, 5)) == (3.40479, 97.92021, 0.87654)

    def flow(current, parameters=p):
        return one.select(*[c.alias(n) for n, c in flow_columns(F.lit(current).cast("double"), parameters).items()]).first()

    assert flow(200.0).qn_m3h == 12000.0 and flow(-5.0).qn_m3h == 0.0 and round(flow(180.0).qa_m3h, 2) == 13689.57
    assert flow(144.0).q_perda_m3h == pytest.approx(2400.0) and flow(144.0).q_utilizacao_pct == pytest.approx(80.0)
    assert flow(None).qn_m3h is None and flow(100.0, FlowParameters(nominal_current=0.0)).qn_m3h is None


def test_trend_limits_targets_and_catalogue(spark):
    frame = to_spark(spark, minutes({"pv_pres_sistema_bar": [6.5, 6.9], "sp_pres_sistema_bar": [6.6, 6.7], "pv_temp_oleo_lubrificacao_c": [48.0, 49.0]}))
    rules = builtin_rules(spark)
    points = serving.trend_series(frame, ["pv_pres_sistema_bar"], rules)
    assert {(r.lower_limit, r.upper_limit) for r in points.collect()} == {(5.0, 7.8)}
    summary = serving.trend_summary(points).first()
    assert summary.target_current == 6.7 and summary.latest == 6.9 and summary.delta == pytest.approx(0.4) and summary.points == 2
    both = serving.trend_series(frame, ["pv_pres_sistema_bar", "pv_temp_oleo_lubrificacao_c", " "], rules)
    assert {(r.signal, r.correlation_mode) for r in both.collect()} == {("pv_pres_sistema_bar", "normalized"), ("pv_temp_oleo_lubrificacao_c", "normalized")}
    none = spark.createDataFrame([], "asset_id bigint, signal string")
    catalogue = serving.signal_catalogue(frame, none, rules)
    items = {r.signal: r for r in catalogue.collect()}
    assert items["pv_pres_sistema_bar"].target_signal == "sp_pres_sistema_bar" and items["sp_pres_sistema_bar"].is_setpoint
    assert serving.default_signal(catalogue).first().default_signal == "pv_pres_sistema_bar"
    assert serving.signal_catalogue(frame, none, rules, text="OLEO").count() == 1


def test_coverage_of_nothing_is_one_row(spark):
    empty = spark.createDataFrame([], "asset_id bigint, us bigint")
    row = serving.service_coverage(empty, spark.createDataFrame([], "is_active boolean")).first()
    assert row.status == "waiting_for_data" and row.history_rows == 0 and row.active_alerts == 0


@pytest.mark.parametrize("n, m", [(1, 5), (5, 5), (6, 5), (101, 7), (250, 60), (37, 1), (40, 39)])
def test_thinning_is_even(spark, n, m):
    import numpy as np

    frame = irregular(n, n, assets=1).sort_values("us").reset_index(drop=True)
    found = sorted(r.us for r in serving.thinned(to_spark(spark, frame), m, ("asset_id",)).collect())
    keep = range(n) if n <= m else sorted(set(np.linspace(0, n - 1, num=m, dtype=int)))
    assert found == [frame["us"][i] for i in keep]


def test_empty_window_and_increment(spark):
    frame = irregular(3, 100)
    rows = to_spark(spark, frame)
    newest = frame.groupby("asset_id")["us"].max()
    back = telemetry.window_or_newest(rows, int(newest.max()), fallback=4)
    silent = newest.idxmin()
    assert back.where(f"asset_id = {silent}").count() == 4 and back.where(f"asset_id <> {silent}").count() == 1
    marks = telemetry.high_water_marks(rows.where("asset_id = 0"))
    assert telemetry.after_mark(rows, marks).count() == (frame["asset_id"] == 1).sum()


def _parse(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(P.parse_reply(F.col("t")).alias("p"), P.reply_kind(F.col("t")).alias("k")).first()


def test_fenced_reply(spark):
    row = _parse(spark, '```json\n{\n  "summary": "Vibracao subindo de forma sustentada.",\n  "insights": ["A tendencia merece acompanhamento."],\n  "confidence": 0.62,\n'
                        '  "hypotheses": [{"causa": "inicio_de_desbalanceamento", "confianca": 0.55, "racional": "slope positivo"}],\n  "recommended_actions": ["Comparar vibracao entre estagios."]\n}\n```')
    assert row.k == "whole" and row.p.summary == "Vibracao subindo de forma sustentada." and row.p.hypotheses[0].causa == "inicio_de_desbalanceamento"
    assert row.p.recommended_actions == ["Comparar vibracao entre estagios."] and row.p.confidence == 0.62


def test_broken_replies(spark):
    row = _parse(spark, '{"summary": "Analise iniciada",\n "insights": ["texto sem fechar')
    assert row.k == "salvaged" and row.p.summary == "Analise iniciada." and row.p.confidence == 0.45 and row.p.observations == [P.PARTIAL_NOTE] and row.p.false_positive_risk == "medium"
    row = _parse(spark, '{"summary": "Corrente do motor acima do normal, mas sem confirmacao de causa",\n"insights": ["Comparar corrente com pressao de descarga"],\n"confidence": 0.61')
    assert row.p.summary == "Corrente do motor acima do normal, mas sem confirmacao de causa." and row.p.confidence == 0.61
    assert row.p.insights == ["Comparar corrente com pressao de descarga"]
    row = _parse(spark, "apenas  texto\nlivre")
    assert row.k == "plain" and row.p.summary == "apenas texto livre" and row.p.confidence == 0.35
    assert _parse(spark, "").p.summary == P.NOTHING_USABLE
