"""Root-cause ranking (2.G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import matrix as M
from ..catalog import signals as S
from ..operators import prescribe
from . import dataset as D
from .alerts import EPISODES, TREND_WANTED, text
from .common import query
from .tables import all_episodes, features, flags

_PLAN = prescribe.flag_feature_plan()
_V = prescribe.VIBRATION
_A, _B, _C = prescribe.STATOR.values()


def _near(s: str, floor: str) -> str:
    return f"abs({s} - {s}__ma_1h) <= greatest(abs({s}__ma_1h) * 0.05e0, {floor})"


def _only(n: int) -> str:
    return f"{_V[n]} > 1.3 AND " + " AND ".join(f"({v} IS NULL OR {v} <= 1.3)" for i, v in enumerate(_V) if i != n)


def _dominant(p: str, q: str, o: str) -> str:
    return f"{p} - greatest({q}, {o}) > 10 AND {q} IS NOT NULL AND {o} IS NOT NULL"


def _still(s: str) -> str:
    limit = f"greatest(abs({s}) * 0.001e0, 0.01e0)"
    return f"({s}__std_1h <= {limit} / 2 AND {s}__max_1h - {s}__min_1h <= {limit} AND {s} IS NOT NULL)"


_COR, _OIL, _AIR, _VAC = "pv_corr_motor_a", "pv_temp_oleo_lubrificacao_c", "pv_temp_ar_estagio_3_c", "pv_pres_vacuo_cx_engran_inh2o"
_NEARS = [f"({_near(s, '0.03e0')})" for s in [*_V, "pv_vib_max_mils"]]
FLAGS = {
    "pv_corr_motor_a_alta": f"{_COR} > 180",
    "pv_corr_motor_a_estavel": _near(_COR, "0.05e0"),
    "vibracao_alta": " OR ".join(f"coalesce({v} > 1.3, false)" for v in _V),
    "vibracao_estavel": f"({' OR '.join(f'{n} IS NOT NULL' for n in _NEARS)}) AND {' AND '.join(f'coalesce({n}, true)' for n in _NEARS)}",
    "pv_temp_oleo_lubrificacao_c_alta": f"{_OIL} > 54",
    "oleo_estavel": _near(_OIL, "0.05e0"),
    "delta_descarga_sistema_alto": "pv_pres_descarga_bar - pv_pres_sistema_bar > 0.7",
    "delta_filtro_oleo_relevante": "delta_filtro_oleo_bar > 2.0",
    "bypass_anormal": "pv_pos_valv_bypass_pct > 20",
    "admissao_anormal": "pv_pos_abert_valv_admissao_pct > 85",
    "alivio_anormal": "pv_pos_alivio_pct > 20",
    "temperatura_estator_alta": f"{_A} > 130 OR {_B} > 130 OR {_C} > 130",
    "assimetria_estator": f"({_dominant(_A, _B, _C)}) OR ({_dominant(_B, _A, _C)}) OR ({_dominant(_C, _A, _B)})",
    "fase_a_assimetrica": _dominant(_A, _B, _C),
    "fase_b_assimetrica": _dominant(_B, _A, _C),
    "fase_c_assimetrica": _dominant(_C, _A, _B),
    "fases_estator_altas_sem_assimetria": f"{_A} > 130 AND {_B} > 130 AND {_C} > 130 AND NOT (({_dominant(_A, _B, _C)}) OR ({_dominant(_B, _A, _C)}) OR ({_dominant(_C, _A, _B)}))",
    "rolamento_motor_alto": "pv_temp_rolamento_dianteiro_motor > 90",
    "temp_ar_estagio_3_alta": f"{_AIR} > 54",
    "temp_ar_estagio_3_zerada": f"{_AIR} = 0 AND ({_AIR}__std_1h IS NULL OR {_AIR}__std_1h < 0.01 OR {_AIR}__max_1h = 0)",
    "vacuo_cx_engran_inconsistente": f"{_VAC} < 2 OR {_VAC} > 20",
    "nivel_oleo_estado_anormal": "pv_niv_interruptor_oleo_bar <> 1 AND (coalesce(st_oper = 'EM FUNCIONAMENTO', false) OR coalesce(st_carga_oper = 'CARREGADO', false))",
    "modo_transicao": "st_oper IN ('PARTINDO', 'PARANDO', 'DESACELERANDO', 'INICIALIZANDO PARTIDA')",
    "modo_funcionamento_normal": "st_oper = 'EM FUNCIONAMENTO'",
    "modo_carregado": "st_carga_oper = 'CARREGADO'",
    "modo_baixa_demanda": "st_carga_oper IN ('DESCARREGANDO', 'SEM CARGA')",
    "somente_estagio_1_alto": _only(0),
    "somente_estagio_2_alto": _only(1),
    "somente_estagio_3_alto": _only(2),
    "estagio_2_mais_critico": f"{_V[1]} > 1.3 AND {_V[1]} - {_V[0]} > 0.15 AND {_V[1]} - {_V[2]} > 0.15",
    "pressao_sistema_baixa": "pv_pres_sistema_bar < sp_pres_sistema_bar * 0.95e0",
    "pressao_descarga_alta": "pv_pres_descarga_bar > sp_pres_setpoint_descarga_bar + 0.5e0",
    "oscilacao_pressao_sistema": "coalesce(pv_pres_sistema_bar__std_15m > 0.15, false) OR coalesce(pv_pres_sistema_bar__max_15m - pv_pres_sistema_bar__min_15m > 0.4, false)",
    "vibracao_externa_sugerida": f"greatest({', '.join(_V)}) > 1.3 AND {_near(_COR, '0.05e0')} AND {_near(_OIL, '0.05e0')}",
    "pressao_oleo_problematica": "pv_pres_oleo_bar < 6.89 OR pv_pres_oleo_bar > 12 OR pv_pres_oleo_antes_filtro_bar > 12",
}
_B1 = {k: f"coalesce({v}, false)" for k, v in FLAGS.items()}
_DERIVED = {
    "anomalias_lubrificacao_convergentes": "pv_temp_oleo_lubrificacao_c_alta::INT + delta_filtro_oleo_relevante::INT + nivel_oleo_estado_anormal::INT >= 2",
    "instrumentacao_suspeita": " OR ".join(f"coalesce({_still(s)}, false)" for s in prescribe.SUSPECT_SIGNALS) + " OR temp_ar_estagio_3_zerada OR vacuo_cx_engran_inconsistente",
    "sem_convergencia_fisica_relevante": "NOT (pv_corr_motor_a_alta OR vibracao_alta OR pv_temp_oleo_lubrificacao_c_alta OR temperatura_estator_alta OR rolamento_motor_alto OR delta_descarga_sistema_alto OR delta_filtro_oleo_relevante)",
    "modo_principal_diagnostico": "modo_funcionamento_normal AND modo_carregado",
}
_NAMES = sorted([*FLAGS, *_DERIVED])
_KEEP = ", ".join(["asset_id", "us", *prescribe.SUSPECT_SIGNALS, *[f"{s}__{f}" for s in prescribe.SUSPECT_SIGNALS for f in ("std_1h", "min_1h", "max_1h")]])
FLAGS_SQL = f"""flags_1 AS (SELECT {_KEEP}, {', '.join(f'{v} AS {k}' for k, v in _B1.items())} FROM features),
flags_2 AS (SELECT *, {', '.join(f'({v}) AS {k}' for k, v in _DERIVED.items())} FROM flags_1),
flagged AS (SELECT asset_id, us, list_filter([{', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in _NAMES)}], lambda x: x IS NOT NULL) AS flags FROM flags_2)"""

_HYPOTHESES = ", ".join(f"({text(h['signal'])}, {text(h['side'])}, {text(h['cause'])})" for h in M.hypothesis_documents())


def _texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]::VARCHAR[]"


_RULES = ", ".join(
    f"({d['ordinal']}, {_texts(d['applies_to'])}, {_texts(d['when_all'])}, {_texts(d['when_any'])}, {text(d['side'])}::VARCHAR, {d['weight']}, {_texts(d['causes'])}, {text(d['observation'])}::VARCHAR, {text(d['effect'])}::VARCHAR)"
    for d in M.rule_documents())
_ACTIONS = ", ".join(f"({text(s)}, {text(M.PROFILES[s][0])}, {text(M.PROFILES[s][1])}, {_texts(a)})" for s, a in M.ACTIONS.items())
TABLES_SQL = f"""hypotheses(signal, side, cause) AS (VALUES {_HYPOTHESES}),
mrules(ordinal, applies_to, when_all, when_any, side, weight, causes, observation, effect) AS (VALUES {_RULES}),
profiles(signal, matrix_subsystem, criticality, actions) AS (VALUES {_ACTIONS})"""

_UNION = {s: list(dict.fromkeys([*TREND_WANTED.get(s, []), *_PLAN.get(s, [])])) for s in [*TREND_WANTED, *_PLAN]}
ALERTS_SQL = f"""{EPISODES.replace(D.features_sql(TREND_WANTED), D.features_sql(_UNION))}, {FLAGS_SQL}, {TABLES_SQL},
diag AS (SELECT e.asset_id, e.alert_id, e.signal, e.last_seen_us AS us, f.flags FROM episodes e JOIN flagged f ON e.asset_id = f.asset_id AND e.last_seen_us = f.us
  WHERE e.signal IN (SELECT signal FROM profiles)),
fired AS (SELECT d.*, m.* FROM diag d JOIN mrules m ON (len(m.applies_to) = 0 OR list_contains(m.applies_to, d.signal)) AND list_has_all(d.flags, m.when_all)
  AND (len(m.when_any) = 0 OR list_has_any(d.flags, m.when_any))),
scored AS (SELECT d.asset_id, d.alert_id, d.us, d.signal, d.flags, h.side, h.cause,
    1 + coalesce((SELECT sum(weight) FROM fired f WHERE f.asset_id = d.asset_id AND f.alert_id = d.alert_id AND f.us = d.us AND f.side = h.side
      AND (len(f.causes) = 0 OR list_contains(f.causes, h.cause))), 0) AS plain
  FROM diag d JOIN hypotheses h ON d.signal = h.signal),
reduced AS (SELECT *, CASE WHEN list_contains(flags, 'modo_transicao') THEN greatest(1, round_even(plain * 0.7e0, 0))::BIGINT ELSE plain::BIGINT END AS score FROM scored)"""


def diagnosed(spark, sf):
    return prescribe.diagnose_flagged(all_episodes(spark, sf), flags(spark, sf))


@query("g1_context_flags", f"""
WITH {D.features_sql(_PLAN)}, {FLAGS_SQL} SELECT asset_id, us, array_to_string(flags, '|') AS flags FROM flagged""")
def context_flags(spark, sf):
    return prescribe.flag_table(features(spark, sf)).select("asset_id", "us", F.array_join("flags", "|").alias("flags"))


@query("g2_hypothesis_seeding", f"""
WITH {EPISODES}, {TABLES_SQL}
SELECT e.alert_id, h.side, h.cause, count(*) AS alerts FROM episodes e JOIN hypotheses h ON e.signal = h.signal GROUP BY 1, 2, 3""")
def hypothesis_seeding(spark, sf):
    from ..session import literal_table

    seeds = literal_table(spark, M.HYPOTHESIS_SCHEMA, M.hypothesis_documents())
    return all_episodes(spark, sf).join(F.broadcast(seeds), "signal").groupBy("alert_id", "side", "cause").agg(F.count(F.lit(1)).alias("alerts"))


@query("g3_g5_rule_matching", f"WITH {ALERTS_SQL} SELECT ordinal, signal, count(*) AS alerts FROM fired GROUP BY 1, 2")
def rule_matching(spark, sf):
    flags = prescribe.flag_table(features(spark, sf))
    alerts = all_episodes(spark, sf).select("asset_id", "alert_id", "signal", F.col("last_seen_us").alias("us")).join(flags, ["asset_id", "us"])
    return prescribe.matching_rules(alerts).groupBy("ordinal", "signal").agg(F.count(F.lit(1)).alias("alerts"))


@query("g4_g6_hypothesis_scores", f"WITH {ALERTS_SQL} SELECT asset_id, alert_id, us, side, cause, score FROM reduced")
def hypothesis_scores(spark, sf):
    return diagnosed(spark, sf).select("asset_id", "alert_id", "us", F.inline("hypotheses")).select(
        "asset_id", "alert_id", "us", "side", "cause", F.col("score").cast("bigint").alias("score"))


@query("g7_ranked_hypotheses", f"""
WITH {ALERTS_SQL}
SELECT asset_id, alert_id, us, sum(CASE WHEN side = 'interno' THEN score ELSE 0 END)::BIGINT AS score_internal,
  sum(CASE WHEN side = 'periferico' THEN score ELSE 0 END)::BIGINT AS score_peripheral,
  string_agg(cause || ':' || score, '|' ORDER BY score DESC, side, cause DESC) AS ranking FROM reduced GROUP BY 1, 2, 3""")
def ranked_hypotheses(spark, sf):
    ranking = F.array_join(F.transform("hypotheses", lambda h: F.concat_ws(":", h.cause, h.score.cast("string"))), "|")
    return diagnosed(spark, sf).select("asset_id", "alert_id", "us", "score_internal", "score_peripheral", ranking.alias("ranking"))


_HINT = S.CALIBRATION_HINTS["pv_pres_vacuo_cx_engran_inh2o"]


@query("g8_recommended_actions", f"""
WITH {ALERTS_SQL},
instrument AS (SELECT DISTINCT asset_id, alert_id, us FROM fired WHERE effect = 'instruments_first'),
listed AS (SELECT d.asset_id, d.alert_id, d.us, list_filter(list_concat([CASE WHEN list_contains(flags, 'instrumentacao_suspeita') THEN '{M.SUSPICION_ACTION}' END,
    CASE WHEN i.us IS NOT NULL THEN '{M.INSTRUMENT_ACTION}' END], p.actions), lambda x: x IS NOT NULL) AS a
  FROM diag d JOIN profiles p ON d.signal = p.signal LEFT JOIN instrument i ON d.asset_id = i.asset_id AND d.alert_id = i.alert_id AND d.us = i.us)
SELECT asset_id, alert_id, us, array_to_string(a, '|') AS actions FROM listed""")
def recommended_actions(spark, sf):
    return diagnosed(spark, sf).select("asset_id", "alert_id", "us", F.array_join("actions", "|").alias("actions"))


@query("g9_observations", f"""
WITH {ALERTS_SQL},
told AS (
  SELECT asset_id, alert_id, us, ordinal * 10 AS o, observation AS t FROM fired WHERE observation IS NOT NULL
  UNION ALL SELECT asset_id, alert_id, us, ordinal * 10 + 1, '{M.REDUCED_CONFIDENCE_NOTE}' || signal || '.' FROM fired WHERE effect = 'reduce_confidence'
  UNION ALL SELECT asset_id, alert_id, us, 10000, '{M.OUT_OF_CONTEXT_NOTE}' FROM diag WHERE NOT list_contains(flags, 'modo_principal_diagnostico')
  UNION ALL SELECT asset_id, alert_id, us, 10001, '{_HINT}' FROM diag WHERE list_contains(flags, 'instrumentacao_suspeita') AND list_contains(flags, 'vacuo_cx_engran_inconsistente')
  UNION ALL SELECT asset_id, alert_id, us, 10002, '{M.ASYMMETRY_NOTE}' FROM diag WHERE list_contains(flags, 'assimetria_estator')),
uniq AS (SELECT asset_id, alert_id, us, t, min(o) AS o FROM told GROUP BY 1, 2, 3, 4),
joined AS (SELECT asset_id, alert_id, us, string_agg(t, '|' ORDER BY o) AS observations FROM uniq GROUP BY 1, 2, 3)
SELECT d.asset_id, d.alert_id, d.us, coalesce(observations, '') AS observations FROM diag d LEFT JOIN joined j ON d.asset_id = j.asset_id AND d.alert_id = j.alert_id AND d.us = j.us""")
def observations(spark, sf):
    return diagnosed(spark, sf).select("asset_id", "alert_id", "us", F.array_join("observations", "|").alias("observations"))


@query("g10_diagnosis_attached", f"""
WITH {ALERTS_SQL}, r AS (SELECT asset_id, alert_id, us, sum(score)::BIGINT AS total FROM reduced GROUP BY 1, 2, 3)
SELECT e.asset_id, e.alert_id, e.triggered_us, coalesce(total, 0) AS total FROM episodes e LEFT JOIN r ON e.asset_id = r.asset_id AND e.alert_id = r.alert_id AND e.last_seen_us = r.us""")
def diagnosis_attached(spark, sf):
    history = all_episodes(spark, sf)
    attached = prescribe.attach_diagnosis(history, diagnosed(spark, sf))
    total = F.coalesce(F.col("diagnosis.score_internal") + F.col("diagnosis.score_peripheral"), F.lit(0))
    return attached.select("asset_id", "alert_id", "triggered_us", total.alias("total"))
