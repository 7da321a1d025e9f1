"""Alert and forecast rules as plain rows (fixed values), and the schemas they are read with."""

from __future__ import annotations

from .signals import NORMAL_MODE

# --- fixed values -----------------------------------------------------------------------------------------

SEVERITY_WEIGHTS = {"low": 20.0, "medium": 45.0, "high": 75.0, "critical": 95.0}
UNKNOWN_SEVERITY_WEIGHT = 10.0
EXTRA_ALERT_POINTS = 8.0

# threshold rules: (rule_id, signal, subsystem, condition, threshold, min_value, max_value, severity, title, message)
# condition "between" fires when the value leaves [min_value, max_value]
FIXED_RULES = [
    ("rede_pressao_alta", "pv_pres_sistema_bar", "ar_processo", "gt", 6.9, None, None, "medium",
     "Pressao de ar comprimido acima do esperado",
     "A pressao da rede ultrapassou o patamar de referencia operacional."),
    ("pressao_sistema_fora_faixa", "pv_pres_sistema_bar", "ar_processo", "between", None, 5.0, 7.8, "high",
     "Pressao do sistema fora da faixa operacional",
     "A pressao do sistema saiu da faixa esperada para operacao carregada."),
    ("corrente_motor_alta", "pv_corr_motor_a", "motor", "gt", 185.0, None, None, "medium",
     "Corrente do motor acima do esperado",
     "A corrente do motor excedeu o limite de referencia."),
    ("temperatura_ar_estagio_3_alta", "pv_temp_ar_estagio_3_c", "ar_processo", "gt", 54.0, None, None, "medium",
     "Temperatura do ar do 3o estagio alta",
     "A temperatura do ar no 3o estagio ultrapassou a referencia."),
    ("vibracao_estagio_1_alta", "pv_vib_estagio_1_mils", "vibracao", "gt", 1.3, None, None, "high",
     "Vibracao alta no 1o estagio", "A vibracao do 1o estagio passou da faixa segura."),
    ("vibracao_estagio_2_alta", "pv_vib_estagio_2_mils", "vibracao", "gt", 1.3, None, None, "high",
     "Vibracao alta no 2o estagio", "A vibracao do 2o estagio passou da faixa segura."),
    ("vibracao_estagio_3_alta", "pv_vib_estagio_3_mils", "vibracao", "gt", 1.3, None, None, "high",
     "Vibracao alta no 3o estagio", "A vibracao do 3o estagio passou da faixa segura."),
    ("pressao_oleo_fora_faixa", "pv_pres_oleo_bar", "lubrificacao", "between", None, 6.89, 12.0, "high",
     "Pressao do oleo fora da faixa", "A pressao do oleo saiu da faixa operacional esperada."),
    ("delta_filtro_oleo_alto", "delta_filtro_oleo_bar", "lubrificacao", "gt", 2.7, None, None, "medium",
     "Diferencial do filtro de oleo elevado",
     "O diferencial calculado antes e depois do filtro de oleo aumentou acima do limite."),
    ("temperatura_oleo_fora_faixa", "pv_temp_oleo_lubrificacao_c", "lubrificacao", "between", None, 25.0, 57.0,
     "medium", "Temperatura do oleo fora da faixa", "A temperatura do oleo fugiu da faixa de referencia."),
    ("vacuo_caixa_engr_fora_faixa", "pv_pres_vacuo_cx_engran_inh2o", "lubrificacao", "between", None, 8.0, 12.0,
     "high", "Vacuo da caixa de engrenagem fora da faixa",
     "Leitura fora da referencia. Validar unidade, escala ou sinal de engenharia antes de concluir falha de processo."),
    ("temp_estator_fase_a_alta", "pv_temp_fase_a_do_estator_c", "motor", "gt", 166.0, None, None, "high",
     "Temperatura do estator fase A elevada", "A temperatura da fase A do estator ultrapassou o limite."),
    ("temp_estator_fase_b_alta", "pv_temp_fase_b_do_estator_c", "motor", "gt", 166.0, None, None, "high",
     "Temperatura do estator fase B elevada", "A temperatura da fase B do estator ultrapassou o limite."),
    ("temp_estator_fase_c_alta", "pv_temp_fase_c_do_estator_c", "motor", "gt", 166.0, None, None, "high",
     "Temperatura do estator fase C elevada", "A temperatura da fase C do estator ultrapassou o limite."),
    ("temp_rolamento_dianteiro_alta", "pv_temp_rolamento_dianteiro_motor", "motor", "gt", 85.0, None, None, "medium",
     "Temperatura do rolamento dianteiro elevada",
     "A temperatura do rolamento dianteiro do motor ultrapassou a referencia."),
]

# feature rules: (rule_id, signal, subsystem, feature, condition, threshold, severity, title, message)
TREND_RULES = [
    ("oleo_aquecendo_15m", "pv_temp_oleo_lubrificacao_c", "lubrificacao", "slope_15m", "gt", 0.15, "medium",
     "Oleo subindo de forma anormal",
     "A temperatura do oleo mostra uma subida sustentada e fora do comportamento recente."),
    ("vibracao_max_em_alta", "pv_vib_max_mils", "vibracao", "zscore_1h", "gt", 2.5, "medium",
     "Vibracao fora do comportamento normal",
     "A vibracao maxima saiu do comportamento recente esperado e merece acompanhamento."),
    ("corrente_motor_subida_1h", "pv_corr_motor_a", "motor", "slope_1h", "gt", 0.05, "low",
     "Corrente do motor subindo",
     "A corrente do motor vem subindo de forma sustentada na ultima hora."),
    ("pressao_descarga_desvio_ewma", "pv_pres_descarga_bar", "ar_processo", "ewma_gap_abs", "gt", 0.6, "low",
     "Pressao de descarga diferente do comportamento recente",
     "A pressao de descarga se afastou do comportamento recente de forma relevante."),
]

# anomaly rules: (rule_id, signal, subsystem, type, severity, title, message)
ANOMALY_RULES = [
    ("temperatura_estagio_3_zerada", "pv_temp_ar_estagio_3_c", "ar_processo", "zero_abnormal", "medium",
     "Temperatura do 3o estagio zerada",
     "Valor zerado recorrente para uma variavel que normalmente deveria variar."),
    ("vacuo_possivel_inconsistencia", "pv_pres_vacuo_cx_engran_inh2o", "lubrificacao", "engineering_hint", "medium",
     "Possivel inconsistencia de engenharia no vacuo",
     "Leitura muito distante da regra esperada. Validar unidade, escala ou sinal antes de acionar manutencao."),
]

# forecast rules: (signal, subsystem, label, direction, threshold, criticality, lookback_points, horizon_minutes,
#                  trip_minutes, min_slope_per_hour, min_current_ratio, trip_related)
FORECAST_RULES = [
    ("pv_vib_estagio_1_mils", "vibracao", "Vibracao 1o estagio", "up", 1.3, "critica", 24, 240, 45, 0.06, 0.55, True),
    ("pv_vib_estagio_2_mils", "vibracao", "Vibracao 2o estagio", "up", 1.3, "critica", 24, 240, 45, 0.06, 0.55, True),
    ("pv_vib_estagio_3_mils", "vibracao", "Vibracao 3o estagio", "up", 1.3, "critica", 24, 240, 45, 0.06, 0.55, True),
    ("pv_temp_oleo_lubrificacao_c", "lubrificacao", "Temperatura do oleo", "up", 57.0, "alta", 24, 240, 60, 1.2, 0.82, False),
    ("pv_corr_motor_a", "motor", "Corrente do motor", "up", 185.0, "alta", 24, 180, 45, 6.0, 0.8, True),
    ("pv_temp_fase_a_do_estator_c", "motor", "Temperatura do estator fase A", "up", 166.0, "alta", 24, 300, 60, 2.0, 0.75, True),
    ("pv_temp_fase_b_do_estator_c", "motor", "Temperatura do estator fase B", "up", 166.0, "alta", 24, 300, 60, 2.0, 0.75, True),
    ("pv_temp_fase_c_do_estator_c", "motor", "Temperatura do estator fase C", "up", 166.0, "alta", 24, 300, 60, 2.0, 0.75, True),
    ("pv_temp_rolamento_dianteiro_motor", "motor", "Temperatura do rolamento dianteiro", "up", 85.0, "critica", 24, 240, 45, 1.5, 0.75, True),
    ("pv_pres_descarga_bar", "ar_processo", "Pressao de descarga", "up", 7.8, "alta", 24, 180, 45, 0.2, 0.85, False),
    ("pv_pres_sistema_bar", "ar_processo", "Pressao do sistema", "up", 6.9, "alta", 24, 180, 45, 0.15, 0.85, False),
]

# texts of the guardrail that lets a feature rule pass
FEATURE_LABELS = {
    "slope_15m": "ritmo de subida/queda nos ultimos 15 min",
    "slope_1h": "ritmo de subida/queda na ultima hora",
    "zscore_1h": "distancia do comportamento normal na ultima hora",
    "ewma_gap_abs": "distancia do comportamento recente",
}
REASON_RISING = "subida sustentada acima do comportamento recente"
REASON_FALLING = "queda sustentada abaixo do comportamento recente"
REASON_OUTLIER = "valor fora do comportamento normal recente"
REASON_DRIFT = "desvio relevante em relacao ao comportamento recente"
REFERENCE_HOUR = "media da ultima hora"
REFERENCE_RECENT = "referencia recente"
STUCK_TITLE = "Possivel sensor travado: "
STUCK_MESSAGE = "Possivel sensor travado por repeticao persistente do mesmo valor."
STUCK_THRESHOLD = "variacao esperada > 0"

# --- end of fixed values ----------------------------------------------------------------------------------

FIXED_RULE_COLUMNS = ["rule_id", "signal", "subsystem", "condition", "threshold", "min_value", "max_value",
                      "severity", "title", "message"]
TREND_RULE_COLUMNS = ["rule_id", "signal", "subsystem", "feature", "condition", "threshold", "severity", "title",
                      "message"]
ANOMALY_RULE_COLUMNS = ["rule_id", "signal", "subsystem", "type", "severity", "title", "message"]
FORECAST_RULE_COLUMNS = ["signal", "subsystem", "label", "direction", "threshold", "criticality", "lookback_points",
                         "horizon_minutes", "trip_minutes", "min_slope_per_hour", "min_current_ratio", "trip_related"]

#: one schema holds the three JSON rule lists; absent keys read as NULL
RULE_SCHEMA = (
    "rule_id string, signal string, subsystem string, feature string, type string, condition string, "
    "threshold double, min_value double, max_value double, severity string, title string, message string, "
    "allowed_modes array<string>"
)
FORECAST_SCHEMA = (
    "signal string, subsystem string, label string, direction string, threshold double, criticality string, "
    "lookback_points int, horizon_minutes int, trip_minutes int, min_slope_per_hour double, "
    "min_current_ratio double, trip_related boolean"
)


def rule_documents() -> dict[str, list[dict]]:
    """The rule set in the JSON layout that ``sources.rules.read_rules`` accepts."""
    modes = {"allowed_modes": [NORMAL_MODE]}
    document = {
        "fixed_rules": [dict(zip(FIXED_RULE_COLUMNS, row)) | modes for row in FIXED_RULES],
        "trend_rules": [dict(zip(TREND_RULE_COLUMNS, row)) | modes for row in TREND_RULES],
        "anomaly_rules": [dict(zip(ANOMALY_RULE_COLUMNS, row)) for row in ANOMALY_RULES],
    }
    return {
        layer: [{key: value for key, value in rule.items() if value is not None} for rule in rules]
        for layer, rules in document.items()
    }


def forecast_documents() -> list[dict]:
    return [dict(zip(FORECAST_RULE_COLUMNS, row)) for row in FORECAST_RULES]
