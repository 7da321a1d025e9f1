"""Signal catalogue: the fixed dimension data every operator looks signals up in.

The tables below are fixed values. They are small by nature (one row per physical tag), so operators may
turn them into literal DataFrames.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------------------------------

# (subsystem, signal, label, unit)
SIGNALS = [
    ("ar_processo", "sp_pres_sistema_bar", "Setpoint de pressao do sistema", "bar"),
    ("ar_processo", "pv_pres_sistema_bar", "Pressao do sistema", "bar"),
    ("ar_processo", "sp_pres_setpoint_descarga_bar", "Setpoint de pressao de descarga", "bar"),
    ("ar_processo", "pv_pres_descarga_bar", "Pressao de descarga", "bar"),
    ("ar_processo", "pv_temp_ar_estagio_3_c", "Temperatura do ar do 3o estagio", "C"),
    ("ar_processo", "pv_pos_abert_valv_admissao_pct", "Abertura da valvula de admissao", "%"),
    ("ar_processo", "pv_pos_valv_bypass_pct", "Posicao da valvula de bypass", "%"),
    ("ar_processo", "pv_pos_alivio_pct", "Posicao de alivio", "%"),
    ("ar_processo", "qn_m3h", "Qn - vazao efetiva estimada", "Nm3/h"),
    ("ar_processo", "q_perda_m3h", "Perda estimada de vazao", "Nm3/h"),
    ("ar_processo", "q_utilizacao_pct", "Utilizacao da capacidade", "%"),
    ("ar_processo", "qa_m3h", "Qa - volume equivalente na succao", "m3/h"),
    ("lubrificacao", "pv_pres_oleo_antes_filtro_bar", "Pressao de oleo antes do filtro", "bar"),
    ("lubrificacao", "pv_pres_oleo_bar", "Pressao de oleo", "bar"),
    ("lubrificacao", "pv_temp_oleo_lubrificacao_c", "Temperatura do oleo", "C"),
    ("lubrificacao", "pv_niv_interruptor_oleo_bar", "Nivel do interruptor de oleo", "estado"),
    ("lubrificacao", "pv_pres_vacuo_cx_engran_inh2o", "Vacuo da caixa de engrenagem", "inH2O"),
    ("lubrificacao", "delta_filtro_oleo_bar", "Diferencial do filtro de oleo", "bar"),
    ("vibracao", "pv_vib_estagio_1_mils", "Vibracao 1o estagio", "mils"),
    ("vibracao", "pv_vib_estagio_2_mils", "Vibracao 2o estagio", "mils"),
    ("vibracao", "pv_vib_estagio_3_mils", "Vibracao 3o estagio", "mils"),
    ("vibracao", "pv_vib_max_mils", "Vibracao maxima", "mils"),
    ("motor", "pv_temp_fase_a_do_estator_c", "Temperatura do estator fase A", "C"),
    ("motor", "pv_temp_fase_b_do_estator_c", "Temperatura do estator fase B", "C"),
    ("motor", "pv_temp_fase_c_do_estator_c", "Temperatura do estator fase C", "C"),
    ("motor", "pv_temp_rolamento_dianteiro_motor", "Temperatura do rolamento dianteiro", "C"),
    ("motor", "pv_corr_motor_a", "Corrente do motor", "A"),
    ("motor", "pv_temp_estator_max_c", "Temperatura maxima do estator", "C"),
    ("operacao", "st_plc", "Status PLC", None),
    ("operacao", "st_oper", "Estado operacional", None),
    ("operacao", "st_carga_oper", "Estado de carga", None),
    ("operacao", "pv_hor_operacao", "Horas de operacao", "h"),
    ("operacao", "pv_hor_carregada", "Horas carregadas", "h"),
    ("operacao", "pv_num_partidas", "Numero de partidas", "contagem"),
    ("operacao", "status", "Status geral", None),
]

# signals that carry a state rather than a measurement
STATE_SIGNALS = ["st_oper", "st_carga_oper", "status", "st_plc"]

# quantities computed from other columns
DERIVED_SIGNALS = [
    "delta_filtro_oleo_bar",
    "pv_vib_max_mils",
    "pv_temp_estator_max_c",
    "qn_m3h",
    "q_perda_m3h",
    "q_utilizacao_pct",
    "qa_m3h",
]

# live setpoint tag of a controlled variable
SETPOINT_OF = {
    "pv_pres_sistema_bar": "sp_pres_sistema_bar",
    "pv_pres_descarga_bar": "sp_pres_setpoint_descarga_bar",
}

# default signal per subsystem, in order of preference
DEFAULT_SIGNALS = [
    ("ar_processo", "pv_pres_sistema_bar"),
    ("lubrificacao", "pv_temp_oleo_lubrificacao_c"),
    ("vibracao", "pv_vib_max_mils"),
    ("motor", "pv_corr_motor_a"),
    ("operacao", "pv_hor_operacao"),
]

# a run of zeros is abnormal for these
ZERO_ABNORMAL = [
    "pv_temp_ar_estagio_3_c",
    "pv_hor_operacao",
    "pv_hor_carregada",
    "pv_num_partidas",
]

# a constant reading is suspicious for these
STUCK_CANDIDATES = [
    "pv_pres_sistema_bar",
    "pv_pres_descarga_bar",
    "pv_pres_oleo_antes_filtro_bar",
    "pv_pres_oleo_bar",
    "pv_temp_oleo_lubrificacao_c",
    "pv_vib_estagio_1_mils",
    "pv_vib_estagio_2_mils",
    "pv_vib_estagio_3_mils",
    "pv_temp_ar_estagio_3_c",
    "pv_pres_vacuo_cx_engran_inh2o",
    "pv_temp_fase_a_do_estator_c",
    "pv_temp_fase_b_do_estator_c",
    "pv_temp_fase_c_do_estator_c",
    "pv_temp_rolamento_dianteiro_motor",
    "pv_corr_motor_a",
]

# (signal, lowest plausible, highest plausible)
PLAUSIBLE_RANGES = [
    ("pv_pres_sistema_bar", 0.0, 12.0),
    ("pv_pres_descarga_bar", 0.0, 15.0),
    ("pv_pres_oleo_antes_filtro_bar", 0.0, 20.0),
    ("pv_pres_oleo_bar", 0.0, 20.0),
    ("pv_temp_oleo_lubrificacao_c", -5.0, 120.0),
    ("pv_vib_estagio_1_mils", 0.0, 10.0),
    ("pv_vib_estagio_2_mils", 0.0, 10.0),
    ("pv_vib_estagio_3_mils", 0.0, 10.0),
    ("pv_temp_ar_estagio_3_c", 0.0, 150.0),
    ("pv_pres_vacuo_cx_engran_inh2o", -50.0, 300.0),
    ("pv_temp_fase_a_do_estator_c", 0.0, 220.0),
    ("pv_temp_fase_b_do_estator_c", 0.0, 220.0),
    ("pv_temp_fase_c_do_estator_c", 0.0, 220.0),
    ("pv_temp_rolamento_dianteiro_motor", 0.0, 150.0),
    ("pv_corr_motor_a", 0.0, 400.0),
    ("pv_pos_abert_valv_admissao_pct", 0.0, 100.0),
    ("pv_pos_valv_bypass_pct", 0.0, 100.0),
    ("pv_pos_alivio_pct", 0.0, 100.0),
]

CALIBRATION_HINTS = {
    "pv_pres_vacuo_cx_engran_inh2o": "Valor fora da faixa operacional esperada. Conferir unidade, sinal e escala de engenharia do transmissor.",
}

RUNNING = "EM FUNCIONAMENTO"
LOADED = "CARREGADO"
UNKNOWN_STATE = "DESCONHECIDO"
TRANSITION_STATES = ["PARTINDO", "PARANDO", "DESACELERANDO", "INICIALIZANDO PARTIDA"]
LOW_DEMAND_STATES = ["DESCARREGANDO", "SEM CARGA"]

# raw export column -> column name, for columns that are not plant tags
EXPORT_COLUMNS = {
    "Id": "id",
    "TimeStamp": "timestamp",
    "Timestamp": "timestamp",
    "Hora": "hora",
    "Data": "data",
    "dsTurno": "ds_turno",
    "Status": "status",
    "stIntegracao": "st_integracao",
    "dtIntegracao": "dt_integracao",
    "dsErro": "ds_erro",
    "stPontoDeControle": "st_ponto_de_controle",
}

# plant tags whose column name is not simply the tag in lower case
IRREGULAR_TAGS = {
    "PV_POS_ABERT_VALV_ADMISSAO_%": "pv_pos_abert_valv_admissao_pct",
    "PV_POS_VALV_BYPASS_%": "pv_pos_valv_bypass_pct",
    "PV_POSIÇÃO_ALIVIO%": "pv_pos_alivio_pct",
    "PV_POSICAO_ALIVIO%": "pv_pos_alivio_pct",
}

# words that count as "on" in a PLC status column
TRUE_WORDS = ["1", "true", "sim", "yes"]

TEXT_COLUMNS = ["hora", "data", "ds_turno", "st_oper", "st_carga_oper", "ds_erro", "st_ponto_de_controle"]

# --- end of fixed values ----------------------------------------------------------------------------------

NORMAL_MODE = f"{RUNNING}|{LOADED}"
SUBSYSTEMS = list(dict.fromkeys(row[0] for row in SIGNALS))
SUBSYSTEM_OF = {signal: subsystem for subsystem, signal, _label, _unit in SIGNALS}
LABEL_OF = {signal: label for _subsystem, signal, label, _unit in SIGNALS}
UNIT_OF = {signal: unit for _subsystem, signal, _label, unit in SIGNALS}
NUMERIC_SIGNALS = sorted(signal for signal in SUBSYSTEM_OF if signal not in STATE_SIGNALS)
MEASURED_SIGNALS = [signal for signal in NUMERIC_SIGNALS if signal not in DERIVED_SIGNALS]
