"""Root-cause ranking: context flags of a reading, declarative rules over flags, ranked hypotheses per alert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import matrix as M
from ..catalog import signals as S
from ..config import StuckParameters
from ..session import literal_table
from .quality import stuck_threshold

# --- fixed values: limits of the diagnosis flags (not the alert limits) ---
CURRENT_HIGH = 180.0
VIBRATION_HIGH = 1.3
OIL_HOT = 54.0
DISCHARGE_GAP = 0.7
FILTER_GAP = 2.0
BYPASS_OPEN = 20.0
INTAKE_OPEN = 85.0
RELIEF_OPEN = 20.0
STATOR_HOT = 130.0
PHASE_GAP = 10.0
BEARING_HOT = 90.0
AIR_HOT = 54.0
VACUUM_BAND = (2.0, 20.0)
OIL_PRESSURE_BAND = (6.89, 12.0)
STAGE_2_LEAD = 0.15
SYSTEM_LOW = 5.0
SYSTEM_SHARE = 0.95
DISCHARGE_HIGH = 7.8
DISCHARGE_OVER = 0.5
SWING_STD, SWING_RANGE = 0.15, 0.4
SUSPECT_SIGNALS = [
    "pv_temp_ar_estagio_3_c", "pv_temp_oleo_lubrificacao_c", "pv_pres_oleo_bar", "pv_pres_oleo_antes_filtro_bar",
    "pv_corr_motor_a", "pv_pres_sistema_bar", "pv_pres_descarga_bar", "pv_pres_vacuo_cx_engran_inh2o",
]
# --- end of fixed values ---

VIBRATION = [f"pv_vib_estagio_{stage}_mils" for stage in (1, 2, 3)]
STATOR = {phase: f"pv_temp_fase_{phase}_do_estator_c" for phase in "abc"}


def flag_feature_plan(suspects: list[str] = SUSPECT_SIGNALS) -> dict[str, list[str]]:
    """Features the flags read, in the form ``rolling_features`` takes."""
    plan: dict[str, set[str]] = {}
    for s in ["pv_corr_motor_a", "pv_temp_oleo_lubrificacao_c", *VIBRATION, "pv_vib_max_mils"]:
        plan.setdefault(s, set()).add("ma_1h")
    for s in suspects:
        plan.setdefault(s, set()).update(["std_1h", "min_1h", "max_1h"])
    plan.setdefault("pv_pres_sistema_bar", set()).update(["std_15m", "min_15m", "max_15m"])
    return {s: sorted(features) for s, features in plan.items()}


def _known(condition: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(condition, F.lit(False))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def context_flags(df: DataFrame, stuck: StuckParameters = StuckParameters(), suspects: list[str] = SUSPECT_SIGNALS) -> dict[str, Column]:
    """All flags of a reading as boolean expressions. Missing columns count as missing values."""

    def c(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("double")

    def above(name: str, limit: float) -> Column:
        return _known(c(name) > limit)

    def steady(name: str, floor: float = 0.05) -> Column:
        mean = c(f"{name}__ma_1h")
        return F.abs(c(name) - mean) <= F.greatest(F.abs(mean) * 0.05, F.lit(floor))

    def span(name: str, frame: str) -> Column:
        return c(f"{name}__max_{frame}") - c(f"{name}__min_{frame}")

    v1, v2, v3 = (c(s) for s in VIBRATION)
    phases = {p: c(s) for p, s in STATOR.items()}
    dominant = {
        p: _known(phases[p].isNotNull() & _all([phases[o].isNotNull() for o in phases if o != p])
                  & (phases[p] - F.greatest(*[phases[o] for o in phases if o != p]) > PHASE_GAP))
        for p in phases
    }
    others = {1: (v2, v3), 2: (v1, v3), 3: (v1, v2)}
    stages = {1: v1, 2: v2, 3: v3}
    steadiness = [steady(s, 0.03) for s in [*VIBRATION, "pv_vib_max_mils"]]
    current_steady, oil_steady = _known(steady("pv_corr_motor_a")), _known(steady("pv_temp_oleo_lubrificacao_c"))
    vibration_high = _any([_known(v > VIBRATION_HIGH) for v in stages.values()])
    oil_hot = above("pv_temp_oleo_lubrificacao_c", OIL_HOT)
    filter_gap = F.coalesce(c("delta_filtro_oleo_bar"), c("pv_pres_oleo_antes_filtro_bar") - c("pv_pres_oleo_bar"))
    vacuum, air = c("pv_pres_vacuo_cx_engran_inh2o"), c("pv_temp_ar_estagio_3_c")
    air_zero = _known((air == 0) & (c("pv_temp_ar_estagio_3_c__std_1h").isNull() | (c("pv_temp_ar_estagio_3_c__std_1h") < 0.01)
                                    | _known(c("pv_temp_ar_estagio_3_c__max_1h") == 0)))
    vacuum_odd = _known((vacuum < VACUUM_BAND[0]) | (vacuum > VACUUM_BAND[1]))
    running, loaded = _known(F.trim(F.col("st_oper")) == S.RUNNING), _known(F.trim(F.col("st_carga_oper")) == S.LOADED)
    level = c("pv_niv_interruptor_oleo_bar")
    level_odd = _known(level.isNotNull() & (level != 1) & (running | loaded))
    system, discharge = c("pv_pres_sistema_bar"), c("pv_pres_descarga_bar")
    system_goal, discharge_goal = c(S.SETPOINT_OF["pv_pres_sistema_bar"]), c(S.SETPOINT_OF["pv_pres_descarga_bar"])
    gap_high = _known(discharge - system > DISCHARGE_GAP)
    asymmetric = _any(list(dominant.values()))
    stator_hot = _any([_known(p > STATOR_HOT) for p in phases.values()])
    flags = {
        "pv_corr_motor_a_alta": above("pv_corr_motor_a", CURRENT_HIGH),
        "pv_corr_motor_a_estavel": current_steady,
        "vibracao_alta": vibration_high,
        "vibracao_estavel": _any([s.isNotNull() for s in steadiness]) & _all([F.coalesce(s, F.lit(True)) for s in steadiness]),
        "pv_temp_oleo_lubrificacao_c_alta": oil_hot,
        "oleo_estavel": oil_steady,
        "delta_descarga_sistema_alto": gap_high,
        "delta_filtro_oleo_relevante": _known(filter_gap > FILTER_GAP),
        "bypass_anormal": above("pv_pos_valv_bypass_pct", BYPASS_OPEN),
        "admissao_anormal": above("pv_pos_abert_valv_admissao_pct", INTAKE_OPEN),
        "alivio_anormal": above("pv_pos_alivio_pct", RELIEF_OPEN),
        "temperatura_estator_alta": stator_hot,
        "assimetria_estator": asymmetric,
        **{f"fase_{p}_assimetrica": flag for p, flag in dominant.items()},
        "fases_estator_altas_sem_assimetria": _all([_known(p > STATOR_HOT) for p in phases.values()]) & ~asymmetric,
        "rolamento_motor_alto": above("pv_temp_rolamento_dianteiro_motor", BEARING_HOT),
        "temp_ar_estagio_3_alta": _known(air > AIR_HOT),
        "temp_ar_estagio_3_zerada": air_zero,
        "vacuo_cx_engran_inconsistente": vacuum_odd,
        "nivel_oleo_estado_anormal": level_odd,
        "modo_transicao": _known(F.trim(F.col("st_oper")).isin(S.TRANSITION_STATES)),
        "modo_funcionamento_normal": running,
        "modo_carregado": loaded,
        "modo_baixa_demanda": _known(F.trim(F.col("st_carga_oper")).isin(S.LOW_DEMAND_STATES)),
        **{f"somente_estagio_{n}_alto": _known(stages[n] > VIBRATION_HIGH) & _all([~_known(o > VIBRATION_HIGH) for o in others[n]])
           for n in stages},
        "estagio_2_mais_critico": _known(v2 > VIBRATION_HIGH) & (v1.isNotNull() | v3.isNotNull())
        & _all([F.coalesce(v2 - o > STAGE_2_LEAD, F.lit(True)) for o in (v1, v3)]),
        "pressao_sistema_baixa": _known(F.when(system_goal.isNotNull(), system < system_goal * SYSTEM_SHARE).otherwise(system < SYSTEM_LOW)),
        "pressao_descarga_alta": _known(
            F.when(discharge_goal.isNotNull(), discharge > discharge_goal + DISCHARGE_OVER).otherwise(discharge > DISCHARGE_HIGH)),
        "oscilacao_pressao_sistema": _known(c("pv_pres_sistema_bar__std_15m") > SWING_STD)
        | _known(span("pv_pres_sistema_bar", "15m") > SWING_RANGE),
        "vibracao_externa_sugerida": vibration_high & current_steady & oil_steady,
    }
    lubrication = [oil_hot, flags["delta_filtro_oleo_relevante"], level_odd]
    flags["anomalias_lubrificacao_convergentes"] = sum((f.cast("int") for f in lubrication), F.lit(0)) >= 2
    oil = c("pv_pres_oleo_bar")
    flags["pressao_oleo_problematica"] = (
        _known((oil < OIL_PRESSURE_BAND[0]) | (oil > OIL_PRESSURE_BAND[1])) | above("pv_pres_oleo_antes_filtro_bar", OIL_PRESSURE_BAND[1]))
    still = [
        _known((c(f"{s}__std_1h") <= stuck_threshold(c(s), stuck) / 2.0) & (span(s, "1h") <= stuck_threshold(c(s), stuck)) & c(s).isNotNull())
        for s in suspects
    ]
    flags["instrumentacao_suspeita"] = _any(still) | air_zero | vacuum_odd
    flags["sem_convergencia_fisica_relevante"] = ~_any([
        flags["pv_corr_motor_a_alta"], vibration_high, oil_hot, stator_hot, flags["rolamento_motor_alto"], gap_high,
        flags["delta_filtro_oleo_relevante"]])
    flags["modo_principal_diagnostico"] = running & loaded
    return flags


def flag_table(features: DataFrame, keep: tuple[str, ...] = ("asset_id", "us"), **options) -> DataFrame:
    """One row per reading with the sorted names of its active flags."""
    names = [F.when(flag, F.lit(name)) for name, flag in sorted(context_flags(features, **options).items())]
    return features.select(*keep, F.array_compact(F.array(*names)).alias("flags"))


def matching_rules(flagged: DataFrame) -> DataFrame:
    """Alerts with flags joined to the rules that apply to their signal and hold.

    The rule table is a constant; rules for every signal are listed once per supported signal, so this is an equi-join.
    """
    rules = literal_table(flagged.sparkSession, M.MATRIX_RULE_SCHEMA, M.rules_per_signal())
    return flagged.join(F.broadcast(rules), "signal").where(
        F.forall("when_all", lambda f: F.array_contains("flags", f))
        & ((F.size("when_any") == 0) | F.arrays_overlap("when_any", "flags"))
    )


def diagnose(flagged: DataFrame, keys: tuple[str, ...] = ("asset_id", "alert_id", "us")) -> DataFrame:
    """Ranked hypotheses, side totals, actions and observations per alert.

    ``flagged`` has the keys, ``signal`` and ``flags``. The rule, hypothesis and profile tables are constants, so one
    alert row meets at most a dozen rules and a dozen hypotheses; everything is keyed by the alert and its size is
    bounded by the rule set.
    """
    spark = flagged.sparkSession
    alerts = flagged.select(*keys, "signal", "flags")
    hypotheses = literal_table(spark, M.HYPOTHESIS_SCHEMA, M.hypothesis_documents())
    profiles = literal_table(spark, M.PROFILE_SCHEMA, M.profile_documents())
    fired = matching_rules(alerts).groupBy(*keys, "signal").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "side", "weight", "causes", "observation", "effect"))).alias("_fired"))
    known = alerts.join(F.broadcast(profiles), "signal")
    causes = hypotheses.groupBy("signal").agg(F.collect_list(F.struct("side", "cause")).alias("_causes"))
    joined = (
        known.join(fired, [*keys, "signal"], "left").join(F.broadcast(causes), "signal")
        .withColumn("_fired", F.coalesce("_fired", F.array().cast(fired.schema["_fired"].dataType)))
    )
    transition = F.array_contains("flags", "modo_transicao")

    def scored(h: Column) -> Column:
        weight = F.aggregate(
            F.filter("_fired", lambda r: (r.side == h.side) & ((F.size(r.causes) == 0) | F.array_contains(r.causes, h.cause))),
            F.lit(1), lambda total, r: total + r.weight)
        reduced = F.greatest(F.lit(1), F.bround(weight * M.TRANSITION_FACTOR).cast("int"))
        return F.struct(h.cause.alias("cause"), h.side.alias("side"), F.when(transition, reduced).otherwise(weight).alias("score"))

    def later(a: Column, b: Column) -> Column:
        return (
            F.when(a.score != b.score, F.sign(b.score - a.score).cast("int"))
            .when(a.side != b.side, F.when(a.side == M.INTERNAL, -1).otherwise(1))
            .when(a.cause > b.cause, -1).when(a.cause < b.cause, 1).otherwise(0)
        )

    def total(side: str) -> Column:
        return F.aggregate(F.filter("hypotheses", lambda h: h.side == side), F.lit(0), lambda t, h: t + h.score)

    def when_flag(flag: str, text: Column | str) -> Column:
        return F.when(F.array_contains("flags", flag), F.lit(text) if isinstance(text, str) else text)

    ranked = joined.withColumn("hypotheses", F.array_sort(F.transform("_causes", scored), later))
    told = F.flatten(F.transform("_fired", lambda r: F.array_compact(F.array(
        r.observation,
        F.when(r.effect == "reduce_confidence", F.concat(F.lit(M.REDUCED_CONFIDENCE_NOTE), "signal", F.lit("."))),
    ))))
    # the instrument rule puts its action first, then the suspicion flag puts its own in front of that
    first = F.array_compact(F.array(
        when_flag("instrumentacao_suspeita", M.SUSPICION_ACTION),
        F.when(F.exists("_fired", lambda r: F.coalesce(r.effect == "instruments_first", F.lit(False))), F.lit(M.INSTRUMENT_ACTION)),
    ))
    hint = S.CALIBRATION_HINTS["pv_pres_vacuo_cx_engran_inh2o"]
    extra = F.array_compact(F.array(
        F.when(~F.array_contains("flags", "modo_principal_diagnostico"), F.lit(M.OUT_OF_CONTEXT_NOTE)),
        F.when(F.array_contains("flags", "instrumentacao_suspeita"), when_flag("vacuo_cx_engran_inconsistente", hint)),
        when_flag("assimetria_estator", M.ASYMMETRY_NOTE),
    ))
    return ranked.select(
        *keys, "signal", "matrix_subsystem", "base_criticality", "flags", "hypotheses",
        total(M.INTERNAL).cast("bigint").alias("score_internal"), total(M.PERIPHERAL).cast("bigint").alias("score_peripheral"),
        F.array_distinct(F.concat(first, "actions")).alias("actions"),
        F.array_distinct(F.concat(told, extra)).alias("observations"),
    )


def diagnose_alerts(alerts: DataFrame, features: DataFrame, **options) -> DataFrame:
    """Diagnose each alert on its own last reading. Alerts on signals outside the matrix get none."""
    return diagnose_flagged(alerts, flag_table(features, **options))


def diagnose_flagged(alerts: DataFrame, flags: DataFrame) -> DataFrame:
    """``diagnose_alerts`` with the flags of the readings (``flag_table``)."""
    supported = literal_table(alerts.sparkSession, M.PROFILE_SCHEMA, M.profile_documents()).select("signal")
    at = alerts.select("asset_id", "alert_id", "signal", F.col("last_seen_us").alias("us")).join(F.broadcast(supported), "signal", "left_semi")
    return diagnose(at.join(flags, ["asset_id", "us"]))


def attach_diagnosis(alerts: DataFrame, diagnoses: DataFrame) -> DataFrame:
    keyed = diagnoses.select(
        "asset_id", "alert_id", F.col("us").alias("last_seen_us"),
        F.struct("matrix_subsystem", "base_criticality", "flags", "hypotheses", "score_internal", "score_peripheral", "actions",
                 "observations").alias("diagnosis"))
    return alerts.join(keyed, ["asset_id", "alert_id", "last_seen_us"], "left")
