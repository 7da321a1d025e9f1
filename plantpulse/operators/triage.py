"""Questions asked of the alert table: recent alerts, filtered triage lists, candidates to explain, guidance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alerts import severity_weight
from .asof import asof_join
from .episodes import event_order

# --- fixed values ---
EXPLAINED_LAYERS = ["fixed_rule", "trend", "predictive_statistics"]
CONTEXT_SIGNALS = [
    "pv_pres_sistema_bar", "pv_pres_descarga_bar", "pv_temp_oleo_lubrificacao_c", "pv_vib_estagio_1_mils",
    "pv_vib_estagio_2_mils", "pv_vib_estagio_3_mils", "pv_corr_motor_a", "pv_temp_fase_a_do_estator_c",
    "pv_temp_fase_b_do_estator_c", "pv_temp_fase_c_do_estator_c", "pv_temp_rolamento_dianteiro_motor",
    "pv_pos_abert_valv_admissao_pct", "pv_pos_valv_bypass_pct", "pv_pos_alivio_pct", "delta_filtro_oleo_bar",
]
INSTRUMENT_WORDS = "sensor|instrument|escala|zerad"
QUIET_TITLE = "Operacao sem alerta ativo nos filtros atuais"
QUIET_FOCUS = "Rotina de acompanhamento"
INSTRUMENT_FOCUS = "Validar instrumentacao antes de intervencao fisica"
# --- end of fixed values ---


def recent_alerts(episodes: DataFrame, limit: int = 200, subsystem: str | None = None, severity: str | None = None) -> DataFrame:
    """Newest episodes, optionally of one subsystem or severity. Ends in a top-n, never in a full sort."""
    chosen = episodes
    if subsystem:
        chosen = chosen.where(F.col("subsystem") == subsystem)
    if severity:
        chosen = chosen.where(F.col("severity") == severity)
    return chosen.orderBy(*event_order()).limit(limit)


def matches(subsystem: str | None = None, layer: str | None = None, severity: str | None = None, text: str | None = None) -> Column:
    """Facet filter; text is looked for, without case, in title, message, rule, subsystem and signal."""
    condition = F.lit(True)
    for column, wanted in (("subsystem", subsystem), ("layer", layer), ("severity", severity)):
        if wanted and wanted != "all":
            condition = condition & (F.col(column) == wanted)
    if text:
        words = F.lower(F.concat_ws(" ", "title", "message", "rule_id", "subsystem", F.coalesce("signal", F.lit(""))))
        condition = condition & words.contains(text.lower())
    return condition


def triage_active(episodes: DataFrame, **facets: str | None) -> DataFrame:
    return episodes.where(F.col("is_active") & matches(**facets)).orderBy(
        severity_weight(F.col("severity")).desc(), F.col("last_seen_us").desc(), "asset_id", "alert_id")


def triage_recent(episodes: DataFrame, **facets: str | None) -> DataFrame:
    return episodes.where(~F.col("is_active") & matches(**facets)).orderBy(
        F.col("last_seen_us").desc(), "asset_id", "alert_id")


def is_explained() -> Column:
    """Layers worth an explanation: everything but plain stuck-sensor notices."""
    return F.col("layer").isin(EXPLAINED_LAYERS) | (
        (F.col("layer") == "operational_anomaly") & ~F.col("rule_id").startswith("sensor_stuck::"))


def explanation_candidates(episodes: DataFrame, k: int = 8) -> DataFrame:
    """Top ``k`` distinct alerts per asset: active first, then severity, then recency."""
    order = [F.col("is_active").desc(), severity_weight(F.col("severity")).desc(), F.col("last_seen_us").desc(), F.col("alert_id")]
    best = Window.partitionBy("asset_id", "alert_id").orderBy(*order)
    per_asset = Window.partitionBy("asset_id").orderBy(*order)
    return (
        episodes.where(is_explained())
        .withColumn("_copy", F.row_number().over(best)).where(F.col("_copy") == 1)
        .withColumn("place", F.row_number().over(per_asset)).where(F.col("place") <= k).drop("_copy")
    )


def attach_snapshot(alerts: DataFrame, readings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Latest reading at or before the alert was last seen."""
    at_alert = alerts.withColumn("us", F.col("last_seen_us"))
    return asof_join(at_alert, readings, payload=list(columns), prefix="snap_").drop("us")


def context_document(prefix: str = "snap_") -> Column:
    """Selected signals as JSON, rounded to 4 places; JSON leaves NULLs out."""
    texts = [F.col(f"{prefix}{c}").alias(c) for c in ("mode_key", "st_oper", "st_carga_oper")]
    numbers = [F.round(F.col(f"{prefix}{c}"), 4).alias(c) for c in CONTEXT_SIGNALS]
    return F.to_json(F.struct(F.timestamp_micros(F.col(f"{prefix}us")).cast("timestamp_ntz").alias("timestamp"), *texts, *numbers))


def evidence_document() -> Column:
    return F.to_json(F.struct("layer", "severity", "rule_id", "signal", "threshold", "mode_key", "current_value", "metadata"))


def insight_key() -> Column:
    """Identity of an explanation request: same key, same explanation."""
    moment = F.date_format(F.timestamp_micros("triggered_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    iso = F.regexp_replace(moment, r"\.000000$", "")
    return F.concat_ws("|", "alert_id", "rule_id", "layer", F.coalesce("signal", F.lit("")), "severity", iso)


def explanation_requests(candidates: DataFrame, readings: DataFrame, insights: DataFrame | None = None) -> DataFrame:
    """Input documents for candidates that have no insight yet under the same key."""
    keyed = candidates.withColumn("insight_key", insight_key())
    if insights is not None:
        keyed = keyed.join(insights.select("asset_id", "insight_key"), ["asset_id", "insight_key"], "left_anti")
    snapped = attach_snapshot(keyed, readings, ["mode_key", "st_oper", "st_carga_oper", *CONTEXT_SIGNALS])
    return snapped.select("asset_id", "alert_id", "insight_key", context_document().alias("snapshot"), evidence_document().alias("evidence"))


def explanation_coverage(episodes: DataFrame, insights: DataFrame, recent: int = 50) -> DataFrame:
    """Eligible alerts, and how many of them are explained, over active alerts and the newest events of each asset."""
    newest = Window.partitionBy("asset_id").orderBy(*event_order())
    events = episodes.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= recent).drop("_n")
    pool = episodes.where("is_active").unionByName(events).withColumn("insight_key", insight_key())
    last = Window.partitionBy("asset_id", "alert_id").orderBy(F.col("last_seen_us"), F.col("triggered_us"))
    unique = pool.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1)
    known = insights.select("asset_id", "insight_key").distinct().withColumn("_known", F.lit(True))
    return unique.join(known, ["asset_id", "insight_key"], "left").groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(is_explained()).alias("eligible_alerts"),
        F.count_if(F.col("_known")).alias("alerts_with_insight"),
    )


def operational_guidance(episodes: DataFrame, scores: DataFrame, assets: DataFrame) -> DataFrame:
    """One line of advice per asset, also for assets without active alerts."""
    words = F.lower(F.concat_ws(" ", "title", "message", "rule_id"))
    rank = F.struct(severity_weight(F.col("severity")), F.col("last_seen_us"), F.col("alert_id"))
    top = episodes.where("is_active").groupBy("asset_id").agg(
        F.max_by(F.struct("severity", "subsystem", "title"), rank).alias("_top"),
        F.bool_or(words.rlike(INSTRUMENT_WORDS)).alias("_instrument"),
    )
    focus_area = F.coalesce("_top.subsystem", "_best")
    best = scores.where(F.col("active_alerts") > 0).groupBy("asset_id").agg(F.max_by("subsystem", "score").alias("_best"))
    joined = assets.select("asset_id").distinct().join(top, "asset_id", "left").join(best, "asset_id", "left")
    quiet = F.col("_top").isNull()
    return joined.select(
        "asset_id",
        F.when(quiet, "ok").otherwise(F.col("_top.severity")).alias("level"),
        F.when(quiet, QUIET_TITLE).otherwise(F.concat(F.lit("Direcionamento operacional: "), focus_area)).alias("title"),
        F.when(quiet, QUIET_FOCUS).when(F.col("_instrument"), INSTRUMENT_FOCUS)
        .otherwise(F.concat(F.lit("Focar primeiro em "), focus_area)).alias("focus"),
        F.when(~quiet, F.concat(F.col("_top.title"), F.lit(". Priorize verificacao no subsistema "), focus_area, F.lit("."))).alias("summary"),
    )


def signal_events(episodes: DataFrame, signal: str, recent: int = 200) -> DataFrame:
    """Active and recent episodes of one signal, each once, newest first."""
    of_signal = episodes.where(F.col("signal") == signal)
    merged = of_signal.where("is_active").unionByName(recent_alerts(of_signal, recent))
    return merged.dropDuplicates(["asset_id", "alert_id", "last_seen_us"]).orderBy(F.col("last_seen_us").desc(), "asset_id", "alert_id")


def diagnosed_alert(episodes: DataFrame, signal: str, subsystem: str) -> DataFrame:
    """Per asset the alert whose diagnosis to show: same signal before same subsystem, active before closed."""
    weight = severity_weight(F.col("severity"))
    priority = (
        F.when((F.col("signal") == signal) & F.col("is_active"), 0).when(F.col("signal") == signal, 1)
        .when((F.col("subsystem") == subsystem) & F.col("is_active"), 2).when(F.col("subsystem") == subsystem, 3)
    )
    ranked = episodes.where(F.col("diagnosis").isNotNull()).withColumn("_priority", priority).where(F.col("_priority").isNotNull())
    order = Window.partitionBy("asset_id").orderBy(
        "_priority", F.when(F.col("is_active"), -weight).otherwise(F.lit(0.0)), F.col("last_seen_us").desc(), "alert_id")
    return ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n", "_priority")
