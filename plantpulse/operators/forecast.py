"""Forecast layer: regression over the last readings in normal operation, time to threshold, early alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import signals as S
from ..config import ForecastParameters
from ..functions.columns import long_rows
from ..session import broadcast_if_small
from .alerts import details
from .timeslice import KEYS, newest_rows

LAYER = "predictive_statistics"


def latest_rows(readings: DataFrame) -> DataFrame:
    """Newest reading per asset: an aggregate with map-side combine, not a window."""
    columns = [c for c in readings.columns if c != "asset_id"]
    return readings.groupBy("asset_id").agg(F.max_by(F.struct(*columns), "us").alias("_row")).select("asset_id", "_row.*")


def rule_signals(rules: DataFrame, df: DataFrame) -> list[str]:
    """Signals the rule table (a few rows of configuration) names and the readings have."""
    return [row["signal"] for row in rules.select("signal").collect() if row["signal"] in df.columns]


def regression_window(readings: DataFrame, rules: DataFrame, p: ForecastParameters = ForecastParameters()) -> DataFrame:
    """The last K values per signal in normal operation; signals with fewer than K are left out."""
    wanted = rules.select("signal", F.greatest(F.col("lookback_points"), F.lit(p.min_points)).alias("points"))
    signals = rule_signals(rules, readings)
    longest = rules.agg(F.max(F.greatest(F.col("lookback_points"), F.lit(p.min_points)))).first()[0] or p.min_points
    values = readings.where(F.col("mode_key") == S.NORMAL_MODE).select("asset_id", "us", long_rows(signals)).where(F.col("value").isNotNull())
    last = newest_rows(values, longest, (*KEYS, "signal"))
    return last.join(broadcast_if_small(wanted), "signal").where(F.col("rank_desc") <= F.col("points"))


def regression_stats(window: DataFrame) -> DataFrame:
    """Slope per hour, intercept, r2 and directional consistency of each window (K rows each)."""
    series = Window.partitionBy("asset_id", "signal").orderBy("us")
    first = F.min("us").over(Window.partitionBy("asset_id", "signal"))
    timed = window.withColumns({
        "_minute": (F.col("us") - first) / 6e7,
        "_step": F.col("value") - F.lag("value").over(series),
    })
    up = F.avg(F.when(F.col("_step").isNotNull(), (F.col("_step") > 0).cast("double")))
    down = F.avg(F.when(F.col("_step").isNotNull(), (F.col("_step") < 0).cast("double")))
    slope = F.regr_slope("value", "_minute")
    return timed.groupBy("asset_id", "signal").agg(
        F.count(F.lit(1)).alias("points"), F.first("points").alias("_needed"),
        slope.alias("slope_per_minute"), F.regr_intercept("value", "_minute").alias("intercept"),
        F.when(F.var_pop("value") > 0, F.regr_r2("value", "_minute")).otherwise(F.lit(0.0)).alias("r2"),
        F.greatest(up, down).alias("consistency"),
    ).where(F.col("points") >= F.col("_needed")).drop("_needed").withColumn("slope_per_hour", F.col("slope_per_minute") * 60.0)


def closeness(value: Column, threshold: Column, direction: Column) -> Column:
    ratio = F.when(direction == "up", value / F.nullif(threshold, F.lit(0.0))).otherwise(threshold / F.greatest(value, F.lit(1e-6)))
    return F.when(threshold == 0, F.lit(0.0)).otherwise(ratio)


def risky_slope(slope: Column, least: Column, direction: Column) -> Column:
    return F.when(direction == "up", slope >= least).otherwise(slope <= -F.abs(least))


def minutes_to_threshold(value: Column, threshold: Column, slope_per_hour: Column, direction: Column) -> Column:
    """NULL when the trend is flat, moves away, or the threshold is already passed."""
    slope = slope_per_hour / 60.0
    toward = F.when(direction == "up", (slope > 0) & (value < threshold)).otherwise((slope < 0) & (value > threshold))
    return F.when((F.abs(slope) >= 1e-9) & toward, (threshold - value) / F.nullif(slope, F.lit(0.0)))


def urgency(minutes: Column, limit: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - minutes / F.greatest(limit.cast("double"), F.lit(1.0)))


# weights of the degradation score and of the confidence: fixed values
SCORE_WEIGHTS = {"closeness": 28.0, "slope": 18.0, "r2": 18.0, "consistency": 14.0, "zscore": 12.0, "drift": 5.0, "urgency": 5.0}
CONFIDENCE_WEIGHTS = {"score": 0.45, "r2": 0.25, "consistency": 0.2, "urgency": 0.1}


def degradation_score(ratio: Column, slope: Column, least: Column, r2: Column, consistency: Column, zscore: Column,
                      drift: Column, threshold: Column, urgent: Column) -> Column:
    parts = {
        "closeness": F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.25)) / 1.25,
        "slope": F.least(F.abs(slope) / F.greatest(least, F.lit(1e-6)), F.lit(2.0)) / 2.0,
        "r2": r2,
        "consistency": consistency,
        "zscore": F.least(zscore / 3.0, F.lit(1.0)),
        "drift": F.least(drift / F.greatest(F.abs(threshold) * 0.03, F.lit(0.1)), F.lit(1.0)),
        "urgency": urgent,
    }
    total = sum((parts[name] * weight for name, weight in SCORE_WEIGHTS.items()), F.lit(0.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def forecast_confidence(score: Column, r2: Column, consistency: Column, urgent: Column) -> Column:
    w = CONFIDENCE_WEIGHTS
    total = score / 100.0 * w["score"] + r2 * w["r2"] + consistency * w["consistency"] + urgent * w["urgency"]
    return F.least(F.lit(0.99), F.greatest(F.lit(0.0), total))


def forecast_measures(features: DataFrame, rules: DataFrame, active: DataFrame | None = None,
                      p: ForecastParameters = ForecastParameters()) -> DataFrame:
    """All measures per asset and signal, before the decision. Gate: latest reading in normal mode, signal not alerting."""
    signals = rule_signals(rules, features)

    def feature(s: str, name: str) -> Column:
        return F.col(f"{s}__{name}") if f"{s}__{name}" in features.columns else F.lit(None).cast("double")

    needed = [f"{s}__{n}" for s in signals for n in ("zscore_1h", "ewma_gap_abs") if f"{s}__{n}" in features.columns]
    latest = latest_rows(features.select("asset_id", "us", "mode_key", *signals, *needed))
    gated = latest.where(F.col("mode_key") == S.NORMAL_MODE).select("asset_id", "us", "mode_key", F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(s).alias("value"), F.abs(feature(s, "zscore_1h")).alias("_z"),
                 feature(s, "ewma_gap_abs").alias("_gap")) for s in signals
    ]))).where(F.col("value").isNotNull())
    if active is not None:
        gated = gated.join(active.select("asset_id", "signal").distinct(), ["asset_id", "signal"], "left_anti")
    stats = regression_stats(regression_window(features, rules, p))
    joined = gated.join(stats, ["asset_id", "signal"]).join(broadcast_if_small(rules), "signal")
    v, limit, way = F.col("value"), F.col("threshold"), F.col("direction")
    measured = joined.withColumns({
        "zscore": F.coalesce("_z", F.lit(0.0)), "ewma_gap": F.coalesce("_gap", F.lit(0.0)),
        "closeness": closeness(v, limit, way),
        "forecast_minutes": minutes_to_threshold(v, limit, F.col("slope_per_hour"), way),
    }).drop("_z", "_gap").withColumn("_urgent", urgency(F.col("forecast_minutes"), F.col("horizon_minutes")))
    measured = measured.withColumn("score", degradation_score(
        F.col("closeness"), F.col("slope_per_hour"), F.col("min_slope_per_hour"), F.col("r2"), F.col("consistency"),
        F.col("zscore"), F.col("ewma_gap"), limit, F.col("_urgent")))
    return measured.withColumn("confidence", forecast_confidence(
        F.col("score"), F.col("r2"), F.col("consistency"), F.col("_urgent"))).drop("_urgent")


def forecast_decision(measures: DataFrame, p: ForecastParameters = ForecastParameters()) -> DataFrame:
    """Keep risky forecasts and name the expected event and its severity."""
    risky = measures.where(
        (F.col("closeness") >= F.col("min_current_ratio"))
        & risky_slope(F.col("slope_per_hour"), F.col("min_slope_per_hour"), F.col("direction"))
        & (F.col("r2") >= p.min_r2)
        & (F.col("forecast_minutes") <= F.col("horizon_minutes"))
        & (F.col("confidence") >= p.min_confidence)
    )
    trip = F.col("trip_related") & (F.col("forecast_minutes") <= F.col("trip_minutes"))
    return risky.withColumns({
        "event": F.when(trip, "possible_trip").otherwise("critical_alarm"),
        "severity": F.when(trip & (F.col("forecast_minutes") <= 30), "critical").when(trip, "high")
        .when(F.col("criticality") == "critica", "high").otherwise("medium"),
    })


def forecast_alerts(decided: DataFrame) -> DataFrame:
    """Alert rows of the forecast layer, shaped like episodes that start and end at the latest reading."""
    trip = F.col("event") == "possible_trip"
    number = F.format_string
    observations = F.array(
        number("regressao linear com R2 %.2f na janela recente de %s.", F.col("r2"), F.col("signal")),
        number("consistencia direcional de %.2f na serie recente.", F.col("consistency")),
        number("score de degradacao calculado em %.1f/100.", F.col("score")),
        number("tempo estimado ate o limiar: %.1f min.", F.col("forecast_minutes")),
    )
    short = F.regexp_replace(F.col("threshold").cast("string"), r"\.0$", "")
    return decided.select(
        "asset_id",
        F.sha1(F.concat_ws("::", F.lit("predictive"), "signal", "event")).alias("alert_id"),
        F.concat(F.lit("predictive::"), "signal").alias("rule_id"), F.lit(LAYER).alias("layer"), "subsystem", "signal", "severity",
        F.when(trip, F.concat(F.lit("Risco antecipado de trip por tendencia em "), "label"))
        .otherwise(F.concat(F.lit("Risco antecipado de alarme critico em "), "label")).alias("title"),
        F.concat(
            F.lit("A tendencia estatistica de "), "label", F.lit(" sugere risco de "), F.when(trip, "trip").otherwise("alarme critico"),
            F.lit(" em aproximadamente "), F.bround("forecast_minutes").cast("bigint").cast("string"),
            F.lit(" min se a degradacao persistir. Valor atual "), number("%.3f", "value"), F.lit(" | limiar "),
            number("%.3f", "threshold"), F.lit("."),
        ).alias("message"),
        F.round("value", 4).alias("current_value"), F.concat_ws(" ", "direction", short).alias("threshold"), "mode_key",
        details({
            "forecast_minutes": F.round("forecast_minutes", 1), "degradation_score": F.round("score", 1),
            "regression_r2": F.round("r2", 4), "directional_consistency": F.round("consistency", 4),
            "slope_per_hour": F.round("slope_per_hour", 4), "predicted_event": F.col("event"),
            "confidence": F.round("confidence", 3), "zscore_1h": F.round("zscore", 4), "ewma_gap_abs": F.round("ewma_gap", 4),
            "observations": F.array_join(observations, " "),
        }).alias("metadata"),
        F.col("us").alias("triggered_us"), F.col("us").alias("last_seen_us"), F.lit(True).alias("is_active"),
    )


def merge_alerts(episodes: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Episodes and forecast alerts in one table; forecasts count as active."""
    return episodes.unionByName(forecasts, allowMissingColumns=True)
