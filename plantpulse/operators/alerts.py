"""Alert hits: which rule fires on which reading.

A hit is one row per (reading, rule). Rules are small tables joined by signal; everything before the hit is a map-side
operation on readings or features, so evaluating rules adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import rules as R
from ..catalog import signals as S
from ..config import StuckParameters, ZeroParameters
from ..functions.columns import alert_identity, long_rows, mode_allowed, noise_floor, threshold_text, violates
from ..session import broadcast_if_small, literal_table
from .quality import stuck_threshold
from .timeslice import KEYS, dealt, with_row_halo

PLACE = ["asset_id", "us", "row_idx", "mode_key"]
HIT = [*PLACE, "alert_id", "rule_id", "layer", "subsystem", "signal", "severity", "title", "message", "current_value",
       "threshold", "metadata"]

#: readings per block when a rule looks back over rows
HISTORY_BLOCK = 4096


def severity_weight(severity: Column, unknown: float = 0.0) -> Column:
    weight = F.lit(unknown)
    for name, points in R.SEVERITY_WEIGHTS.items():
        weight = F.when(severity == name, points).otherwise(weight)
    return weight


def details(entries: dict[str, Column]) -> Column:
    """A string map without its NULL entries."""
    if not entries:
        return F.create_map().cast("map<string,string>")
    pairs = [part for name, value in entries.items() for part in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _k, v: v.isNotNull())


def _hits(found: DataFrame, **columns: Column) -> DataFrame:
    filled = found.withColumns(columns)
    return filled.withColumn(
        "alert_id", alert_identity(F.col("rule_id"), F.col("subsystem"), F.col("signal"), F.col("layer"))
    ).select(*HIT)


def fixed_rule_hits(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """Threshold rules on the measured value, gated by operating mode."""
    fixed = rules.where(F.col("layer") == "fixed_rule").withColumnRenamed("threshold", "limit")
    signals = [s for s in S.NUMERIC_SIGNALS if s in readings.columns]
    watched = readings.select(*PLACE, long_rows(signals)).where(F.col("value").isNotNull())
    fired = watched.join(broadcast_if_small(fixed), "signal").where(
        mode_allowed(F.col("allowed_modes"), F.col("mode_key"))
        & violates(F.col("condition"), F.col("value"), F.col("limit"), F.col("min_value"), F.col("max_value"))
    )
    return _hits(
        fired,
        current_value=F.col("value"),
        threshold=threshold_text(F.col("condition"), F.col("limit"), F.col("min_value"), F.col("max_value")),
        metadata=details({"condition": F.col("condition")}),
    )


#: features the guardrails and the rules themselves read
TREND_FEATURES = ["ma_15m", "ma_1h", "std_1h", "ewma", "slope_15m", "slope_1h", "zscore_1h", "ewma_gap_abs"]


def trend_feature_plan(signals: Sequence[str] | None = None) -> dict[str, list[str]]:
    return {s: TREND_FEATURES for s in (signals or dict.fromkeys(row[1] for row in R.TREND_RULES))}


def slope_guard(value: Column, slope: Column, ma_medium: Column, ma_long: Column, spread: Column) -> Column:
    """The value leaves the hourly mean by more than noise and spread, and value and means are ordered the same way."""
    base = F.coalesce(ma_long, ma_medium)
    ordered = F.when(slope > 0, (value >= ma_medium) & (ma_medium >= ma_long)).otherwise((value <= ma_medium) & (ma_medium <= ma_long))
    aligned = F.coalesce(ordered, F.lit(True))
    return F.coalesce(aligned & (F.abs(value - base) >= F.greatest(noise_floor(base), F.coalesce(spread, F.lit(0.0)))), F.lit(False))


def zscore_guard(value: Column, ma_long: Column, spread: Column) -> Column:
    return F.coalesce(
        (spread >= noise_floor(ma_long, 0.005, 0.01))
        & (F.abs(value - ma_long) >= F.greatest(spread * 1.2, noise_floor(ma_long))),
        F.lit(False),
    )


def ewma_guard(value: Column, ewma: Column, ma_long: Column, spread: Column) -> Column:
    base = F.coalesce(ewma, ma_long)
    return F.coalesce(
        F.abs(value - base) >= F.greatest(noise_floor(base, 0.03, 0.1), F.coalesce(spread, F.lit(0.0))), F.lit(False)
    )


def trend_rule_hits(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules on a feature of a signal, each behind the guardrail of its feature."""
    trend = rules.where(F.col("layer") == "trend").withColumnRenamed("threshold", "limit")
    signals = sorted({c.split("__")[0] for c in features.columns if "__" in c})

    def feature(signal: str, name: str) -> Column:
        column = f"{signal}__{name}"
        return (F.col(column) if column in features.columns else F.lit(None).cast("double")).alias(name)

    long = features.select(*PLACE, F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value"), *[feature(s, n) for n in TREND_FEATURES])
        for s in signals
    ])))
    chosen = F.coalesce(*[F.when(F.col("feature") == n, F.col(n)) for n in TREND_FEATURES])
    v, ma_m, ma_l, spread, ewma = (F.col(c) for c in ("value", "ma_15m", "ma_1h", "std_1h", "ewma"))
    is_slope = F.col("feature").isin("slope_15m", "slope_1h")
    guard = (
        F.when(is_slope, slope_guard(v, F.col("feature_value"), ma_m, ma_l, spread))
        .when(F.col("feature") == "zscore_1h", zscore_guard(v, ma_l, spread))
        .when(F.col("feature") == "ewma_gap_abs", ewma_guard(v, ewma, ma_l, spread))
        .otherwise(v.isNotNull())
    )
    fired = (
        long.join(broadcast_if_small(trend), "signal")
        .withColumn("feature_value", chosen)
        .where(F.col("feature_value").isNotNull() & v.isNotNull() & mode_allowed(F.col("allowed_modes"), F.col("mode_key")))
        .where(violates(F.col("condition"), F.col("feature_value"), F.col("limit"), F.col("min_value"), F.col("max_value")))
        .where(guard)
    )
    label = F.coalesce(*[F.when(F.col("feature") == n, F.lit(text)) for n, text in R.FEATURE_LABELS.items()], F.col("feature"))
    reference = F.when(is_slope, F.coalesce(ma_l, ma_m)).when(F.col("feature") == "ewma_gap_abs", F.coalesce(ewma, ma_l)).otherwise(ma_l)
    reason = (
        F.when(is_slope & (F.col("feature_value") > 0), R.REASON_RISING).when(is_slope, R.REASON_FALLING)
        .when(F.col("feature") == "zscore_1h", R.REASON_OUTLIER).when(F.col("feature") == "ewma_gap_abs", R.REASON_DRIFT)
    )
    return _hits(
        fired,
        current_value=v,
        threshold=threshold_text(F.col("condition"), F.col("limit"), F.col("min_value"), F.col("max_value")),
        metadata=details({
            "feature": F.col("feature"), "feature_value": F.col("feature_value"), "signal_value": v, "feature_label": label,
            "analysis_label": F.when(is_slope, "tendencia anormal").otherwise("comportamento anormal"),
            "reference_value": reference, "analysis_reason": reason,
            "reference_label": F.when(F.col("feature") == "ewma_gap_abs", R.REFERENCE_RECENT).when(reason.isNotNull(), R.REFERENCE_HOUR),
        }),
    )


def _subsystem_lookup(df: DataFrame) -> DataFrame:
    """Subsystem of a signal; signals outside the catalogue belong to ``operacao``."""
    catalogue = literal_table(df.sparkSession, "signal string, subsystem string",
                              [{"signal": s, "subsystem": sub} for s, sub in S.SUBSYSTEM_OF.items()])
    return df.join(F.broadcast(catalogue), "signal", "left").withColumn("subsystem", F.coalesce("subsystem", F.lit("operacao")))


infer_subsystem = _subsystem_lookup


def _blocks(numbered: DataFrame, signals: Sequence[str], reach: int) -> DataFrame:
    """Blocks of readings with the history before them, in as many tasks as their rows need."""
    haloed = with_row_halo(numbered.select(*PLACE, *signals), reach, HISTORY_BLOCK).repartition(*KEYS, "block")
    return dealt(haloed, numbered.count(), *KEYS, "block")


def rolling_stuck(numbered: DataFrame, signals: Sequence[str] = S.STUCK_CANDIDATES,
                  p: StuckParameters = StuckParameters()) -> DataFrame:
    """Stuck-sensor evidence at every reading, over the last ``p.points`` values among the last ``p.history_rows`` readings.

    Blocks of readings carry the history as a halo and are shuffled wide once; signals are melted inside the block.
    The deviation of values never exceeds half their range, so the range alone decides who can be stuck: the costly
    evidence (deviation, median step) is collected only in series blocks where some reading passes the range test.
    A reading without a value repeats the verdict of the last value, as long as its points are still in reach.
    """
    reach = p.history_rows - 1
    long = _blocks(numbered, signals, reach).select(*PLACE, "block", "home", long_rows(list(signals)))
    long = long.withColumn("_has", F.when(F.col("value").isNotNull(), 1).otherwise(0))
    values = Window.partitionBy(*KEYS, "block", "signal", "_has").orderBy("row_idx")
    last_points = values.rowsBetween(-(p.points - 1), 0)
    oldest = F.lag("row_idx", p.points - 1).over(values)
    spread = F.max("value").over(last_points) - F.min("value").over(last_points)
    flat = (F.col("_has") == 1) & (oldest >= F.col("row_idx") - reach) & (spread <= stuck_threshold(F.col("value"), p))
    long = long.withColumns({"_oldest": oldest, "_spread": spread}).withColumn("_flat", F.coalesce(flat, F.lit(False)))
    some = F.max("_flat").over(Window.partitionBy(*KEYS, "block", "signal"))
    long = long.withColumn("_some", some).where("_some")
    long = long.withColumns({"_std": F.stddev_pop("value").over(last_points), "_times": F.collect_list("us").over(last_points)})
    evidence = F.when(F.col("_flat"), F.struct(
        F.col("value").alias("repeated_value"), F.lit(p.points).cast("bigint").alias("window_points"),
        F.col("_spread").alias("observed_range"), F.col("_std").alias("observed_std"), F.col("_oldest").alias("first_row"),
        F.col("_times").alias("times")))
    series = Window.partitionBy(*KEYS, "block", "signal").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    verdict = F.when(F.col("_has") == 1, F.struct(evidence.alias("evidence")))
    held = long.withColumn("_verdict", verdict).withColumn("_verdict", F.last("_verdict", ignorenulls=True).over(series))
    near = held.where(F.col("home") & F.col("_verdict.evidence").isNotNull()).select(*PLACE, "signal", "_verdict.evidence.*").where(
        F.col("first_row") >= F.col("row_idx") - reach)
    # observed time = last - first + median step between the points
    steps = F.array_sort(F.zip_with(F.slice("times", 2, p.points - 1), F.slice("times", 1, p.points - 1), lambda b, a: b - a))
    middle = p.points - 1
    low, high = (middle + 1) // 2, middle // 2 + 1
    minutes = (F.element_at("times", -1) - F.element_at("times", 1)) / 6e7 + (
        F.element_at("_steps", low) + F.element_at("_steps", high)) / 2.0 / 6e7
    return near.withColumn("_steps", steps).withColumn("window_minutes", minutes).where(F.col("window_minutes") >= p.minutes).drop(
        "_steps", "times", "first_row")


def stuck_hits(numbered: DataFrame, signals: Sequence[str] = S.STUCK_CANDIDATES, p: StuckParameters = StuckParameters()) -> DataFrame:
    found = _subsystem_lookup(rolling_stuck(numbered, signals, p))
    return _hits(
        found,
        rule_id=F.concat(F.lit("sensor_stuck::"), F.col("signal")), layer=F.lit("operational_anomaly"), severity=F.lit("low"),
        title=F.concat(F.lit(R.STUCK_TITLE), F.col("signal")), message=F.lit(R.STUCK_MESSAGE),
        current_value=F.col("repeated_value"), threshold=F.lit(R.STUCK_THRESHOLD),
        metadata=details({
            "repeated_value": F.col("repeated_value"), "window_points": F.col("window_points"),
            "window_minutes": F.round("window_minutes", 1), "observed_range": F.round("observed_range", 6),
            "observed_std": F.round("observed_std", 6)}),
    )


def rolling_zeros(numbered: DataFrame, signals: Sequence[str] = S.ZERO_ABNORMAL, p: ZeroParameters = ZeroParameters()) -> DataFrame:
    """Readings whose last values, among the last ``p.history_rows`` readings, are all zero."""
    reach = p.history_rows - 1
    long = _blocks(numbered, signals, reach).select(*PLACE, "block", "home", long_rows(list(signals)))
    long = long.withColumn("_has", F.when(F.col("value").isNotNull(), 1).otherwise(0))
    values = Window.partitionBy(*KEYS, "block", "signal", "_has").orderBy("row_idx").rowsBetween(-(p.points - 1), 0)
    recent = F.when(F.col("_has") == 1, F.collect_list(F.struct("row_idx", "value")).over(values))
    series = Window.partitionBy(*KEYS, "block", "signal").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    held = long.withColumn("_recent", recent).withColumn("_recent", F.last("_recent", ignorenulls=True).over(series)).where("home")
    in_reach = held.withColumn("_recent", F.filter("_recent", lambda o: o.row_idx >= F.col("row_idx") - reach))
    return in_reach.where(
        (F.size("_recent") >= p.minimum) & F.forall("_recent", lambda o: o.value == 0)
    ).select(*PLACE, "signal", "value", F.size("_recent").cast("bigint").alias("window_points"))


def anomaly_hits(numbered: DataFrame, rules: DataFrame, zero: ZeroParameters = ZeroParameters()) -> DataFrame:
    """Rule-driven anomalies: recurrent zeros and values outside the band of any threshold rule, in any mode."""
    anomalies = rules.where(F.col("layer") == "operational_anomaly")
    hint = F.coalesce(*[F.when(F.col("signal") == s, F.concat_ws(" ", "message", F.lit(text))) for s, text in S.CALIBRATION_HINTS.items()],
                      F.col("message"))
    zero_rules = anomalies.where(F.col("type") == "zero_abnormal").drop("threshold")
    zeros = rolling_zeros(numbered, p=zero).join(broadcast_if_small(zero_rules), "signal")
    zero_found = _hits(zeros, current_value=F.col("value"), threshold=F.col("type"), message=hint,
                       metadata=details({"window_points": F.col("window_points")}))
    bands = (
        rules.where((F.col("layer") == "fixed_rule") & (F.col("condition") == "between"))
        .groupBy("signal").agg(F.max("min_value").alias("_low"), F.min("max_value").alias("_high"))
    )
    engineering = anomalies.where(F.col("type") == "engineering_hint").drop("threshold").join(bands, "signal")
    signals = [s for s in S.NUMERIC_SIGNALS if s in numbered.columns]
    outside = numbered.select(*PLACE, long_rows(signals)).join(broadcast_if_small(engineering), "signal").where(
        (F.col("value") < F.col("_low")) | (F.col("value") > F.col("_high"))
    )
    return zero_found.unionByName(
        _hits(outside, current_value=F.col("value"), threshold=F.col("type"), message=hint, metadata=details({}))
    )


def issue_hits(numbered: DataFrame, issues: DataFrame, rules: DataFrame, raised: DataFrame) -> DataFrame:
    """Batch issues raise the same anomaly alerts at the asset's latest reading, unless the reading raised them itself."""
    latest = numbered.groupBy("asset_id").agg(F.max_by(F.struct(*PLACE[1:]), "us").alias("_at")).select("asset_id", "_at.*")
    at_latest = issues.drop("us", "message").withColumnRenamed("details", "metadata").join(latest, "asset_id")
    stuck = _subsystem_lookup(at_latest.where(F.col("issue_type") == "sensor_stuck"))
    stuck_found = _hits(
        stuck, rule_id=F.concat(F.lit("sensor_stuck::"), F.col("signal")), layer=F.lit("operational_anomaly"),
        severity=F.lit("low"), title=F.concat(F.lit(R.STUCK_TITLE), F.col("signal")), message=F.lit(R.STUCK_MESSAGE),
        current_value=F.col("metadata")["repeated_value"].cast("double"), threshold=F.lit(R.STUCK_THRESHOLD),
    )
    zero_rules = rules.where((F.col("layer") == "operational_anomaly") & (F.col("type") == "zero_abnormal")).drop("threshold")
    zeros = at_latest.where(F.col("issue_type") == "zero_abnormal").join(broadcast_if_small(zero_rules), "signal")
    zero_found = _hits(zeros, current_value=F.lit(0.0), threshold=F.col("type"))
    found = stuck_found.unionByName(zero_found)
    return found.join(raised.select("asset_id", "us", "alert_id"), ["asset_id", "us", "alert_id"], "left_anti").select(*HIT)


def unique_hits(hits: DataFrame, order: Sequence[str] = ("rule_id",)) -> DataFrame:
    """One hit per reading and alert."""
    last = Window.partitionBy("asset_id", "row_idx", "alert_id").orderBy(*[F.col(c).desc() for c in order])
    return hits.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") == 1).drop("_rank")


def all_hits(features: DataFrame, rules: DataFrame, issues: DataFrame | None = None, trends: DataFrame | None = None) -> DataFrame:
    """Every layer over numbered readings with trend features; user rules may share an identity; episodes count a reading once.

    ``trends`` may hold the trend features of the same readings. They are read once, the readings by every layer, so features that
    are given apart need not be stored with the readings.
    """
    hits = (
        fixed_rule_hits(features, rules)
        .unionByName(trend_rule_hits(features if trends is None else trends, rules))
        .unionByName(stuck_hits(features))
        .unionByName(anomaly_hits(features, rules))
    )
    return hits if issues is None else hits.unionByName(issue_hits(features, issues, rules, hits))
