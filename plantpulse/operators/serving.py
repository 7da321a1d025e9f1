"""Answers for screens and services: snapshots, slices, trends, catalogue, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import signals as S
from ..config import DAY_US, HOUR_US, MINUTE_US, FlowParameters
from ..functions.columns import ambient_columns, flow_columns
from ..session import broadcast_if_small, small_side, stored
from .forecast import latest_rows
from .timeslice import KEYS, newest_rows, number_rows, slice_by_time

UNITS_US = {"minutes": MINUTE_US, "hours": HOUR_US, "days": DAY_US}
DEFAULT_RANGE_US = 6 * HOUR_US
TREND_MEANS = ["ma_15m", "ewma", "std_1h"]
TREND_LASTS = ["slope_15m", "slope_1h", "zscore_1h"]


def raw_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "__" not in c]


def latest_snapshot(features: DataFrame) -> DataFrame:
    """Newest reading per asset, measured and derived columns only."""
    return latest_rows(features.select(*raw_columns(features)))


def latest_readings(features: DataFrame, n: int) -> DataFrame:
    return newest_rows(features.select(*raw_columns(features)), n)


def range_width(value: int, unit: str) -> int:
    return value * UNITS_US[unit] if unit in UNITS_US else DEFAULT_RANGE_US


def time_range(readings: DataFrame, value: int, unit: str) -> DataFrame:
    """Readings within the range that ends at each asset's newest reading.

    The newest time per asset is a two-column aggregate, stored once. Its least bound over all assets also goes to the scan as a
    literal on the event time, so files before it are skipped.
    """
    bounds = stored(readings.groupBy("asset_id").agg((F.max("us") - range_width(value, unit)).alias("_from")))
    least = bounds.agg(F.min("_from")).first()[0]
    if least is not None and "ts" in readings.columns:
        readings = readings.where(F.col("ts") >= F.timestamp_micros(F.lit(least)).cast(readings.schema["ts"].dataType))
    return readings.join(broadcast_if_small(bounds), "asset_id").where(F.col("us") >= F.col("_from")).drop("_from")


def time_range_of_asset(readings: DataFrame, asset_id: int, value: int, unit: str) -> DataFrame:
    """One asset: its bound is looked up first and becomes a literal on the event time, which reaches the file scan."""
    one = readings.where(F.col("asset_id") == asset_id)
    newest = one.agg(F.max("us")).first()[0]
    if newest is None:
        return one
    start = newest - range_width(value, unit)
    return one.where((F.col("us") >= start) & (F.col("ts") >= F.timestamp_micros(F.lit(start)).cast("timestamp_ntz")))


def last_points(readings: DataFrame, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return newest_rows(readings, k, keys).drop("rank_desc")


def bucket_start(us: Column, bucket: str) -> Column:
    return us - F.pmod(us, F.lit(UNITS_US[bucket]))


def bucketed(rows: DataFrame, bucket: str, keys: Sequence[str] = ("asset_id", "signal"), value: str = "value",
             means: Sequence[str] = (), lasts: Sequence[str] = ()) -> DataFrame:
    """Left-closed time buckets labelled by their start; buckets without a value are dropped. ``raw`` passes through."""
    if bucket not in UNITS_US:
        return rows
    return (
        rows.groupBy(*keys, bucket_start(F.col("us"), bucket).alias("_bucket"))
        .agg(F.avg(value).alias(value), *[F.avg(c).alias(c) for c in means],
             *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("us"))).alias(c) for c in lasts])
        .where(F.col(value).isNotNull()).withColumnRenamed("_bucket", "us")
    )


def bucketed_or_raw(rows: DataFrame, bucket: str, **options) -> DataFrame:
    """Buckets, or the raw rows of series for which no bucket has a value."""
    if bucket not in UNITS_US:
        return rows
    keys = list(options.get("keys", ("asset_id", "signal")))
    grouped = bucketed(rows, bucket, **options)
    served = rows.where(F.col(options.get("value", "value")).isNotNull()).select(*keys).distinct()
    return grouped.unionByName(rows.join(served, keys, "left_anti").select(*grouped.columns))


def thinned(rows: DataFrame, max_points: int, keys: Sequence[str] = ("asset_id", "signal"), order: Sequence[str] = ("us",)) -> DataFrame:
    """At most ``max_points`` evenly spread rows per series, first and last included.

    Row r of n is one of the points ``floor(i (n-1) / (m-1))``; that is checked in integers from the row's own number,
    which comes from slice counts, so a long series is never ordered in one task.
    """
    if max_points <= 0:
        return rows
    placed = number_rows(slice_by_time(rows, keys), keys, order, index="_r", total="_n")
    r, n, m = F.col("_r") - 1, F.col("_n"), max_points
    if max_points == 1:
        keep = r == 0
    else:
        i = F.ceil(r * (m - 1) / F.nullif(n - 1, F.lit(0)))
        keep = F.floor(i * (n - 1) / (m - 1)) == r
    return placed.where((n <= m) | keep).drop("_r", "_n", "slice_us")


def signal_limits(rules: DataFrame) -> DataFrame:
    """Operating limits per signal: bands win over one-sided thresholds; the tightest counts."""
    fixed = rules.where(F.col("layer") == "fixed_rule")
    kind = F.col("condition")
    band = kind == "between"
    return fixed.groupBy("signal").agg(
        F.coalesce(F.max(F.when(band, F.col("min_value"))), F.max(F.when(kind.isin("lt", "lte"), F.col("threshold")))).alias("lower_limit"),
        F.coalesce(F.min(F.when(band, F.col("max_value"))), F.min(F.when(kind.isin("gt", "gte"), F.col("threshold")))).alias("upper_limit"),
    )


def signal_rules(rules: DataFrame) -> DataFrame:
    """Threshold and trend rules listed per signal."""
    text = F.when(F.col("condition") == "between", F.concat(F.col("min_value").cast("string"), F.lit(".."), F.col("max_value").cast("string"))).otherwise(
        F.concat_ws(" ", "condition", F.col("threshold").cast("string")))
    return rules.where(F.col("layer").isin("fixed_rule", "trend")).select(
        "signal", "rule_id", "title", "severity", "layer", "condition", text.alias("limit_text"))


def effective_target(live: Column, static: Column | None = None, fallback: Column | None = None) -> Column:
    return F.coalesce(*[c for c in (live, static, fallback) if c is not None])


def trend_rows(features: DataFrame, signals: Sequence[str], max_series: int | None = None) -> DataFrame:
    """Long rows of the wanted series, all of them or the first ``max_series``, with the live setpoint of each."""
    chosen = [s for s in dict.fromkeys(s.strip() for s in signals) if s and s in features.columns][:max_series]

    def feature(s: str, n: str) -> Column:
        return (F.col(f"{s}__{n}") if f"{s}__{n}" in features.columns else F.lit(None).cast("double")).alias(n)

    def target(s: str) -> Column:
        live = S.SETPOINT_OF.get(s)
        return (F.col(live) if live in features.columns else F.lit(None).cast("double")).alias("target")

    return features.select("asset_id", "us", "mode_key", F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value"), target(s),
                 *[feature(s, n) for n in TREND_MEANS + TREND_LASTS]) for s in chosen])))


def trend_series(features: DataFrame, signals: Sequence[str], rules: DataFrame, value: int = 6, unit: str = "hours",
                 bucket: str = "raw", max_points: int = 600) -> DataFrame:
    """Trend points of one or several signals: range, buckets, thinning, limits and live target, one job for all series."""
    ranged = time_range(features, value, unit) if unit != "points" else last_points(features, value)
    rows = bucketed_or_raw(trend_rows(ranged, signals), bucket, means=[*TREND_MEANS, "target"], lasts=[*TREND_LASTS, "mode_key"])
    limits = signal_limits(rules)
    mode = "normalized" if len(dict.fromkeys(signals)) > 1 else "single"
    return thinned(rows, max_points).join(broadcast_if_small(limits), "signal", "left").withColumn("correlation_mode", F.lit(mode))


def trend_summary(points: DataFrame) -> DataFrame:
    """Latest, previous and extremes over the returned points (at most ``max_points`` per series)."""
    ordered = Window.partitionBy("asset_id", "signal").orderBy("us")
    paired = points.withColumn("_previous", F.coalesce(F.lag("value").over(ordered), F.when(F.lag("us").over(ordered).isNull(), F.col("value"))))
    last = F.max_by(F.struct("value", "_previous", "target", *TREND_LASTS, "std_1h"), "us")
    found = paired.groupBy("asset_id", "signal").agg(
        last.alias("_l"), F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.count(F.lit(1)).alias("points"))
    return found.select("asset_id", "signal", F.col("_l.value").alias("latest"), F.col("_l._previous").alias("previous"),
                        F.col("_l.target").alias("target_current"), "mean", "minimum", "maximum",
                        (F.col("_l.value") - F.col("_l._previous")).alias("delta"), *[F.col(f"_l.{c}") for c in (*TREND_LASTS, "std_1h")], "points")


def normalised(points: DataFrame, keys: Sequence[str] = ("asset_id", "signal")) -> DataFrame:
    """Values on 0 to 100 per series; a constant series sits at 50. Extremes are an aggregate, joined back."""
    bounds = points.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    share = (F.col("value") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * 100.0
    return points.join(small_side(bounds), list(keys)).withColumn(
        "normalized", F.when(F.col("value").isNotNull(), F.coalesce(share, F.lit(50.0)))).drop("_lo", "_hi")


def alert_counts(active: DataFrame) -> DataFrame:
    return active.where(F.col("signal").isNotNull()).groupBy("asset_id", "signal").agg(F.count(F.lit(1)).alias("active_alerts"))


def catalogue_entries(subsystem: str | None = None, text: str | None = None, present: Sequence[str] = ()) -> Column:
    """The catalogue as an array of literal structs, already filtered; exploding it per asset needs no join."""
    ranks = {s: i for i, (_sub, s) in enumerate(S.DEFAULT_SIGNALS)}
    entries = []
    for ordinal, (sub, signal, label, unit) in enumerate(S.SIGNALS):
        if signal not in present or (subsystem and subsystem not in ("all", sub)):
            continue
        if text and text.lower() not in f"{label} {signal} {sub}".lower():
            continue
        values = {"ordinal": F.lit(ordinal), "signal": F.lit(signal), "label": F.lit(label), "subsystem": F.lit(sub), "unit": F.lit(unit).cast("string"),
                  "is_setpoint": F.lit(signal.startswith("sp_")), "is_derived": F.lit(signal in S.DERIVED_SIGNALS),
                  "target_signal": F.lit(S.SETPOINT_OF.get(signal)).cast("string"), "default_rank": F.lit(ranks.get(signal)).cast("int")}
        entries.append(F.struct(*[c.alias(n) for n, c in values.items()]))
    return F.array(*entries)


def signal_catalogue(readings: DataFrame, active: DataFrame, rules: DataFrame, subsystem: str | None = None, text: str | None = None) -> DataFrame:
    """Numeric signals the readings have, per asset, with limits, setpoint link and active alerts."""
    present = [s for s in S.NUMERIC_SIGNALS if s in readings.columns]
    items = readings.select("asset_id").distinct().select("asset_id", F.inline(catalogue_entries(subsystem, text, present)))
    return (
        items.join(broadcast_if_small(signal_limits(rules)), "signal", "left")
        .join(alert_counts(active), ["asset_id", "signal"], "left")
        .withColumn("active_alerts", F.coalesce("active_alerts", F.lit(0)))
    )


def display_order() -> list[Column]:
    """Order of the signal list: most alerts first, setpoints last, then by label."""
    return [F.col("active_alerts").desc(), F.col("is_setpoint"), F.col("label")]


def default_signal(catalogue: DataFrame) -> DataFrame:
    """The signal a screen starts with: first available default, else the first signal."""
    return catalogue.groupBy("asset_id").agg(F.coalesce(F.min_by("signal", "default_rank"), F.min_by("signal", "ordinal")).alias("default_signal"))


def service_coverage(readings: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row, also without data: time span, rows, events, active alerts, status."""
    span = readings.agg(F.min("us").alias("earliest_us"), F.max("us").alias("latest_us"), F.count(F.lit(1)).alias("history_rows"))
    events = episodes.agg(F.count(F.lit(1)).alias("alert_events"), F.count_if("is_active").alias("active_alerts"))
    both = span.unionByName(events, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn(
        "status", F.when(F.col("latest_us").isNull(), "waiting_for_data").otherwise("ok"))


def current_flow(readings: DataFrame, p: FlowParameters = FlowParameters()) -> DataFrame:
    """Flow estimate of the newest reading, recomputed from current where a column is missing, with the conditions."""
    last = latest_rows(readings.select("asset_id", "us", "pv_corr_motor_a", *[
        c for c in ("qn_m3h", "q_perda_m3h", "q_utilizacao_pct", "qa_m3h") if c in readings.columns]))
    again = flow_columns(F.col("pv_corr_motor_a"), p)
    ambient = ambient_columns(*[F.lit(v) for v in (p.relative_humidity_pct, p.saturation_vapor_kpa, p.atmospheric_pressure_kpa, p.suction_temperature_c)])
    return last.select(
        "asset_id", "us", F.col("pv_corr_motor_a").alias("current_a"),
        *[(F.coalesce(F.col(c), again[c]) if c in last.columns else again[c]).alias(c) for c in again],
        F.lit(p.current_to_normal).alias("factor"), *[c.alias(n) for n, c in ambient.items()])
