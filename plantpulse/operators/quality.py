"""Data-quality issues of a batch: nulls, recurrent zeros, stuck sensors, implausible values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import signals as S
from ..config import StuckParameters, ZeroParameters
from ..functions.columns import long_rows
from ..session import literal_table
from .cleaning import time_issue_counts
from .timeslice import KEYS, newest_rows

# --- fixed values: issue messages ---
MESSAGES = {
    "invalid_timestamp": "Linhas com timestamp invalido foram descartadas.",
    "duplicate_timestamp": "Timestamps duplicados foram consolidados mantendo a ultima leitura.",
    "nulls": "Foram encontrados valores nulos na coluna.",
    "zero_abnormal": "Valor zerado recorrente detectado para uma variavel sensivel.",
    "sensor_stuck": "Possivel sensor travado por repeticao persistente do mesmo valor.",
    "plausibility": "Valor fora da faixa plausivel basica.",
}
# --- end of fixed values ---


def observations(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Long rows that have a value."""
    return df.select("asset_id", "us", long_rows(list(signals))).where(F.col("value").isNotNull())


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with missing values and how many, in one pass over the table."""
    columns = [c for c in (columns or df.columns) if c != "asset_id"]
    counts = df.groupBy("asset_id").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    entries = [F.struct(F.lit(c).alias("signal"), F.col(c).alias("null_count")) for c in columns]
    return counts.select("asset_id", F.inline(F.array(*entries))).where(F.col("null_count") > 0)


def recurrent_zeros(df: DataFrame, signals: Sequence[str] = S.ZERO_ABNORMAL, p: ZeroParameters = ZeroParameters()) -> DataFrame:
    """Signals whose newest values are all zero."""
    last = newest_rows(observations(df, signals), p.points, (*KEYS, "signal"))
    return (
        last.groupBy("asset_id", "signal")
        .agg(F.count(F.lit(1)).alias("window_points"), F.max(F.abs("value")).alias("_largest"))
        .where((F.col("window_points") >= p.minimum) & (F.col("_largest") == 0)).drop("_largest")
    )


def stuck_threshold(value: Column, p: StuckParameters) -> Column:
    return F.greatest(F.abs(value) * p.relative_range, F.lit(p.absolute_range))


def stuck_sensors(df: DataFrame, signals: Sequence[str] = S.STUCK_CANDIDATES, p: StuckParameters = StuckParameters()) -> DataFrame:
    """Signals that hardly moved over their newest ``p.points`` values, with the evidence."""
    series = Window.partitionBy("asset_id", "signal").orderBy("us")
    last = newest_rows(observations(df, signals), p.points, (*KEYS, "signal"))
    steps = last.withColumn("_step", (F.col("us") - F.lag("us").over(series)) / 6e7)
    found = steps.groupBy("asset_id", "signal").agg(
        F.max_by("value", "us").alias("repeated_value"),
        F.count(F.lit(1)).alias("window_points"),
        ((F.max("us") - F.min("us")) / 6e7 + F.coalesce(F.median("_step"), F.lit(0.0))).alias("window_minutes"),
        (F.max("value") - F.min("value")).alias("observed_range"),
        F.stddev_pop("value").alias("observed_std"),
    )
    limit = stuck_threshold(F.col("repeated_value"), p)
    return found.where(
        (F.col("window_points") >= p.points) & (F.col("window_minutes") >= p.minutes)
        & (F.col("observed_range") <= limit) & (F.col("observed_std") <= limit / 2.0)
    ).withColumns({
        "window_minutes": F.round("window_minutes", 1),
        "observed_range": F.round("observed_range", 6),
        "observed_std": F.round("observed_std", 6),
    })


def implausible_values(df: DataFrame) -> DataFrame:
    """Signals outside their plausible range: latest violating value and time, with the calibration hint if any."""
    spark = df.sparkSession
    ranges = literal_table(spark, "signal string, min double, max double, hint string", [
        {"signal": s, "min": low, "max": high, "hint": S.CALIBRATION_HINTS.get(s)} for s, low, high in S.PLAUSIBLE_RANGES
    ])
    outside = observations(df, [s for s, _low, _high in S.PLAUSIBLE_RANGES]).join(F.broadcast(ranges), "signal").where(
        (F.col("value") < F.col("min")) | (F.col("value") > F.col("max"))
    )
    return outside.groupBy("asset_id", "signal").agg(
        F.first("min").alias("min"), F.first("max").alias("max"), F.first("hint").alias("engineering_hint"),
        F.max_by("value", "us").alias("last_value"), F.max("us").alias("us"),
    )


def _issue(kind: str, at: Column, details: dict[str, Column], signal: Column | None = None) -> list[Column]:
    pairs = [part for name, value in details.items() for part in (F.lit(name), value.cast("string"))]
    return [
        F.col("asset_id"),
        F.lit(kind).alias("issue_type"),
        (F.col("signal") if signal is None else signal).cast("string").alias("signal"),
        at.cast("bigint").alias("us"),
        F.lit(MESSAGES[kind]).alias("message"),
        F.map_filter(F.create_map(*pairs), lambda _k, v: v.isNotNull()).alias("details"),
    ]


def collect_issues(raw_times: DataFrame, readings: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All issues of a batch in one table. ``raw_times`` is (asset_id, us) before rows were dropped."""
    newest = readings.groupBy("asset_id").agg(F.max("us").alias("_newest"))
    none = F.lit(None)
    counts = time_issue_counts(raw_times)
    return (
        counts.where(F.col("invalid_timestamp") > 0).select(*_issue("invalid_timestamp", none, {"count": F.col("invalid_timestamp")}, none))
        .unionByName(counts.where(F.col("duplicate_timestamp") > 0)
                     .select(*_issue("duplicate_timestamp", none, {"count": F.col("duplicate_timestamp")}, none)))
        .unionByName(null_profile(readings, columns).select(*_issue("nulls", none, {"count": F.col("null_count")})))
        .unionByName(recurrent_zeros(readings).join(newest, "asset_id")
                     .select(*_issue("zero_abnormal", F.col("_newest"), {"window_points": F.col("window_points")})))
        .unionByName(stuck_sensors(readings).join(newest, "asset_id").select(*_issue("sensor_stuck", F.col("_newest"), {
            c: F.col(c) for c in ("repeated_value", "window_points", "window_minutes", "observed_range", "observed_std")})))
        .unionByName(implausible_values(readings).select(*_issue("plausibility", F.col("us"), {
            c: F.col(c) for c in ("min", "max", "last_value", "engineering_hint")})))
    )


def current_issues(issues: DataFrame, readings: DataFrame) -> DataFrame:
    """Issues without a time or raised at the asset's latest reading."""
    latest = readings.groupBy("asset_id").agg(F.max("us").alias("_latest"))
    return issues.join(latest, "asset_id").where(F.col("us").isNull() | (F.col("us") == F.col("_latest"))).drop("_latest")
