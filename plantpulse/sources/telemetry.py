"""Reading scans: CSV history, recent window, increments, newest rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import signals as S
from ..config import FALLBACK_ROWS
from ..operators.timeslice import newest_rows
from ..session import small_side

_TAG = re.compile(r"^﻿?(?:[0-9A-Za-z]+_)?((?:PV|SP|ST)_.+)$")


def friendly_name(column: str) -> str:
    """Column name of a raw export column: known export names, plant tags with any machine prefix, else unchanged."""
    column = column.lstrip("﻿")
    if column in S.EXPORT_COLUMNS:
        return S.EXPORT_COLUMNS[column]
    tag = _TAG.match(column)
    if not tag:
        return column
    plain = S.IRREGULAR_TAGS.get(tag.group(1), tag.group(1).lower())
    return plain if plain in S.SUBSYSTEM_OF else column


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename known raw columns; unknown ones keep their name."""
    return df.withColumnsRenamed({c: friendly_name(c) for c in df.columns if friendly_name(c) != c})


def read_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Raw history as text columns. Numbers keep their decimal comma until they are parsed value by value."""
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding="UTF-8")
    return normalise_columns(raw)


def csv_history(spark: SparkSession, path: str, sep: str = ";", since_us: int | None = None,
                newest: int | None = None, order: tuple[str, ...] = ("id",), asset: str = "asset_id") -> DataFrame:
    """CSV rows as readings, optionally after a mark and only the newest rows per asset."""
    from ..operators.cleaning import clean_readings

    raw = read_csv(spark, path, sep).withColumn("asset_id", F.col(asset).try_cast("bigint"))
    if "id" in raw.columns:
        raw = raw.withColumn("id", F.col("id").try_cast("bigint"))
    rows = clean_readings(raw, order=order)
    if since_us is not None:
        rows = rows.where(F.col("us") > since_us)
    return rows if newest is None else newest_rows(rows, newest).drop("rank_desc")


def recent_window(readings: DataFrame, since_us: int, oldest: int | None = None) -> DataFrame:
    """Rows from ``since_us`` on. The bound is a literal on the event time, so it reaches the file scan."""
    rows = readings.where(F.col("ts") >= F.timestamp_micros(F.lit(since_us)).cast("timestamp_ntz"))
    return rows if oldest is None else rows.orderBy("us", "asset_id").limit(oldest)


def after_mark(readings: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows strictly after each asset's high-water mark (``asset_id, mark_us``); assets without a mark give all rows."""
    joined = readings.join(small_side(marks), "asset_id", "left")
    return joined.where(F.col("mark_us").isNull() | (F.col("us") > F.col("mark_us"))).drop("mark_us")


def high_water_marks(readings: DataFrame) -> DataFrame:
    return readings.groupBy("asset_id").agg(F.max("us").alias("mark_us"))


def window_or_newest(readings: DataFrame, since_us: int, fallback: int = FALLBACK_ROWS) -> DataFrame:
    """The recent window; an asset with nothing in it gives its newest ``fallback`` rows instead."""
    inside = readings.where(F.col("us") >= since_us)
    silent = high_water_marks(readings).where(F.col("mark_us") < since_us).select("asset_id")
    older = newest_rows(readings.join(small_side(silent), "asset_id", "left_semi"), fallback).drop("rank_desc")
    return inside.unionByName(older.select(*inside.columns))
