"""From raw rows to readings: timestamps, numbers, switches, duplicates, derived quantities, operating mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import signals as S
from ..config import LOOKBACK_US, FlowParameters
from ..functions.columns import epoch_micros, flow_columns, is_normal_operation, mode_key, number_or_null, parse_number, parse_switch
from ..session import small_side

# --- fixed values: timestamp layouts, tried in this order; day before month, month first only as a last resort ---
DAY_FIRST_LAYOUTS = ["d/M/yyyy H:mm:ss"]
ISO_LAYOUTS = ["yyyy-M-d H:mm:ss", "yyyy-M-d H:mm:ss.SSSSSS", "yyyy-M-d H:mm:ss.SSS", "yyyy-M-d'T'H:mm:ss",
               "yyyy-M-d'T'H:mm:ss.SSSSSS", "yyyy-M-d'T'H:mm:ss.SSS", "yyyy-M-d H:mm", "yyyy-M-d"]
FREE_LAYOUTS = ["d/M/yyyy H:mm:ss.SSSSSS", "d/M/yyyy H:mm", "d-M-yyyy H:mm:ss", "d-M-yyyy H:mm", "d/M/yyyy", "d-M-yyyy"]
MONTH_FIRST_LAYOUTS = ["M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M-d-yyyy H:mm:ss", "M-d-yyyy H:mm", "M/d/yyyy", "M-d-yyyy"]
# --- end of fixed values ---


def parse_timestamp(text: Column) -> Column:
    """First layout that fits, else NULL. Fractional ISO seconds are read as ISO, never as day first."""
    trimmed = F.trim(text)
    layouts = DAY_FIRST_LAYOUTS + ISO_LAYOUTS + FREE_LAYOUTS + MONTH_FIRST_LAYOUTS
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(layout)) for layout in layouts]).cast("timestamp_ntz")


def coerce_types(df: DataFrame) -> DataFrame:
    """Raw columns to their types: numbers with comma or point, integer status, three-valued switch, text states."""
    kinds = dict(df.dtypes)
    changed: dict[str, Column] = {}
    for name, kind in kinds.items():
        if name in S.NUMERIC_SIGNALS:
            changed[name] = parse_number(F.col(name)) if kind == "string" else number_or_null(F.col(name).cast("double"))
        elif name == "status":
            changed[name] = (parse_number(F.col(name)) if kind == "string" else F.col(name).cast("double")).cast("int")
        elif name == "st_plc" and kind != "boolean":
            changed[name] = parse_switch(F.col(name))
        elif name in S.TEXT_COLUMNS:
            changed[name] = F.col(name).cast("string")
    return df.withColumns(changed)


def valid_times(df: DataFrame, raw: str = "timestamp") -> DataFrame:
    """Parse the event time and drop rows without one. Typed timestamps are taken as they are."""
    parsed = parse_timestamp(F.col(raw)) if dict(df.dtypes)[raw] == "string" else F.col(raw).cast("timestamp_ntz")
    timed = df.withColumn("ts", parsed)
    if raw != "ts":
        timed = timed.drop(raw)
    return timed.where(F.col("ts").isNotNull()).withColumn("us", epoch_micros("ts"))


def keep_last(df: DataFrame, keys: Sequence[str] = ("asset_id", "us"), order: Sequence[str] = ("id",)) -> DataFrame:
    """One row per key, the last in ``order``. Copies are dropped map-side first, so a group of copies stays small."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def time_issue_counts(df: DataFrame, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Rows lost to unreadable times and to duplicate times, per asset; ``us`` is NULL where the time is unreadable.

    Copies are counted per (asset, time) first, with a map-side combine, and only those counts are summed.
    """
    per_time = df.groupBy(*keys, "us").agg(F.count(F.lit(1)).alias("_copies"))
    return per_time.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("us").isNull(), F.col("_copies"))), F.lit(0)).alias("invalid_timestamp"),
        F.coalesce(F.sum(F.when(F.col("us").isNotNull(), F.col("_copies") - 1)), F.lit(0)).alias("duplicate_timestamp"),
    )


def add_derived(df: DataFrame, flow: FlowParameters | DataFrame = FlowParameters()) -> DataFrame:
    """Filter differential, row-wise maxima and flow estimate. Flow parameters may be a per-asset table."""
    vibration = [F.col(f"pv_vib_estagio_{stage}_mils") for stage in (1, 2, 3)]
    stator = [F.col(f"pv_temp_fase_{phase}_do_estator_c") for phase in "abc"]
    per_asset = isinstance(flow, DataFrame)
    if per_asset:
        parameters = [c for c in flow.columns if c != "asset_id"]
        df = df.join(small_side(flow), "asset_id", "left")
    derived = {
        "delta_filtro_oleo_bar": F.col("pv_pres_oleo_antes_filtro_bar") - F.col("pv_pres_oleo_bar"),
        "pv_vib_max_mils": F.greatest(*vibration),
        "pv_temp_estator_max_c": F.greatest(*stator),
    } | flow_columns(F.col("pv_corr_motor_a"), None if per_asset else flow)
    out = df.withColumns(derived)
    return out.drop(*parameters) if per_asset else out


def add_mode(df: DataFrame) -> DataFrame:
    return df.withColumns({"mode_key": mode_key(), "is_normal_operation": is_normal_operation()})


def with_all_signals(df: DataFrame) -> DataFrame:
    """Absent optional columns as typed NULLs, so that downstream plans do not depend on the source."""
    wanted = {s: "double" for s in S.MEASURED_SIGNALS} | {"st_oper": "string", "st_carga_oper": "string"}
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in df.columns})


def clean_readings(raw: DataFrame, order: Sequence[str] = ("id",), flow: FlowParameters | DataFrame = FlowParameters(),
                   time: str = "timestamp") -> DataFrame:
    """The whole path from normalised raw rows to readings."""
    timed = keep_last(valid_times(raw, time), order=order)
    return add_mode(add_derived(with_all_signals(coerce_types(timed)), flow))


def merge_history(history: DataFrame, fresh: DataFrame, lookback_us: int | None = LOOKBACK_US) -> DataFrame:
    """Add new rows to the history, newest source wins per time, keep only ``lookback_us`` behind each asset's newest row."""
    columns = [c for c in history.columns if c in fresh.columns]
    merged = keep_last(
        history.select(*columns, F.lit(0).alias("_source")).unionByName(fresh.select(*columns, F.lit(1).alias("_source"))),
        order=("_source",),
    ).drop("_source")
    if lookback_us is None:
        return merged
    bounds = (
        history.select("asset_id", "us").unionByName(fresh.select("asset_id", "us"))
        .groupBy("asset_id").agg((F.max("us") - lookback_us).alias("_from"))
    )
    return merged.join(small_side(bounds), "asset_id").where(F.col("us") >= F.col("_from")).drop("_from")
