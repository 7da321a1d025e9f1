"""Segmentation and rolling features (2.D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import signals as S
from ..config import DAY_US
from ..operators.features import FEATURES, STATISTICS, feature_rows, features_wide, rolling_features, rolling_statistics, smoothed_values
from ..operators.timeslice import slice_by_time
from . import dataset as D
from .common import query, r, sr

PAIR = ["pv_corr_motor_a", "pv_pres_sistema_bar"]


def _compare(name: str, features: list[str], places: int = 4):
    """Register the given window features of two signals, one of them with gaps."""
    columns = [f"{s}__{f}" for s in PAIR for f in features]
    sql = (f"WITH {D.features_sql({s: features for s in PAIR})} SELECT asset_id, us, "
           f"{', '.join(sr(c, c, places) for c in columns)} FROM features")

    @query(name, sql)
    def run(spark, sf):
        rows = rolling_statistics(D.readings(spark, sf), {s: features for s in PAIR}, D.WIDTHS)
        return rows.select("asset_id", "us", *[r(c, places) for c in columns])

    return run


@query("d1_mode_segments", f"""
WITH {D.SEGMENTS_SQL} SELECT asset_id, us, row_idx, segment_id FROM numbered""")
def mode_segments(spark, sf):
    return D.numbered(spark, sf).select("asset_id", "us", "row_idx", "segment_id")


_compare("d2_rolling_mean", ["ma_5m", "ma_15m", "ma_1h"])
_compare("d3_rolling_std", ["std_15m", "std_1h"])
_compare("d4_rolling_min_max", ["min_15m", "max_15m", "min_1h", "max_1h"])
_compare("d5_rolling_slope", ["slope_15m", "slope_1h"], 6)
_compare("d7_zscore", ["zscore_1h"])


_SPLIT = ["ma_5m", "ma_1h", "std_15m", "min_15m", "max_1h", "slope_1h", "zscore_1h"]


@query("d2_d7_frames_of_crowded_cells", f"""
WITH {D.features_sql({s: _SPLIT for s in PAIR})}
SELECT asset_id, us, {', '.join(sr(f'{s}__{f}', f'{s}__{f}') for s in PAIR for f in _SPLIT)} FROM features""")
def frames_of_crowded_cells(spark, sf):
    """Cells of ten days with a low limit, so that every frame crosses sub-cells."""
    rows = rolling_statistics(D.readings(spark, sf), {s: _SPLIT for s in PAIR}, D.WIDTHS, cell_us=10 * DAY_US, max_rows=600)
    return rows.select("asset_id", "us", *[r(f"{s}__{f}") for s in PAIR for f in _SPLIT])


@query("d6_d8_weighted_average", f"""
WITH {D.features_sql({s: ['ewma', 'ewma_gap_abs'] for s in PAIR})}
SELECT asset_id, us, {', '.join(sr(f'{s}__{f}', f'{s}__{f}') for s in PAIR for f in ('ewma', 'ewma_gap_abs'))} FROM features""")
def weighted_average(spark, sf):
    rows = smoothed_values(D.numbered(spark, sf).select("asset_id", "us", "row_idx", "segment_id", *PAIR), PAIR)
    return rows.select("asset_id", "us", *[r(f"{s}__{f}") for s in PAIR for f in ("ewma", "ewma_gap_abs")])


_ALL = list(S.NUMERIC_SIGNALS)
_WIDE_PAIR = ["pv_vib_max_mils", "pv_temp_oleo_lubrificacao_c"]


def _long_feature_sql() -> str:
    names = [f for f in STATISTICS if not f.startswith("slope")]
    picked = ", ".join(f"{s}::DOUBLE AS {s}" for s in _ALL)
    return f"""
WITH {D.SEGMENTS_SQL},
wide AS (SELECT asset_id, us, segment_id, {picked} FROM numbered),
melted AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR signal IN ({', '.join(_ALL)}))),
features AS (SELECT *, {', '.join(f'{_by_signal(D.feature_sql("value", f))} AS {f}' for f in names)} FROM melted)
SELECT asset_id, us, segment_id, signal, {sr('value', 'value')}, {', '.join(sr(f, f) for f in names)} FROM features"""


def _by_signal(text: str) -> str:
    return text.replace("PARTITION BY asset_id, segment_id", "PARTITION BY asset_id, signal, segment_id")


@query("d9_feature_assembly_all_signals", _long_feature_sql())
def feature_assembly(spark, sf):
    names = [f for f in STATISTICS if not f.startswith("slope")]
    rows = feature_rows(rolling_features(D.readings(spark, sf), {s: names for s in _ALL}, D.WIDTHS), _ALL, names)
    return rows.select("asset_id", "us", "segment_id", "signal", r("value"), *[r(n) for n in names])


@query("d9_feature_columns", f"""
WITH {D.features_sql({s: FEATURES for s in _WIDE_PAIR})}
SELECT asset_id, us, {', '.join(sr(f'{s}__{f}', f'{s}__{f}') for s in _WIDE_PAIR for f in FEATURES)} FROM features""")
def feature_columns(spark, sf):
    features = rolling_features(D.readings(spark, sf), {s: FEATURES for s in _WIDE_PAIR}, D.WIDTHS)
    wide = features_wide(feature_rows(features, _WIDE_PAIR), _WIDE_PAIR)
    return wide.select("asset_id", "us", *[r(f"{s}__{f}") for s in _WIDE_PAIR for f in FEATURES])


@query("d0_time_slices", f"""
WITH {D.READINGS_SQL} SELECT asset_id, us - us % 86400000000 AS slice_us, count(*) AS readings FROM readings GROUP BY 1, 2""")
def time_slices(spark, sf):
    return slice_by_time(D.readings(spark, sf)).groupBy("asset_id", "slice_us").agg(F.count(F.lit(1)).alias("readings"))
