"""Numeric parameters with their default values. All of them are arguments, none is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


@dataclass(frozen=True)
class WindowWidths:
    """Widths of the rolling windows in microseconds."""

    short: int = 5 * MINUTE_US
    medium: int = 15 * MINUTE_US
    long: int = HOUR_US


@dataclass(frozen=True)
class FlowParameters:
    nominal_flow: float = 12000.0
    nominal_current: float = 180.0
    no_load_current: float = 0.0
    current_to_normal: float = 0.87658
    suction_temperature_c: float = 28.0
    relative_humidity_pct: float = 90.0
    atmospheric_pressure_kpa: float = 101.325
    saturation_vapor_kpa: float = 3.7831


@dataclass(frozen=True)
class StuckParameters:
    points: int = 45
    minutes: float = 45.0
    relative_range: float = 0.001
    absolute_range: float = 0.01
    history_rows: int = 181


@dataclass(frozen=True)
class ZeroParameters:
    points: int = 5
    minimum: int = 3
    history_rows: int = 181


@dataclass(frozen=True)
class ForecastParameters:
    min_points: int = 18
    min_r2: float = 0.55
    min_confidence: float = 0.68


#: history kept behind the newest reading
LOOKBACK_US = 24 * HOUR_US
#: rows returned when a recent-window scan finds nothing
FALLBACK_ROWS = 5000
#: span of the exponentially weighted average
EWMA_SPAN = 15
