"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import signals as S
from ..config import FlowParameters


def epoch_micros(ts: str | Column = "ts") -> Column:
    """Event time as whole microseconds; range frames and slices use this BIGINT."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def number_or_null(value: Column) -> Column:
    """NaN would sort above every number, so a missing measurement is always NULL."""
    return F.when(~F.isnan(value), value)


def parse_number(text: Column) -> Column:
    """Text to DOUBLE with a decimal comma or point; anything else is NULL."""
    return number_or_null(F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double"))


def parse_switch(text: Column) -> Column:
    """Three-valued switch: NULL stays NULL, listed words are true, any other text is false."""
    return F.when(text.isNotNull(), F.lower(F.trim(text.cast("string"))).isin(S.TRUE_WORDS))


def mode_key(oper: str = "st_oper", load: str = "st_carga_oper") -> Column:
    unknown = F.lit(S.UNKNOWN_STATE)
    return F.concat(F.coalesce(F.col(oper), unknown), F.lit("|"), F.coalesce(F.col(load), unknown))


def is_transition(oper: str = "st_oper") -> Column:
    """True for the four changing states; a missing state does not count as one."""
    return F.coalesce(F.col(oper).isin(S.TRANSITION_STATES), F.lit(False))


def is_normal_operation(oper: str = "st_oper", load: str = "st_carga_oper") -> Column:
    return F.coalesce((F.col(oper) == S.RUNNING) & (F.col(load) == S.LOADED), F.lit(False))


def flow_columns(current: Column, p: FlowParameters | None = None) -> dict[str, Column]:
    """Flow estimated from motor current. Impossible parameters give NULL instead of an error.

    With ``p=None`` the parameters are columns of the row (joined from a per-asset dimension).
    """
    if p is None:
        nominal, rated, idle, factor = (F.col(c) for c in ("nominal_flow", "nominal_current", "no_load_current", "current_to_normal"))
    else:
        nominal, rated, idle, factor = (F.lit(v) for v in (p.nominal_flow, p.nominal_current, p.no_load_current, p.current_to_normal))
    valid = (rated > idle) & (factor > 0)
    share = nominal * ((current - idle) / F.nullif(rated - idle, F.lit(0.0)))
    qn = F.when(valid & current.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), nominal))
    return {
        "qn_m3h": qn,
        "q_perda_m3h": F.when(qn.isNotNull(), F.greatest(nominal - qn, F.lit(0.0))),
        "q_utilizacao_pct": qn / F.nullif(nominal, F.lit(0.0)) * 100.0,
        "qa_m3h": qn / F.nullif(factor, F.lit(0.0)),
    }


def ambient_columns(humidity: Column, saturation: Column, pressure: Column, temperature: Column) -> dict[str, Column]:
    """Partial pressures at the inlet and the factor that turns suction flow into normal flow."""
    vapour = humidity / 100.0 * saturation
    dry = pressure - vapour
    return {
        "vapor_kpa": vapour,
        "dry_air_kpa": dry,
        "normal_factor": dry / F.nullif(pressure, F.lit(0.0)) * (F.lit(273.15) / F.nullif(temperature + 273.15, F.lit(0.0))),
    }


def noise_floor(value: Column, ratio: float = 0.02, minimum: float = 0.05) -> Column:
    return F.greatest(F.abs(value) * ratio, F.lit(minimum))


def violates(condition: Column, value: Column, threshold: Column, low: Column, high: Column) -> Column:
    """Rule predicate; ``between`` names the allowed band, so the rule fires outside it."""
    return (
        F.when(condition == "gt", value > threshold)
        .when(condition == "gte", value >= threshold)
        .when(condition == "lt", value < threshold)
        .when(condition == "lte", value <= threshold)
        .when(condition == "between", (value < low) | (value > high))
        .otherwise(F.lit(False))
    )


def threshold_text(condition: Column, threshold: Column, low: Column, high: Column) -> Column:
    return F.when(condition == "between", F.concat(low.cast("string"), F.lit(".."), high.cast("string"))).otherwise(
        F.concat(condition, F.lit(" "), threshold.cast("string"))
    )


def mode_allowed(allowed: Column, mode: Column) -> Column:
    return allowed.isNull() | (F.size(allowed) == 0) | F.array_contains(allowed, mode)


def alert_identity(rule: Column, subsystem: Column, signal: Column, layer: Column) -> Column:
    return F.sha1(F.concat_ws("|", rule, subsystem, F.coalesce(signal, F.lit("")), layer))


def long_rows(signals: list[str], name: str = "signal", value: str = "value", prefix: str = "") -> Column:
    """Wide to long by exploding an array of structs; unlike unpivot this keeps the child's partitioning."""
    return F.inline(F.array(*[
        F.struct(F.lit(s).alias(name), F.col(f"{prefix}{s}").cast("double").alias(value)) for s in signals
    ]))
