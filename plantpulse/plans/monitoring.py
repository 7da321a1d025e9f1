"""One monitoring cycle: readings to features, hits, episodes, forecasts, diagnoses and scores.

Each stage is a DataFrame. Stages that several later ones read (numbered readings, features, episodes) can be written
to the shared folder, which also cuts the lineage; by default everything stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import ForecastParameters, WindowWidths
from ..operators import alerts, episodes, features, forecast, prescribe
from ..sources.rules import builtin_rules, forecast_rules


@dataclass
class Cycle:
    features: DataFrame
    episodes: DataFrame
    active: DataFrame
    scores: DataFrame
    diagnoses: DataFrame


def feature_plan(forecast_signals: list[str] | None = None) -> dict[str, list[str]]:
    """Exactly the features that rules, flags and forecasts read; other features are not computed."""
    plan: dict[str, set[str]] = {}
    for part in (alerts.trend_feature_plan(), prescribe.flag_feature_plan(),
                 {s: ["zscore_1h", "ewma_gap_abs"] for s in forecast_signals or []}):
        for signal, names in part.items():
            plan.setdefault(signal, set()).update(names)
    return {s: sorted(names) for s, names in plan.items()}


def run_cycle(
    readings: DataFrame,
    widths: WindowWidths = WindowWidths(),
    rules: DataFrame | None = None,
    forecasting: ForecastParameters | None = ForecastParameters(),
    issues: DataFrame | None = None,
    store: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Cycle:
    spark = readings.sparkSession
    rules = builtin_rules(spark) if rules is None else rules
    outlook = forecast_rules(spark)
    watched = forecast.rule_signals(outlook, readings) if forecasting else []
    featured = store(features.rolling_features(readings, feature_plan(watched), widths, whole_rows=True))
    hits = store(alerts.all_hits(featured, rules, issues))
    history = store(episodes.mark_active(episodes.build_episodes(hits), featured))
    if forecasting:
        decided = forecast.forecast_decision(
            forecast.forecast_measures(featured, outlook, history.where("is_active"), forecasting), forecasting)
        history = forecast.merge_alerts(history, forecast.forecast_alerts(decided))
    active = episodes.active_alerts(history)
    scores = episodes.complete_scores(episodes.risk_scores(active), featured)
    return Cycle(featured, history, active, scores, prescribe.diagnose_alerts(history, featured))
