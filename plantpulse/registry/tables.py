"""Staged tables the alert, forecast and serving queries share: numbered readings, features, flags, hits, episodes.

They are written once per session and data folder, as a deployment would keep them, and read back. The stages are
ordinary DataFrames; queries about a stage itself compute it directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import alerts, episodes, prescribe
from ..operators.features import rolling_features
from ..operators.timeslice import SLICE
from ..plans.monitoring import feature_plan
from ..session import stored
from ..sources.rules import builtin_rules, forecast_rules
from ..operators.forecast import rule_signals
from . import dataset as D

_STAGES: dict[tuple[str, str, str], DataFrame] = {}


def _stage(name: str, spark: SparkSession, sf: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = _key(name, spark, sf)
    if key not in _STAGES:
        _STAGES[key] = stored(build())
    return _STAGES[key]


def _key(name: str, spark: SparkSession, sf: str) -> tuple[str, str, str]:
    return spark.sparkContext.applicationId, sf, name


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return _stage("numbered", spark, sf, lambda: D.numbered(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with every feature that rules, flags and forecasts read."""
    def build() -> DataFrame:
        rows = numbered(spark, sf)
        return rolling_features(rows, feature_plan(rule_signals(forecast_rules(spark), rows)), D.WIDTHS, numbered=True, whole_rows=True)

    return _stage("features", spark, sf, build)


def _trend_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features that trend rules read. Hits read them once, so they are stored only where all features are staged already."""
    if _key("features", spark, sf) in _STAGES:
        return features(spark, sf)
    plan = alerts.trend_feature_plan()
    rows = numbered(spark, sf).select(*alerts.PLACE, SLICE, "segment_id", *plan)
    return rolling_features(rows, plan, D.WIDTHS, numbered=True)


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return _stage("hits", spark, sf, lambda: alerts.all_hits(numbered(spark, sf), builtin_rules(spark), trends=_trend_features(spark, sf)))


def flags(spark: SparkSession, sf: str) -> DataFrame:
    """The active flags of each reading; the features behind them are read once and not stored."""
    return _stage("flags", spark, sf, lambda: prescribe.flag_table(
        rolling_features(numbered(spark, sf), prescribe.flag_feature_plan(), D.WIDTHS, numbered=True)))


def all_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return _stage("episodes", spark, sf, lambda: episodes.mark_active(
        episodes.build_episodes(hits(spark, sf)), numbered(spark, sf)))
