"""The whole cycle in one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import signals as S
from ..plans.monitoring import run_cycle
from ..session import stored
from . import dataset as D
from .alerts import WEIGHT
from .common import query, r
from .forecast import _EPISODES_AND_FEATURES, _MEASURES_SQL

_SUBSYSTEMS = ", ".join(f"('{s}')" for s in S.SUBSYSTEMS)


@query("monitoring_cycle_scores", f"""
WITH {_EPISODES_AND_FEATURES}, {_MEASURES_SQL},
gone AS (SELECT DISTINCT asset_id, signal FROM episodes WHERE is_active),
pool AS (SELECT asset_id, subsystem, severity FROM episodes WHERE is_active
  UNION ALL SELECT d.asset_id, d.subsystem, d.severity FROM decided d ANTI JOIN gone g ON d.asset_id = g.asset_id AND d.signal = g.signal),
scored_pool AS (SELECT asset_id, subsystem, round(least(100e0, max({WEIGHT}) + 8e0 * (count(*) - 1)), 1) + 0e0 AS score, count(*) AS active_alerts FROM pool GROUP BY 1, 2),
sub(subsystem) AS (VALUES {_SUBSYSTEMS})
SELECT a.asset_id, sub.subsystem, coalesce(score, 0e0) AS score, coalesce(active_alerts, 0) AS active_alerts
FROM (SELECT DISTINCT asset_id FROM readings) a CROSS JOIN sub LEFT JOIN scored_pool s ON s.asset_id = a.asset_id AND s.subsystem = sub.subsystem""")
def monitoring_cycle_scores(spark, sf):
    cycle = run_cycle(D.readings(spark, sf), D.WIDTHS, store=stored)
    return cycle.scores.select("asset_id", "subsystem", r("score", 1), F.col("active_alerts").cast("bigint").alias("active_alerts"))
