"""Alert episodes: consecutive readings with the same alert form one episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import rules as R
from ..catalog.signals import SUBSYSTEMS
from ..session import small_side, stored
from .alerts import severity_weight
from .timeslice import KEYS, MAX_SLICE_ROWS, SLICE, dealt, slice_by_time

#: readings per block while islands are found; an alert that never stops has as many wide rows in a block, which one task sorts
EPISODE_BLOCK = 1 << 16

FROM_FIRST = ["rule_id", "layer", "subsystem", "signal", "severity", "title", "message"]
FROM_LAST = ["current_value", "threshold", "mode_key", "metadata"]
EPISODE = ["asset_id", "alert_id", *FROM_FIRST, *FROM_LAST, "triggered_us", "last_seen_us", "first_row", "last_row", "readings"]


def build_episodes(hits: DataFrame, block_rows: int = EPISODE_BLOCK) -> DataFrame:
    """Gaps and islands over the row number of the asset; one missing reading closes an episode.

    Islands are found per block of readings. Only islands that touch a block border can continue elsewhere: at most
    two per block and alert, and just those are stitched per (asset, alert). An alert that never stops and an alert
    that flickers at every reading both stay spread over blocks, and blocks are dealt to as many tasks as their hits need, which
    are counted first. Repeated hits of one reading count once.
    """
    block = F.floor((F.col("row_idx") - 1) / block_rows).cast("bigint")
    in_block = Window.partitionBy("asset_id", "alert_id", "_block").orderBy("row_idx")
    pieces = (
        dealt(hits.withColumn("_block", block), hits.count(), "asset_id", "alert_id", "_block")
        .withColumn("_island", F.col("row_idx") - F.dense_rank().over(in_block))
        .groupBy("asset_id", "alert_id", "_block", "_island")
        .agg(
            F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"),
            F.min("us").alias("triggered_us"), F.max("us").alias("last_seen_us"),
            (F.max("row_idx") - F.min("row_idx") + 1).alias("readings"),
            F.min_by(F.struct(*FROM_FIRST), "row_idx").alias("_first"), F.max_by(F.struct(*FROM_LAST), "row_idx").alias("_last"),
        )
        .withColumn("_open", (F.pmod(F.col("first_row") - 1, F.lit(block_rows)) == 0) | (F.pmod("last_row", F.lit(block_rows)) == 0))
    )
    along = Window.partitionBy("asset_id", "alert_id").orderBy("first_row")
    border = pieces.where("_open")
    stitched = (
        border.withColumn("_starts", F.when(F.lag("last_row").over(along) + 1 == F.col("first_row"), 0).otherwise(1))
        .withColumn("_episode", F.sum("_starts").over(along))
        .groupBy("asset_id", "alert_id", "_episode")
        .agg(
            F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"),
            F.min("triggered_us").alias("triggered_us"), F.max("last_seen_us").alias("last_seen_us"),
            F.sum("readings").alias("readings"),
            F.min_by("_first", "first_row").alias("_first"), F.max_by("_last", "first_row").alias("_last"),
        ).drop("_episode")
    )
    inner = pieces.where(~F.col("_open")).select(*stitched.columns)
    return inner.unionByName(stitched).select(
        "asset_id", "alert_id", "_first.*", "_last.*", "triggered_us", "last_seen_us", "first_row", "last_row", "readings"
    )


def mark_active(episodes: DataFrame, numbered: DataFrame) -> DataFrame:
    """An episode is active when its last reading is the asset's last reading."""
    newest = numbered.groupBy("asset_id").agg(F.max("us").alias("_newest"))
    return episodes.join(small_side(newest), "asset_id").withColumn("is_active", F.col("last_seen_us") == F.col("_newest")).drop("_newest")


def active_alerts(episodes: DataFrame) -> DataFrame:
    return episodes.where("is_active")


def event_order(weight: bool = True) -> list[Column]:
    """Newest first, then most severe; alert id keeps the order total."""
    ordered = [F.col("last_seen_us").desc()]
    if weight:
        ordered.append(severity_weight(F.col("severity")).desc())
    return [*ordered, F.col("asset_id"), F.col("alert_id"), F.col("triggered_us").desc()]


def placed_events(episodes: DataFrame, max_rows: int = MAX_SLICE_ROWS) -> DataFrame:
    """The place of each episode in its asset's history, newest first (``event_order``), however long the history is.

    Episodes are ranked inside time cells of at most ``max_rows`` (one instant holds no more than the rules); a cell's carry
    is the number of episodes in the asset's later cells.
    """
    cells = stored(slice_by_time(episodes, us="last_seen_us", max_rows=max_rows))
    later = Window.partitionBy(*KEYS).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.groupBy(*KEYS, SLICE).agg(F.count(F.lit(1)).alias("_n")).select(*KEYS, SLICE, F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    local = F.row_number().over(Window.partitionBy(*KEYS, SLICE).orderBy(*event_order()))
    placed = cells.withColumn("_local", local).join(small_side(carry), [*KEYS, SLICE])
    return placed.withColumn("place", (F.col("_later") + F.col("_local")).cast("bigint")).drop("_local", "_later", SLICE)


def risk_scores(active: DataFrame) -> DataFrame:
    """Score per asset and subsystem. One row per alert is active at most, so a group is bounded by the rule set."""
    late = F.when(F.col("layer") == "predictive_statistics", 1).otherwise(0)
    listed = Window.partitionBy("asset_id", "subsystem").orderBy(
        late, F.col("last_seen_us").desc(), severity_weight(F.col("severity")).desc(), F.col("alert_id"))
    ranked = active.withColumns({
        "_weight": severity_weight(F.col("severity"), R.UNKNOWN_SEVERITY_WEIGHT),
        "_known": severity_weight(F.col("severity")),
        "_place": F.row_number().over(listed),
    })
    scored = ranked.groupBy("asset_id", "subsystem").agg(
        F.max("_weight").alias("_top"), F.count(F.lit(1)).alias("active_alerts"),
        F.max_by("severity", F.struct(F.col("_known"), -F.col("_place"))).alias("highest_severity"),
        F.array_sort(F.collect_list(F.when(F.col("_place") <= 3, F.struct("_place", "title")))).alias("_titles"),
    )
    raw = F.col("_top") + R.EXTRA_ALERT_POINTS * (F.col("active_alerts") - 1)
    return scored.select(
        "asset_id", "subsystem", F.round(F.least(F.lit(100.0), raw), 1).alias("score"), "active_alerts", "highest_severity",
        F.transform("_titles", lambda t: t["title"]).alias("rationale"),
    )


def complete_scores(scores: DataFrame, assets: DataFrame, subsystems: list[str] = SUBSYSTEMS) -> DataFrame:
    """Every subsystem of every asset, with 0 where nothing is active."""
    names = F.array(*[F.lit(s) for s in subsystems])
    grid = assets.select("asset_id").distinct().withColumn("subsystem", F.explode(names))
    return grid.join(scores, ["asset_id", "subsystem"], "left").select(
        "asset_id", "subsystem", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("active_alerts", F.lit(0)).alias("active_alerts"), "highest_severity",
        F.coalesce("rationale", F.array().cast("array<string>")).alias("rationale"),
    )
