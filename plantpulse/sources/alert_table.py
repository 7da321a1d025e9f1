"""The alert table: an upsert that keeps the first trigger time, and the read side.

The table holds one row per asset and alert, in buckets by part of the assets and by active or not. An upsert rewrites
the parts that have or had active alerts, see ``bucket_table``; the others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.episodes import event_order
from ..session import stored
from .bucket_table import BUCKET, BucketTable, part_of

SCHEMA = (
    "asset_id bigint, alert_id string, rule_id string, layer string, subsystem string, signal string, severity string, "
    "title string, message string, triggered_us bigint, last_seen_us bigint, current_value string, threshold string, "
    "mode_key string, is_active boolean, metadata_json string"
)
KEPT = ["rule_id", "layer", "subsystem", "signal", "triggered_us"]
REPLACED = ["severity", "title", "message", "last_seen_us", "current_value", "threshold", "mode_key", "metadata_json"]


def as_table_rows(alerts: DataFrame) -> DataFrame:
    """Alerts in table form: the value as text, metadata and diagnoses folded into one JSON text."""
    folded = [F.col("metadata").alias("metadata")]
    for extra in ("diagnosis", "insight"):
        if extra in alerts.columns:
            folded.append(F.col(extra))
    return alerts.select(
        "asset_id", "alert_id", "rule_id", "layer", "subsystem", "signal", "severity", "title", "message", "triggered_us",
        "last_seen_us", F.col("current_value").cast("string").alias("current_value"), "threshold", "mode_key",
        F.lit(True).alias("is_active"), F.to_json(F.struct(*folded)).alias("metadata_json"),
    )


def upsert(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Full outer merge: everything old turns inactive, fresh alerts become active and keep their first trigger time."""
    joined = current.alias("old").join(fresh.alias("new"), ["asset_id", "alert_id"], "full_outer")
    is_new, is_old = F.col("new.is_active").isNotNull(), F.col("old.is_active").isNotNull()
    columns = {c: F.when(is_old, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) for c in KEPT}
    columns |= {c: F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in REPLACED}
    columns["is_active"] = is_new
    order = [name.strip().split(" ")[0] for name in SCHEMA.split(",")]
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in order])


class AlertTable:
    def __init__(self, spark: SparkSession, path: str, parts: int = 64) -> None:
        self.parts, self.table = parts, BucketTable(spark, path, SCHEMA)

    def read(self, before: int | None = None) -> DataFrame:
        return self.table.read(self.table.newest(before))

    def replace_active(self, alerts: DataFrame, batch: int) -> None:
        """Idempotent per batch number: a batch that is there already changes nothing."""
        if batch in self.table.versions():
            return
        part = part_of(F.col("asset_id"), self.parts)
        fresh = stored(as_table_rows(alerts).withColumn("_part", part))
        version = self.table.newest(batch)
        active = {b[1:] for b in self.table.manifest(version) if b[0] == "a"}
        parts = active | {r[0] for r in fresh.select("_part").distinct().collect()}
        merged = upsert(self.table.read(version, lambda b: b[1:] in parts), fresh.drop("_part"))
        rows = merged.withColumn(BUCKET, F.concat(F.when(F.col("is_active"), "a").otherwise("i"), part))
        self.table.commit(rows, [kind + p for p in parts for kind in "ai"], batch)

    def list_alerts(self, active_only: bool = True) -> DataFrame:
        rows = self.read()
        rows = rows.where("is_active") if active_only else rows
        return unpack(rows).orderBy(*event_order(weight=False))


def unpack(rows: DataFrame) -> DataFrame:
    """JSON text back to typed metadata."""
    return rows.withColumn("metadata", F.from_json("metadata_json", "metadata map<string,string>")["metadata"])
