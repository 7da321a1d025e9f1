"""Session helpers: builder defaults, literal dimension tables, checked broadcast hints, shared scratch folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: a side is only hinted for broadcast when the optimizer's size estimate stays below this
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
#: Spark's own setting that removes the shuffle files of an execution when it ends
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: int | str = "*", app: str = "plantpulse", partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the session is given, and its own settings are kept."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def literal_table(spark: SparkSession, schema: str, rows: list[dict]) -> DataFrame:
    """A small constant table as one JSON literal: no Python worker, and the optimizer knows it is tiny."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_fields(schema)}>>")))


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.strip().split(" ", 1) for part in schema.split(",")))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: file sizes for scans, the size of its input for most aggregates."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only for a side of proven size; a larger side is left to the optimizer and AQE.

    The estimate of an aggregate is about that of its input, so hand in a ``stored`` table where an aggregate is known to be small.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """An aggregate as the small side of a join: written once, so that its true size decides whether it is broadcast.

    Beyond the limit the join shuffles, and as both sides then are tables, Spark may split a key that holds many rows.
    """
    return broadcast_if_small(stored(df), limit)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder that ``spark.checkpoint.dir`` names; without one there is no safe place to write."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Executions in this block remove their shuffle files as they end, not whenever the driver's garbage is next collected."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder and reading it back; survives lost executors.

    What was shuffled for it is not read again and leaves the disk with the write.
    """
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    with _shuffles_released(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
