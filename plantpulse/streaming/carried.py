"""Series that go on across micro-batches: row and segment numbers, weighted averages, alert episodes.

Inside a micro-batch the batch operators do the work (windows over cells and blocks, native islands), so a busy machine
spreads as it does there. What has to go on is a small carry table, one row per asset or per open episode, in buckets by
part of the assets (``bucket_table``). A repeated micro-batch finds its version and changes nothing.

Micro-batches hold new rows only, later than all before of the same asset (``flows.BoundedHistory.add``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import EWMA_SPAN
from ..operators.episodes import EPISODE, FROM_LAST, build_episodes
from ..operators.features import ewma_rows, numbered_readings, smoothed_values
from ..session import broadcast_if_small, small_side, stored
from ..sources.bucket_table import BUCKET, BucketTable, buckets_of, part_of

_SERIES = "asset_id bigint, us bigint, rows bigint, mode_key string, segment_id bigint"


class NumberedStream:
    """Row and segment numbers that go on from micro-batch to micro-batch."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 16) -> None:
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self.series = BucketTable(spark, f"{self.path}/series", _SERIES)

    def add(self, fresh: DataFrame, batch: int) -> DataFrame:
        """The rows of the micro-batch with ``row_idx``, ``segment_id`` and ``rows_before``, the number of the asset's earlier rows."""
        known = self.series.read(self.series.newest(batch))
        local = stored(numbered_readings(fresh))
        first = local.where("row_idx = 1").select("asset_id", F.col("mode_key").alias("_first"))
        carry = known.select("asset_id", F.col("rows").alias("_rows"), F.col("segment_id").alias("_segment"), F.col("mode_key").alias("_mode"))
        start = first.join(carry, "asset_id", "left").select(
            "asset_id", F.coalesce("_rows", F.lit(0).cast("bigint")).alias("rows_before"),
            (F.coalesce("_segment", F.lit(0).cast("bigint")) - F.when(F.col("_first") == F.col("_mode"), 1).otherwise(0)).alias("_segments"))
        numbered = local.join(small_side(start), "asset_id").withColumns(
            {"row_idx": F.col("row_idx") + F.col("rows_before"), "segment_id": F.col("segment_id") + F.col("_segments")}).drop("_segments")
        if batch not in self.series.versions():
            ends = numbered.groupBy("asset_id").agg(F.max("us").alias("us"), F.max("row_idx").alias("rows"), F.max_by("mode_key", "us").alias("mode_key"),
                                                    F.max("segment_id").alias("segment_id"))
            _replace(self.series, ends, ["asset_id"], batch, self.parts)
        return numbered


def _replace(table: BucketTable, rows: DataFrame, keys: Sequence[str], batch: int, parts: int) -> None:
    """The rows take the place of those with the same keys."""
    part = part_of(F.col("asset_id"), parts)
    fresh = stored(rows.withColumn(BUCKET, part))
    touched = set(buckets_of(fresh))
    held = table.read(table.newest(batch), touched.__contains__).withColumn(BUCKET, part)
    table.commit(held.join(broadcast_if_small(fresh.select(*keys)), list(keys), "left_anti").unionByName(fresh), touched, batch)


class SmoothedStream:
    """Weighted averages of all signals per segment, exact across micro-batches.

    The average after a value goes on as if that value were all there was. So the carry, per asset and signal the last average and
    its row, enters the next micro-batch as rows without a time that hold the averages as values.
    """

    def __init__(self, spark: SparkSession, path: str, signals: Sequence[str], span: int = EWMA_SPAN, parts: int = 16) -> None:
        self.spark, self.path, self.signals, self.span, self.parts = spark, path.rstrip("/"), list(signals), span, parts
        self.numbers = NumberedStream(spark, path, parts)
        entry = ", ".join(f"`{s}`: struct<row: bigint, value: double>" for s in self.signals)
        self.averages = BucketTable(spark, f"{self.path}/averages", f"asset_id bigint, segment_id bigint, rows bigint, last struct<{entry}>")

    def work(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: writes the averages of the micro-batch, and of each signal whether the row has a value."""
        if number in self.averages.versions():
            return
        rows = self.numbers.add(batch.select("asset_id", "us", "mode_key", *[F.col(s).cast("double").alias(s) for s in self.signals]), number)
        readings = rows.select("asset_id", "row_idx", "segment_id", "us", *self.signals)
        carried = self._as_rows(self.averages.read(self.averages.newest(number)).join(small_side(rows.select("asset_id").distinct()), "asset_id", "left_semi"))
        smooth = smoothed_values(readings.unionByName(carried), self.signals, self.span, gap=False)
        smooth = smooth.withColumns({s: F.col(s).isNotNull() for s in self.signals})
        smooth = stored(smooth, f"{self.path}/out/batch={number}")
        _replace(self.averages, self._ends(smooth), ["asset_id"], number, self.parts)

    def _as_rows(self, known: DataFrame) -> DataFrame:
        reach = ewma_rows(self.span)[0]  # older values weigh nothing, but still hold until the next one
        entries = [F.when(F.col(f"last.{s}.row").isNotNull(), F.struct(F.greatest(F.col(f"last.{s}.row"), F.col("rows") - reach + 1, F.lit(1)).alias("row_idx"),
                                                                       F.lit(s).alias("signal"), F.col(f"last.{s}.value").alias("value"))) for s in self.signals]
        long = known.select("asset_id", "segment_id", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("asset_id", "segment_id", "e.*")
        values = [F.max(F.when(F.col("signal") == s, F.col("value"))).alias(s) for s in self.signals]
        wide = long.groupBy("asset_id", "row_idx", "segment_id").agg(*values)
        return wide.select("asset_id", "row_idx", "segment_id", F.lit(None).cast("bigint").alias("us"), *self.signals)

    def _ends(self, smooth: DataFrame) -> DataFrame:
        """Of each asset the last segment, and in it the last value of each signal."""
        seen = {s: F.when(F.col(s), F.col("row_idx")) for s in self.signals}
        per_segment = smooth.groupBy("asset_id", "segment_id").agg(
            F.max("row_idx").alias("rows"),
            F.struct(*[F.struct(F.max(at).alias("row"), F.max_by(f"{s}__ewma", at).alias("value")).alias(s) for s, at in seen.items()]).alias("last"))
        newest = per_segment.groupBy("asset_id").agg(F.max("segment_id").alias("segment_id"), F.max_by(F.struct("rows", "last"), "segment_id").alias("_end"))
        return newest.select("asset_id", "segment_id", "_end.rows", "_end.last")

    def results(self) -> DataFrame:
        found = self.spark.read.parquet(f"{self.path}/out/batch=*").where("us IS NOT NULL")
        return found.select("asset_id", "us", "segment_id", *[f"{s}__ewma" for s in self.signals])


class EpisodeStream:
    """Alert episodes of a stream: closed ones are appended, open ones are the carry and can be read at any time.

    ``find_hits`` makes hits (``operators.alerts``) of numbered readings. An open episode goes on when the first episode of the same
    alert in the next micro-batch begins with the asset's next reading; it closes when the asset has readings without it.
    """

    def __init__(self, spark: SparkSession, path: str, find_hits: Callable[[DataFrame], DataFrame], parts: int = 16) -> None:
        self.spark, self.path, self.find_hits, self.parts = spark, path.rstrip("/"), find_hits, parts
        self.numbers = NumberedStream(spark, path, parts)
        self.schema: StructType | None = None

    @property
    def open(self) -> BucketTable:
        return BucketTable(self.spark, f"{self.path}/open", self.schema)

    def work(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        numbered = self.numbers.add(batch, number)
        found = build_episodes(self.find_hits(numbered)).select(*EPISODE)
        self.schema = found.schema
        if number in self.open.versions():
            return
        ends = small_side(numbered.groupBy("asset_id").agg(F.min("rows_before").alias("_before"), F.max("row_idx").alias("_after")))
        carried = self.open.read(self.open.newest(number))
        waiting = stored(carried.join(ends.select("asset_id"), "asset_id", "left_semi").select(*carried.columns))
        episodes = stored(self._stitched(found.join(ends.select("asset_id", "_before"), "asset_id"), waiting))
        placed = episodes.join(ends.select("asset_id", "_after"), "asset_id").withColumn("is_open", F.col("last_row") == F.col("_after"))
        placed = stored(placed.select(*found.columns, "is_open"))
        placed.where("NOT is_open").drop("is_open").write.mode("overwrite").parquet(f"{self.path}/closed/batch={number}")

        part = part_of(F.col("asset_id"), self.parts)
        touched = set(buckets_of(numbered.select("asset_id").distinct().withColumn(BUCKET, part)))
        others = carried.join(ends.select("asset_id"), "asset_id", "left_anti").select(*carried.columns).withColumn(BUCKET, part)
        self.open.commit(others.where(F.col(BUCKET).isin(list(touched))).unionByName(placed.where("is_open").drop("is_open").withColumn(BUCKET, part)), touched, number)

    def _stitched(self, found: DataFrame, waiting: DataFrame) -> DataFrame:
        """Open episodes with what goes on from them, and all other episodes."""
        columns = [c for c in found.columns if c != "_before"]
        follows = F.col("first_row") == F.col("_before") + 1
        first, rest = found.where(follows).drop("_before"), found.where(~follows).select(*columns)
        joined = waiting.alias("old").join(first.alias("new"), ["asset_id", "alert_id"], "full_outer")
        from_new = {*FROM_LAST, "last_seen_us", "last_row"}

        def value(name: str):
            old, new = F.col(f"old.{name}"), F.col(f"new.{name}")
            if name == "readings":
                return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
            newer = F.col("new.first_row").isNotNull() if name in from_new else F.col("old.first_row").isNull()
            return F.when(newer, new).otherwise(old)

        keys = ["asset_id", "alert_id"]
        return joined.select(*keys, *[value(c).alias(c) for c in columns if c not in keys]).select(*columns).unionByName(rest)

    def active(self, number: int | None = None) -> DataFrame:
        """The open episodes, the active alerts of a deployment."""
        return self.open.read(self.open.newest(None if number is None else number + 1))

    def episodes(self) -> DataFrame:
        """All episodes so far; ``is_active`` marks the open ones."""
        closed = self.spark.read.schema(self.schema).parquet(f"{self.path}/closed/batch=*")
        return closed.withColumn("is_active", F.lit(False)).unionByName(self.active().withColumn("is_active", F.lit(True)))
