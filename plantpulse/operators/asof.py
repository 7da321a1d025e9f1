"""As-of, nearest and within-tolerance joins on event time: a sorted merge per time cell, never a pair per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeslice import KEYS, SLICE, dealt, number_rows, slice_by_time


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = KEYS,
    us: str = "us",
    payload: Sequence[str] = (),
    direction: str = "backward",
    prefix: str = "asof_",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Attach to each left row the latest right row at or before it (``backward``) or the first at or after (``forward``).

    Both sides are merged in time order inside time cells. A left row with no right row before it in its own cell
    takes the carry: the last right row of the nearest earlier cell that has one. Cells are dealt to as many tasks as their rows need.
    """
    forward = direction == "forward"
    kept = [c for c in left.columns if c not in (SLICE,)]
    found = F.struct(F.col(us).alias("us"), *payload)
    rows = left.select(*keys, F.col(us).alias("_us"), F.lit(1).alias("_side"),
                       *[F.lit(None).cast(right.schema[c].dataType).alias(f"_tie_{i}") for i, c in enumerate(tie)],
                       F.lit(None).cast(right.select(found.alias("f")).schema["f"].dataType).alias("_found"),
                       F.struct(*kept).alias("_left"))
    marks = right.select(*keys, F.col(us).alias("_us"), F.lit(0).alias("_side"),
                         *[F.col(c).alias(f"_tie_{i}") for i, c in enumerate(tie)],
                         found.alias("_found"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"))
    both = rows.unionByName(marks)
    merged = dealt(slice_by_time(both, keys, us="_us"), both.count(), *keys, SLICE)
    time_order = F.col("_us").desc() if forward else F.col("_us").asc()
    ties = [F.col(f"_tie_{i}").desc() if forward else F.col(f"_tie_{i}").asc() for i in range(len(tie))]
    local = (
        Window.partitionBy(*keys, SLICE).orderBy(time_order, F.col("_side"), *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    edge = F.struct(F.col("_us"), *[F.col(f"_tie_{i}") for i in range(len(tie))])
    pick = F.min_by if forward else F.max_by
    tails = merged.groupBy(*keys, SLICE).agg(pick("_found", F.when(F.col("_side") == 0, edge)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc() if forward else F.col(SLICE).asc()).rowsBetween(
        Window.unboundedPreceding, -1)
    carry = tails.select(*keys, SLICE, F.last("_tail", ignorenulls=True).over(across).alias("_carried"))
    answered = (
        merged.withColumn("_local", F.last("_found", ignorenulls=True).over(local))
        .where(F.col("_side") == 1)
        .join(carry, [*keys, SLICE], "left")
        .withColumn("_hit", F.coalesce("_local", "_carried"))
    )
    return answered.select("_left.*", *[F.col(f"_hit.{c}").alias(f"{prefix}{c}") for c in ("us", *payload)])


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, us: str = "us",
                 payload: Sequence[str] = ()) -> DataFrame:
    """Attach the right row nearest in time; of two equally near rows the earlier one wins."""
    both = asof_join(asof_join(left, right, keys, us, payload, "backward", "_b_"), right, keys, us, payload, "forward", "_f_")
    back, ahead = F.col(us) - F.col("_b_us"), F.col("_f_us") - F.col(us)
    use_back = F.col("_b_us").isNotNull() & (F.col("_f_us").isNull() | (back <= ahead))
    return both.select(
        *[c for c in left.columns if c != SLICE],
        *[F.when(use_back, F.col(f"_b_{c}")).otherwise(F.col(f"_f_{c}")).alias(f"near_{c}") for c in ("us", *payload)],
    )


def count_within(left: DataFrame, right: DataFrame, tolerance: Column, keys: Sequence[str] = KEYS, us: str = "us",
                 out: str = "nearby") -> DataFrame:
    """Number of right rows within ``tolerance`` of each left row.

    The right rows are numbered once; the count is the difference of two as-of look-ups, so no pair is ever formed.
    """
    marks = number_rows(slice_by_time(right.select(*keys, us), keys, us), keys, (us,), index="_rank").select(*keys, us, "_rank")
    probe = left.withColumn("_tol", tolerance).withColumn("_at", F.col(us))
    upper = asof_join(probe.withColumn(us, F.col("_at") + F.col("_tol")), marks, keys, us, ["_rank"], prefix="_hi", tie=["_rank"])
    lower = asof_join(upper.withColumn(us, F.col("_at") - F.col("_tol") - 1), marks, keys, us, ["_rank"], prefix="_lo", tie=["_rank"])
    return lower.select(
        *[F.col("_at").alias(us) if c == us else F.col(c) for c in left.columns if c != SLICE],
        (F.coalesce("_hi_rank", F.lit(0)) - F.coalesce("_lo_rank", F.lit(0))).cast("bigint").alias(out),
    )
