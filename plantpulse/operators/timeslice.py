"""Ordered work over long series without putting one series into one task.

A single machine may own a third of all readings, so nothing here is windowed by asset alone. Series are cut into
slices, rows are ordered inside their slice, and what has to cross a slice border travels either

* as a *carry*: one small row per slice (counts, last values), scanned per series and joined back, or
* as a *halo*: the few rows next to the border, copied into the neighbouring slice.

Slices are time cells. Cells that hold too many rows are split further (``slice_by_time``); once rows are numbered,
blocks of equal row count need no such care (``with_row_halo``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY_US
from ..session import broadcast_if_small, stored

KEYS = ("asset_id",)
SLICE = "slice_us"

#: rows one task should order at most
MAX_SLICE_ROWS = 2_000_000
#: hot cells that are handed on as a constant; a longer list becomes a table
LISTED_ROWS = 10_000
#: rows a task should sort at most where cells or blocks are small enough; wide rows ask for fewer
TASK_ROWS = 50_000


def cell_start(us: Column, width: Column | int) -> Column:
    return us - F.pmod(us, F.lit(width) if isinstance(width, int) else width)


def listed(found: DataFrame) -> DataFrame | None:
    """A list that is mostly empty or short: None, a constant, or beyond ``LISTED_ROWS`` rows a stored table.

    Only that many rows come to the driver, so the common case costs one pass and no table.
    """
    head = found.limit(LISTED_ROWS + 1).collect()
    if len(head) > LISTED_ROWS:
        return broadcast_if_small(stored(found))
    return F.broadcast(found.sparkSession.createDataFrame(head, found.schema)) if head else None


def slice_by_time(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    us: str = "us",
    width_us: int = DAY_US,
    max_rows: int = MAX_SLICE_ROWS,
) -> DataFrame:
    """Add ``slice_us``, the start of the row's time cell.

    A cell above ``max_rows`` is cut into equal sub-cells, repeatedly, down to single instants. Finding such cells is
    a map-side combined count over two columns; the list of hot cells is a constant or, if long, a stored table.
    """
    cells = df.withColumn(SLICE, cell_start(F.col(us), width_us)).withColumn("_width", F.lit(width_us).cast("bigint"))
    while True:
        finer = listed(
            cells.where(F.col("_width") > 1)
            .groupBy(*keys, SLICE, "_width").count().where(F.col("count") > max_rows)
            .select(*keys, F.col(SLICE).alias("_cell"), F.greatest(
                F.lit(1), F.floor(F.col("_width") / F.ceil(F.col("count") * 4 / max_rows))).cast("bigint").alias("_finer"))
        )
        if finer is None:
            return cells.drop("_width")
        cells = (
            cells.join(finer, [cells[k] == finer[k] for k in keys] + [cells[SLICE] == finer["_cell"]], "left")
            .select(*[cells[c] for c in cells.columns if c not in (SLICE, "_width")],
                    F.when(F.col("_finer").isNull(), cells[SLICE]).otherwise(
                        cells[SLICE] + cell_start(cells[us] - cells[SLICE], F.coalesce(F.col("_finer"), F.lit(1)))).alias(SLICE),
                    F.coalesce(F.col("_finer"), cells["_width"]).alias("_width"))
        )


def tasks_for(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> int | None:
    """Tasks that keep to ``task_rows``; None where the session's own parallelism gives enough of them."""
    tasks = math.ceil(rows / task_rows)
    return tasks if tasks > df.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Rows in as many tasks as ``rows`` of them need: adaptive execution alone would merge them into a task per core."""
    tasks = tasks_for(df, rows)
    return df.repartition(tasks, *by) if tasks else df


def cell_width(df: DataFrame, halo_us: int, width_us: int, task_rows: int, keys: Sequence[str] = KEYS) -> tuple[int, int, int]:
    """The width of uniform cells, at most rows of one of them with its halo, and rows of all of them with their halos.

    Cells are halved while the fullest one may exceed ``task_rows``, down to the width of the halo.
    """
    counted = df.groupBy(*keys, cell_start(F.col("us"), halo_us).alias(SLICE)).count()
    fullest, total = counted.agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()

    def most(width: int) -> int:
        return fullest * (math.ceil(width / halo_us) + 2)

    while most(width_us) > task_rows and width_us // 2 >= halo_us:
        width_us //= 2
    return width_us, most(width_us), math.ceil(total * (1 + halo_us / width_us))


def crowded_cells(df: DataFrame, halo_us: int, width_us: int, max_rows: int, keys: Sequence[str] = KEYS) -> DataFrame | None:
    """keys and ``slice_us`` of the uniform cells that hold more than ``max_rows`` rows with their halo; None if there are none."""
    haloed = with_time_halo(df.select(*keys, "us"), halo_us, width_us)
    return listed(haloed.groupBy(*keys, SLICE).count().where(F.col("count") > max_rows).drop("count"))


def before_slice(keys: Sequence[str] = KEYS):
    """Window over slice summaries: everything before the current slice of the same series."""
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("us",),
    index: str = "row_idx",
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row in its series: position inside the slice plus the rows of earlier slices."""
    local = Window.partitionBy(*keys, SLICE).orderBy(*order)
    counts = df.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    carry = counts.select(
        *keys, SLICE,
        F.coalesce(F.sum("_n").over(before_slice(keys)), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    numbered = df.withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(carry, [*keys, SLICE])
        .withColumn(index, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_before", "_local")
    )


def number_rows_and_segments(df: DataFrame, keys: Sequence[str] = KEYS, us: str = "us", mode: str = "mode_key") -> DataFrame:
    """Row number and operating-mode segment number per series.

    A segment starts wherever the mode differs from the previous reading. Inside a slice that is ``lag``; across
    slices the carry knows the mode the previous slice ended with.
    """
    local = Window.partitionBy(*keys, SLICE).orderBy(us)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = F.when(F.col(mode) != F.lag(mode).over(local), 1).otherwise(0)

    def walked(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_changed", changed)

    ends = walked(df.select(*keys, SLICE, us, mode)).groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_changed").alias("_changes"),
        F.min_by(mode, us).alias("_first"),
        F.max_by(mode, us).alias("_last"),
    )
    ordered = Window.partitionBy(*keys).orderBy(SLICE)
    starts = F.when(F.col("_first") != F.lag("_last").over(ordered), 1).otherwise(0)
    carry = (
        ends.withColumn("_starts", starts)
        .select(
            *keys, SLICE,
            F.coalesce(F.sum("_n").over(before_slice(keys)), F.lit(0)).alias("_rows_before"),
            (F.coalesce(F.sum(F.col("_changes") + F.col("_starts")).over(before_slice(keys)), F.lit(0)) + F.col("_starts") + 1)
            .alias("_segment_at_start"),
        )
    )
    return (
        walked(df)
        .withColumn("_local", F.row_number().over(local))
        .withColumn("_local_changes", F.sum("_changed").over(running))
        .join(carry, [*keys, SLICE])
        .withColumn("row_idx", (F.col("_rows_before") + F.col("_local")).cast("bigint"))
        .withColumn("segment_id", (F.col("_segment_at_start") + F.col("_local_changes")).cast("bigint"))
        .drop("_changed", "_local", "_local_changes", "_rows_before", "_segment_at_start")
    )


def with_time_halo(df: DataFrame, halo_us: int, width_us: int, us: str = "us") -> DataFrame:
    """Copy the last ``halo_us`` of every cell into the following cell; ``home`` marks the original row.

    Needs uniform cells at least as wide as the halo, so a row has at most two copies.
    """
    if width_us < halo_us:
        raise ValueError("cells must be at least as wide as the halo")
    own = cell_start(F.col(us), width_us)
    following = own + width_us
    targets = F.when(F.col(us) + halo_us >= following, F.array(own, following)).otherwise(F.array(own))
    return (
        df.drop(SLICE).withColumn(SLICE, F.explode(targets)).withColumn("home", cell_start(F.col(us), width_us) == F.col(SLICE))
    )


def with_row_halo(df: DataFrame, halo_rows: int, block_rows: int, index: str = "row_idx") -> DataFrame:
    """Blocks of ``block_rows`` consecutive readings, each preceded by the ``halo_rows`` readings before it.

    Blocks follow the row number, so every one has the same size whatever the cadence or skew of the series.
    """
    if block_rows < halo_rows:
        raise ValueError("blocks must be at least as long as the halo")
    position = F.col(index) - 1
    own = F.floor(position / block_rows).cast("bigint")
    targets = F.when(F.pmod(position, F.lit(block_rows)) >= block_rows - halo_rows, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("block", F.explode(targets)).withColumn(
        "home", F.floor((F.col(index) - 1) / block_rows).cast("bigint") == F.col("block")
    )


def newest_rows(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ("us",)) -> DataFrame:
    """The last ``n`` rows of each series, with ``rank_desc`` 1 for the newest.

    Spark prunes a ranked filter before the shuffle up to its group-limit threshold. For a larger ``n`` the rows are
    ranked inside their time cell first, so no task sees more than n rows per cell of one series.
    """
    descending = [F.col(c).desc() for c in order]
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        sliced = df if SLICE in df.columns else slice_by_time(df, keys)
        local = Window.partitionBy(*keys, SLICE).orderBy(*descending)
        df = sliced.withColumn("_local", F.row_number().over(local)).where(F.col("_local") <= n).select(*df.columns)
    ranked = df.withColumn("rank_desc", F.row_number().over(Window.partitionBy(*keys).orderBy(*descending)))
    return ranked.where(F.col("rank_desc") <= n)
