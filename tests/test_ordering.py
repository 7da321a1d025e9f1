"""Slices, carries, halos and as-of joins against brute force, also where one series or one cell is crowded."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantpulse.operators import timeslice as T
from plantpulse.operators.asof import asof_join, count_within, nearest_join

from .helpers import irregular, to_spark

HOUR = 3_600_000_000


def _expected_numbers(frame):
    frame = frame.sort_values(["asset_id", "us"]).copy()
    frame["row_idx"] = frame.groupby("asset_id").cumcount() + 1
    turn = (frame["mode_key"] != frame.groupby("asset_id")["mode_key"].shift()).astype(int)
    frame["segment_id"] = turn.groupby(frame["asset_id"]).cumsum()
    return frame


@pytest.mark.parametrize("width", [HOUR // 4, 24 * HOUR, 10_000 * HOUR])
def test_numbers_and_segments_do_not_depend_on_the_slices(spark, width):
    frame = irregular(1, 400)
    numbered = T.number_rows_and_segments(T.slice_by_time(to_spark(spark, frame), width_us=width))
    found = numbered.select("asset_id", "us", "row_idx", "segment_id").toPandas().sort_values(["asset_id", "us"]).reset_index(drop=True)
    expected = _expected_numbers(frame)[found.columns].reset_index(drop=True)
    pd.testing.assert_frame_equal(found, expected, check_dtype=False)


def test_crowded_cells_are_split_and_rows_keep_their_order(spark):
    """A third of all rows in a single second: the cell is cut until no slice is above the limit."""
    calm = irregular(2, 200, assets=2)
    rng = np.random.default_rng(3)
    burst = pd.DataFrame({"asset_id": 0, "us": 1_700_000_500_000_000 + rng.choice(1_000_000, 150, replace=False), "mode_key": "A|B", "x": 1.0, "y": 2.0})
    frame = pd.concat([calm, burst]).drop_duplicates(["asset_id", "us"])
    sliced = T.slice_by_time(to_spark(spark, frame), width_us=24 * HOUR, max_rows=20)
    assert sliced.columns[-1] == "slice_us" and sliced.count() == len(frame)
    assert sliced.groupBy("asset_id", "slice_us").count().agg(F.max("count")).first()[0] <= 20
    found = T.number_rows_and_segments(sliced).select("asset_id", "us", "row_idx", "segment_id").toPandas()
    merged = found.merge(_expected_numbers(frame)[["asset_id", "us", "row_idx", "segment_id"]], on=["asset_id", "us", "row_idx", "segment_id"])
    assert len(merged) == len(frame)


def test_blocks_have_equal_size_and_complete_history(spark):
    frame = irregular(4, 500, assets=1)
    frame["row_idx"] = np.arange(1, len(frame) + 1)
    rows = T.with_row_halo(to_spark(spark, frame), 7, 50).groupBy("block").agg(
        F.count_if("home").alias("home"), F.count_if(~F.col("home")).alias("halo")).orderBy("block").collect()
    assert all(r["home"] <= 50 and r["halo"] <= 7 for r in rows)
    assert [r["halo"] for r in rows if r["home"]] == [0] + [7] * (sum(1 for r in rows if r["home"]) - 1)


def test_newest_rows_beyond_the_group_limit(spark):
    frame = irregular(5, 300)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        found = T.newest_rows(to_spark(spark, frame), 40).select("asset_id", "us").toPandas()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    expected = frame.sort_values("us").groupby("asset_id").tail(40)
    assert set(map(tuple, found.values)) == set(map(tuple, expected[["asset_id", "us"]].values))


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join_crosses_empty_cells(spark, direction):
    left = irregular(6, 120)[["asset_id", "us"]]
    right = irregular(7, 12)[["asset_id", "us", "x"]]
    right["us"] += 7 * HOUR
    found = asof_join(to_spark(spark, left), to_spark(spark, right), payload=["x"], direction=direction).toPandas()
    expected = pd.merge_asof(left.sort_values("us"), right.rename(columns={"x": "asof_x"}).assign(asof_us=right["us"]).sort_values("us"),
                             on="us", by="asset_id", direction=direction)
    a = found.sort_values(["asset_id", "us"])[["asof_us", "asof_x"]].to_numpy(dtype=float)
    b = expected.sort_values(["asset_id", "us"])[["asof_us", "asof_x"]].to_numpy(dtype=float)
    np.testing.assert_allclose(a, b)


def test_nearest_and_within_tolerance_against_brute_force(spark):
    left, right = irregular(8, 80)[["asset_id", "us"]], irregular(9, 90)[["asset_id", "us", "x"]]
    right = pd.concat([right, right.head(10)])  # repeated times count each
    l, r = to_spark(spark, left), to_spark(spark, right.dropna())
    near = {(x.asset_id, x.us): x.near_us for x in nearest_join(l, r, payload=["x"]).collect()}
    inside = {(x.asset_id, x.us): x.nearby for x in count_within(l, r, F.lit(20 * 60_000_000)).collect()}
    for row in left.itertuples():
        mine = right.dropna()[right.dropna()["asset_id"] == row.asset_id]["us"].to_numpy()
        best = min(mine, key=lambda u: (abs(u - row.us), u))
        assert near[(row.asset_id, row.us)] == best
        assert inside[(row.asset_id, row.us)] == int((np.abs(mine - row.us) <= 20 * 60_000_000).sum())


def test_cells_of_the_as_of_join_are_dealt_by_rows(spark, monkeypatch):
    """adaptive execution put the cells of all assets into a task per core, or into tasks of 64 MB of packed rows."""
    asked = []
    monkeypatch.setattr("plantpulse.operators.asof.dealt", lambda df, rows, *by: asked.append((rows, by)) or df.repartition(30, *by))
    left = spark.range(40).selectExpr("id % 2 AS asset_id", "id * 7200000000 + 1 AS us")
    right = spark.range(400).selectExpr("id % 2 AS asset_id", "id * 720000000 AS us", "id AS v")
    found = asof_join(left, right, payload=["v"])
    rows = found.collect()
    assert asked == [(440, ("asset_id", T.SLICE))] and found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") > 0
    assert len(rows) == 40 and all(r["asof_v"] % 2 == r["asset_id"] and 0 <= r["us"] - r["asof_us"] <= 1_440_000_000 for r in rows)
