"""Tables whose versions share buckets, and series that go on across micro-batches, against the batch operators."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plantpulse.config import DAY_US
from plantpulse.operators.episodes import build_episodes, mark_active
from plantpulse.operators.features import numbered_readings, smoothed_values
from plantpulse.registry import QUERIES
from plantpulse.registry import dataset as D
from plantpulse.registry.streams import _summed_times
from plantpulse.sources.alert_table import AlertTable
from plantpulse.sources.bucket_table import BucketTable
from plantpulse.streaming import carried, flows
from plantpulse.streaming.carried import EpisodeStream, SmoothedStream
from plantpulse.streaming.flows import BoundedHistory

from .helpers import irregular, to_spark

DAY = 19_700
ROWS = "asset_id bigint, us bigint, v double"


def day_rows(spark, days, assets=(1, 2), value=0.0):
    return spark.createDataFrame([(a, d * DAY_US + k * 10**9, value) for d in days for a in assets for k in range(20)], ROWS)


def triples(df):
    return sorted(map(tuple, df.select("asset_id", "us", "v").collect()))


def test_a_batch_of_one_day_rewrites_its_buckets_only(spark, tmp_path):
    history = BoundedHistory(spark, str(tmp_path / "h"), 3 * DAY_US, parts=4)
    history.add(day_rows(spark, range(DAY, DAY + 3)), 0)
    first = history.rows.manifest(0)
    assert len(first) >= 3 and set(first.values()) == {0}
    history.add(day_rows(spark, [DAY + 3], assets=(1,)), 1)
    second = history.rows.manifest(1)
    assert {b for b, v in second.items() if v == 1} == {b for b in second if b.startswith(f"{DAY + 3}_")}
    assert {b: v for b, v in second.items() if v == 0} == first

    before = triples(history.at(1))
    again = history.add(day_rows(spark, [DAY + 3], assets=(1,), value=9.0), 1)  # repeated, even with other rows
    assert history.rows.manifest(1) == second and triples(history.at(1)) == before and again.where("v = 0").count() == 20

    for batch in range(2, 8):
        history.add(day_rows(spark, [DAY + 2 + batch]), batch)
    assert history.rows.versions() == history.marks.versions() == [6, 7]
    named = history.rows.manifest(6) | history.rows.manifest(7)
    assert min(int(b.split("_")[0]) for b in named) >= DAY + 4  # days that all assets of a part have left behind are gone
    left = {p.parent.name + "/" + p.name for p in (tmp_path / "h" / "rows" / "data").glob("batch=*/bucket=*")}
    both = {f"batch={v}/bucket={b}" for m in (6, 7) for b, v in history.rows.manifest(m).items()}
    assert left == both
    newest = (DAY + 9) * DAY_US + 19 * 10**9
    assert triples(history.at(7)) == [t for t in triples(day_rows(spark, range(DAY, DAY + 10))) if t[1] >= newest - 3 * DAY_US]


def test_late_rows_are_counted_and_kept(spark, tmp_path):
    history = BoundedHistory(spark, str(tmp_path / "h"), 30 * DAY_US)
    history.add(day_rows(spark, [DAY + 1], assets=(1,)), 0)
    late = day_rows(spark, [DAY], assets=(1,), value=-1.0)
    new = history.add(late.unionByName(late).unionByName(day_rows(spark, [DAY, DAY + 2], assets=(2,))), 1)
    assert {r["asset_id"] for r in new.collect()} == {2}
    empty = history.add(late, 2)
    assert empty.count() == 0
    assert sorted(map(tuple, history.counts().select("batch", "rows", "new_rows", "late_rows").collect())) == [(0, 20, 20, 0), (1, 60, 40, 20), (2, 20, 0, 20)]
    kept = history.late_rows()
    assert sorted(map(tuple, kept.groupBy("batch").agg(F.count("*"), F.min("v")).collect())) == [(1, 20, -1.0), (2, 20, -1.0)]


def test_replaced_rows_win_where_late_rows_may_enter(spark, tmp_path):
    history = BoundedHistory(spark, str(tmp_path / "h"), 30 * DAY_US, drop_late=False)
    history.add(day_rows(spark, [DAY, DAY + 1]), 0)
    history.add(day_rows(spark, [DAY], value=5.0), 1)
    assert triples(history.at(1)) == sorted(triples(day_rows(spark, [DAY], value=5.0)) + triples(day_rows(spark, [DAY + 1])))
    assert history.at(1, (DAY + 1) * DAY_US).count() == 40


def test_a_draft_is_no_version(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ROWS)
    rows = day_rows(spark, [DAY])
    table.commit(rows.withColumn("bucket", F.lit("x")), ["x"], 0)
    (tmp_path / "t" / "manifest" / "1.draft").write_text("{}")
    rows.withColumn("bucket", F.lit("x")).write.partitionBy("bucket").parquet(str(tmp_path / "t" / "data" / "batch=1"))
    assert table.versions() == [0] and table.read(table.newest()).count() == 40
    table.commit(rows.limit(0).withColumn("bucket", F.lit("x")), ["x"], 1)
    assert table.manifest(1) == {} and table.read(1).count() == 0 and table.read(0).count() == 40


def hits_of(numbered):
    """Two alerts by value, one that hardly ever stops and one that flickers."""
    found = [F.when(F.col("x") > 40, F.lit("long")), F.when(F.col("x") > 50, F.lit("short"))]
    rows = numbered.select("asset_id", "us", "row_idx", "x", "mode_key", F.explode(F.array_compact(F.array(*found))).alias("alert_id"))
    fixed = {c: F.lit(c) for c in ("layer", "subsystem", "signal", "severity", "title", "message", "threshold")}
    return rows.withColumns(fixed | {"rule_id": F.col("alert_id"), "current_value": F.col("x"), "metadata": F.create_map(F.lit("k"), F.col("x").cast("string"))})


def batches_of(frame, cuts):
    """The frame by time; the second asset is silent in some batches."""
    edges = np.quantile(frame["us"], cuts)
    return [frame[(frame["us"] >= a) & (frame["us"] < b)] for a, b in zip([0, *edges], [*edges, 2**62])]


@pytest.mark.parametrize("cuts", [[0.5], [0.05, 0.1, 0.11, 0.6, 0.95]])
def test_streamed_episodes_equal_the_batch(spark, tmp_path, cuts):
    frame = irregular(8, 150, assets=3, gaps=0.02)
    stream = EpisodeStream(spark, str(tmp_path / "e"), hits_of)
    for number, part in enumerate(batches_of(frame, cuts)):
        if len(part):
            for _ in range(2 if number < 2 else 1):  # a repeated batch changes nothing
                stream.work(to_spark(spark, part), number)
    numbered = numbered_readings(to_spark(spark, frame))
    expected = mark_active(build_episodes(hits_of(numbered)), numbered)
    columns = ["asset_id", "alert_id", "triggered_us", "last_seen_us", "first_row", "last_row", "readings", "current_value", "mode_key", "is_active"]
    found = stream.episodes()
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))
    assert stream.active().count() == expected.where("is_active").count() > 0


@pytest.mark.parametrize("span", [3, 15])
def test_streamed_averages_equal_the_batch(spark, tmp_path, span):
    frame = irregular(9, 400, assets=2, gaps=0.1)
    frame.loc[(frame["asset_id"] == 0) & (frame.index % 400 > 60), "y"] = np.nan  # silent for longer than the warm-up
    frame["mode_key"] = np.where(frame.index % 400 < 200, "one", np.where(frame.index % 90 < 45, "two", "three"))
    stream = SmoothedStream(spark, str(tmp_path / "s"), ["x", "y"], span)
    for number, part in enumerate(batches_of(frame, [0.1, 0.12, 0.5, 0.8])):
        stream.work(to_spark(spark, part), number)
        stream.work(to_spark(spark, part), number)
    names = ["asset_id", "us", "segment_id", "x__ewma", "y__ewma"]
    expected = smoothed_values(numbered_readings(to_spark(spark, frame)), ["x", "y"], span, gap=False).select(names).toPandas().sort_values(["asset_id", "us"])
    found = stream.results().select(names).toPandas().sort_values(["asset_id", "us"])
    assert len(found) == len(frame)
    pd.testing.assert_frame_equal(found.reset_index(drop=True), expected.reset_index(drop=True), rtol=1e-9)


def test_streamed_averages_are_written_once_and_landings_dealt_while_narrow(spark, tmp_path, monkeypatch):
    """a micro-batch was stored as local numbers, as numbers, as averages and as results; landings were shuffled with all signals."""
    written = []
    plain = carried.stored
    monkeypatch.setattr(carried, "stored", lambda df, folder=None: written.append(df.columns) or plain(df, folder))
    stream = SmoothedStream(spark, str(tmp_path / "s"), ["x", "y"])
    stream.work(to_spark(spark, irregular(9, 50, assets=2)), 0)
    assert sum("us" in columns and "row_idx" in columns for columns in written) == 2
    events = tmp_path / "sf"
    spark.sql("SELECT id AS event_id, timestamp_micros(1704067200000000 + id * 1000000)::timestamp_ntz AS ts, id AS user_id, 'a' AS event_type, "
              "id * 1.0D AS value, '{\"k\": 5}' AS props FROM range(50)").write.parquet(f"{events}/events.parquet")
    dealt = D.readings(spark, str(events), files=4)
    assert dealt.rdd.getNumPartitions() == 4 and sorted(map(str, dealt.collect())) == sorted(map(str, D.readings(spark, str(events)).collect()))


def test_alert_table_rewrites_parts_with_active_alerts_only(spark, tmp_path):
    names = ["alert_id", "rule_id", "layer", "subsystem", "signal", "severity", "title", "message", "threshold", "mode_key"]

    def alerts(assets, at):
        rows = spark.createDataFrame([(a, at, at, 1.0) for a in assets], "asset_id bigint, triggered_us bigint, last_seen_us bigint, current_value double")
        return rows.withColumns({n: F.lit(n) for n in names} | {"metadata": F.create_map(F.lit("k"), F.lit("v"))})

    table = AlertTable(spark, str(tmp_path / "a"), parts=32)
    table.replace_active(alerts(range(60), 1), 0)
    table.replace_active(alerts(range(3), 2), 1)  # all others turn inactive
    table.replace_active(alerts([0], 3), 2)
    manifest = table.table.manifest(2)
    assert 1 <= sum(v == 2 for v in manifest.values()) <= 6 and table.table.versions() == [1, 2]
    rows = {r["asset_id"]: r for r in table.list_alerts(active_only=False).collect()}
    assert len(rows) == 60 and {a for a, r in rows.items() if r["is_active"]} == {0}
    assert (rows[0]["triggered_us"], rows[0]["last_seen_us"], rows[2]["last_seen_us"], rows[50]["last_seen_us"]) == (1, 3, 2, 1)


def test_times_of_many_late_rows_pass_64_bits(spark):
    """F1: some thousands of times in microseconds overflowed a bigint sum; sums that fit one stay a bigint."""
    late = spark.range(9_000).select(F.lit(1).cast("bigint").alias("batch"), (F.lit(1_700_000_000_000_000) + F.col("id")).alias("us"))
    wide = _summed_times(late)
    assert [int(r["late_times"]) for r in wide.collect()] == [9_000 * 1_700_000_000_000_000 + sum(range(9_000))]
    small = _summed_times(late.limit(2))
    assert dict(small.dtypes)["late_times"] == "bigint" and small.first()["late_times"] > 2 * 1_700_000_000_000_000 - 1
    assert dict(_summed_times(late.where("us < 0")).dtypes)["late_times"] == "bigint"


def test_a_stream_is_waited_for_and_one_cut_off_is_an_error(spark, tmp_path):
    """a stream that was not done in time was left to itself, and what it had written by then was taken for its result."""
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = flows.reading_stream(spark, str(tmp_path / "in"), spark.range(0).schema, files_per_batch=1)

    def started(name):
        seen = []
        return seen, flows.per_batch(stream, lambda batch, _number: (time.sleep(0.5), seen.append(batch.count())), str(tmp_path / name))

    seen, whole = started("whole")
    flows.drain(whole)
    assert sum(seen) == 40 and len(seen) == 4
    seen, cut = started("cut")
    with pytest.raises(TimeoutError):
        flows.drain(cut, 1)
    assert not cut.isActive and sum(seen) < 40


def test_a_broken_count_is_an_error(spark, tmp_path):
    """half of a counts file was read as a row of NULLs."""
    history = BoundedHistory(spark, str(tmp_path / "h"), 30 * DAY_US)
    history.add(day_rows(spark, [DAY]), 0)
    (tmp_path / "h" / "counts" / "1.json").write_text('{"batch": 1, "ro')
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        history.counts().collect()


EVENT_DAYS, EVENTS = 25, 300


@pytest.fixture(scope="module")
def events_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    step = EVENT_DAYS * DAY_US // EVENTS
    spark.sql(f"SELECT id AS event_id, timestamp_micros(1704067200000000 + id * {step})::timestamp_ntz AS ts, id % 7 AS user_id, 'a' AS event_type, "
              f"id * 1.0D AS value, '{{\"k\": 5}}' AS props FROM range({EVENTS})").write.parquet(f"{folder}/events.parquet")
    return folder


def outlasting_its_wait(monkeypatch):
    """Every stream takes longer than any time that is set for it."""
    plain = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: plain(self, None if timeout is None else 0.001))


def arrived(spark, folder):
    return D.readings(spark, folder).select("asset_id", "us", "eid", "day").toPandas()


def rows_of(found, *columns):
    return sorted(map(tuple, found.select(*columns).collect()))


def test_late_row_counts_of_a_long_stream_are_whole(spark, events_folder, monkeypatch):
    """F4"""
    outlasting_its_wait(monkeypatch)
    rows = arrived(spark, events_folder)
    rows["batch"] = (rows["day"] - rows["day"].min()) // 10
    expected = []
    for batch in range(3):
        new, late = rows[rows["batch"] == batch], rows[(rows["batch"] < batch) & (rows["eid"] % 3 == 0)]
        expected.append((batch, len(new) + len(late), len(new), len(late), int(new["us"].max()), int(late["us"].sum())))
    found = QUERIES["k2_late_row_counts"](spark, events_folder)
    assert rows_of(found, "batch", "rows", "new_rows", "late_rows", "newest_us", "late_times") == expected


def test_first_arrivals_of_a_long_stream_are_whole(spark, events_folder, monkeypatch):
    """F5"""
    outlasting_its_wait(monkeypatch)
    expected = sorted(arrived(spark, events_folder)[["asset_id", "us", "eid"]].itertuples(index=False, name=None))
    assert rows_of(QUERIES["k3_duplicates_within_watermark"](spark, events_folder), "asset_id", "us", "eid") == expected


def test_newest_sources_of_a_long_stream_are_whole(spark, events_folder, monkeypatch):
    """F6"""
    outlasting_its_wait(monkeypatch)
    rows = arrived(spark, events_folder)
    rows = rows[rows["us"] <= rows["us"].max() // 1000 * 1000 - 12 * DAY_US]
    rows["eid"] += np.where(rows["eid"] % 4 == 0, 100_000_000, 0)
    expected = sorted(rows[["asset_id", "us", "eid"]].itertuples(index=False, name=None))
    assert len(expected) > 100 and rows_of(QUERIES["k3_newest_source_within_watermark"](spark, events_folder), "asset_id", "us", "eid") == expected


def test_averages_of_a_long_stream_are_whole(spark, events_folder, monkeypatch):
    """F7"""
    outlasting_its_wait(monkeypatch)
    expected = rows_of(D.numbered(spark, events_folder), "asset_id", "us", "segment_id")
    assert len(expected) == EVENTS and rows_of(QUERIES["k7_stateful_segments_and_average"](spark, events_folder), "asset_id", "us", "segment_id") == expected
