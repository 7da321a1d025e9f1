"""Rule evaluation, anomalies, episodes, scores and the alert table on the acceptance cases."""

import time
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantpulse import session
from plantpulse.catalog import rules as R
from plantpulse.catalog import signals as S
from plantpulse.operators import alerts, episodes, quality, triage
from plantpulse.operators.features import numbered_readings
from plantpulse.registry import dataset as D
from plantpulse.registry import tables
from plantpulse.sources.alert_table import AlertTable
from plantpulse.sources.rules import builtin_rules, invalid_rules, read_rules

from .helpers import NORMAL, START, minutes, to_spark


def _full(frame: pd.DataFrame) -> pd.DataFrame:
    for signal in S.NUMERIC_SIGNALS:
        if signal not in frame.columns:
            frame[signal] = np.nan
    return frame


def _numbered(spark, frame):
    typed = to_spark(spark, _full(frame))
    return numbered_readings(typed)


def test_pressure_outside_band_fires_two_rules_and_scores(spark):
    numbered = _numbered(spark, minutes({"pv_pres_sistema_bar": [8.2], "pv_pres_vacuo_cx_engran_inh2o": [25.0]}))
    rules = builtin_rules(spark)
    hits = alerts.fixed_rule_hits(numbered, rules).unionByName(alerts.anomaly_hits(numbered, rules))
    fired = {r.rule_id: r for r in hits.collect()}
    assert {"rede_pressao_alta", "pressao_sistema_fora_faixa", "vacuo_caixa_engr_fora_faixa", "vacuo_possivel_inconsistencia"} == set(fired)
    assert fired["pressao_sistema_fora_faixa"].threshold == "5.0..7.8" and fired["rede_pressao_alta"].threshold == "gt 6.9"
    assert fired["vacuo_possivel_inconsistencia"].message.endswith("do transmissor.")
    active = episodes.mark_active(episodes.build_episodes(hits), numbered)
    scores = {r.subsystem: r for r in episodes.complete_scores(episodes.risk_scores(active), numbered).collect()}
    assert scores["ar_processo"].score == 83.0 and scores["ar_processo"].highest_severity == "high"
    assert scores["vibracao"].score == 0.0 and len(scores) == 5


def test_mode_gate_blocks_other_modes(spark):
    numbered = _numbered(spark, minutes({"pv_pres_sistema_bar": [8.2]}, mode="PARTINDO|CARREGADO"))
    assert alerts.fixed_rule_hits(numbered, builtin_rules(spark)).count() == 0


@pytest.mark.parametrize("n, stuck", [(20, False), (44, False), (50, True)])
def test_constant_current_is_stuck_after_45_minutes(spark, n, stuck):
    frame = minutes({"pv_corr_motor_a": [181.0] * n})
    found = alerts.rolling_stuck(_numbered(spark, frame), ["pv_corr_motor_a"]).collect()
    batch = quality.stuck_sensors(to_spark(spark, frame), ["pv_corr_motor_a"]).collect()
    assert bool(found) == bool(batch) == stuck
    if stuck:
        assert len(found) == n - 44 and found[0].window_minutes >= 45 and batch[0].window_points == 45


def test_gap_in_a_stuck_series_keeps_the_verdict_only_within_reach(spark):
    values = [181.0] * 45 + [np.nan] * 200
    found = alerts.rolling_stuck(_numbered(spark, minutes({"pv_corr_motor_a": values})), ["pv_corr_motor_a"])
    rows = sorted(r.row_idx for r in found.collect())
    # the first of the 45 points is row 1, and a reading looks back over itself and 180 readings
    assert rows == list(range(45, 182))


def test_six_zeros_are_an_active_anomaly_and_a_single_value_ends_it(spark):
    numbered = _numbered(spark, minutes({"pv_temp_ar_estagio_3_c": [0.0] * 6 + [41.0] + [0.0] * 2}))
    hits = alerts.anomaly_hits(numbered, builtin_rules(spark)).where(F.col("rule_id") == "temperatura_estagio_3_zerada")
    assert sorted(r.row_idx for r in hits.collect()) == [3, 4, 5, 6]


def _trend_row(z, std, ma, value):
    frame = minutes({"pv_vib_max_mils": [value]})
    return frame.assign(**{"pv_vib_max_mils__zscore_1h": z, "pv_vib_max_mils__std_1h": std, "pv_vib_max_mils__ma_1h": ma}, row_idx=1)


def test_zscore_guardrail(spark):
    rules = builtin_rules(spark)
    assert alerts.trend_rule_hits(to_spark(spark, _trend_row(4.2, 0.001, 0.300, 0.302)), rules).count() == 0
    hit = alerts.trend_rule_hits(to_spark(spark, _trend_row(4.2, 0.03, 0.24, 0.38)), rules).first()
    assert hit.rule_id == "vibracao_max_em_alta" and hit.metadata["analysis_reason"] == R.REASON_OUTLIER


def test_rules_round_trip_and_validation(spark, tmp_path):
    import json

    path = tmp_path / "rules.json"
    path.write_text(json.dumps(R.rule_documents()), encoding="utf-8")
    loaded = read_rules(spark, str(path))
    assert loaded.groupBy("layer").count().collect().__len__() == 3 and loaded.count() == 21
    assert sorted(map(str, loaded.select("rule_id", "threshold", "min_value").collect())) == sorted(
        map(str, builtin_rules(spark).select("rule_id", "threshold", "min_value").collect()))
    assert invalid_rules(loaded).count() == 0
    assert invalid_rules(loaded.withColumn("condition", F.lit("about"))).count() == 19


def test_an_alert_that_never_stops_is_cut_into_small_blocks(spark):
    """One task sorted up to a million wide hits of one alert."""
    assert episodes.EPISODE_BLOCK <= 100_000
    n = 2 * episodes.EPISODE_BLOCK + 5
    text = {c: F.lit(c) for c in ("alert_id", "rule_id", "layer", "subsystem", "signal", "severity", "title", "message", "threshold", "mode_key")}
    hits = spark.range(1, n + 1).select(F.lit(1).cast("bigint").alias("asset_id"), F.col("id").alias("row_idx"), F.col("id").alias("us"),
                                        F.col("id").cast("double").alias("current_value")).withColumns(text | {"metadata": F.create_map(F.lit("k"), F.lit("v"))})
    one, = episodes.build_episodes(hits).collect()
    assert (one["first_row"], one["last_row"], one["readings"], one["current_value"]) == (1, n, n, float(n))


@pytest.mark.parametrize("block", [4, 7, 1 << 20])
def test_episodes_do_not_depend_on_blocks(spark, block):
    """One alert that never stops, one that flickers, one random: brute force against several block sizes."""
    rng = np.random.default_rng(8)
    n, rows = 60, []
    for name, fires in {"always": np.ones(n, bool), "flicker": np.arange(n) % 2 == 0, "random": rng.random(n) < 0.6}.items():
        rows += [dict(asset_id=1, alert_id=name, row_idx=i + 1, us=(i + 1) * 10, current_value=float(i)) for i in range(n) if fires[i]]
    frame = pd.DataFrame(rows)
    expected = set()
    for name, g in frame.groupby("alert_id"):
        start = prev = None
        for i in g["row_idx"]:
            if start is None:
                start = i
            elif i != prev + 1:
                expected.add((name, start, prev)); start = i
            prev = i
        expected.add((name, start, prev))
    hits = to_spark(spark, frame).withColumns({c: F.lit("t") for c in ["rule_id", "layer", "subsystem", "signal", "severity", "title", "message", "threshold", "mode_key"]})
    hits = hits.withColumn("metadata", F.create_map(F.lit("row"), F.col("row_idx").cast("string")))
    found = episodes.build_episodes(hits, block).collect()
    assert {(r.alert_id, r.first_row, r.last_row) for r in found} == expected
    assert all(r.current_value == r.last_row - 1 and r.metadata["row"] == str(r.last_row) and r.readings == r.last_row - r.first_row + 1 for r in found)


def _episode(alert_id, triggered, seen, value):
    return dict(asset_id=1, alert_id=alert_id, rule_id="r", layer="fixed_rule", subsystem="motor", signal="s", severity="high", title="t", message="m",
                triggered_us=triggered, last_seen_us=seen, current_value=value, threshold="gt 1", mode_key=NORMAL)


def test_alert_table_keeps_first_trigger_and_is_idempotent(spark, tmp_path):
    def alerts_of(*rows):
        schema = ("asset_id bigint, alert_id string, rule_id string, layer string, subsystem string, signal string, severity string, title string, "
                  "message string, triggered_us bigint, last_seen_us bigint, current_value double, threshold string, mode_key string")
        names = [p.strip().split(" ")[0] for p in schema.split(",")]
        df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
        return df.withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))

    table = AlertTable(spark, str(tmp_path / "alerts"))
    assert table.read().count() == 0
    table.replace_active(alerts_of(_episode("a", 1, 5, 1.0), _episode("b", 2, 5, 2.0)), 0)
    for _ in range(2):
        table.replace_active(alerts_of(_episode("a", 8, 9, 3.0), _episode("c", 9, 9, 4.0)), 1)
    rows = {r.alert_id: r for r in table.list_alerts(active_only=False).collect()}
    assert rows["a"].triggered_us == 1 and rows["a"].last_seen_us == 9 and rows["a"].current_value == "3.0" and rows["a"].metadata == {"k": "v"}
    assert not rows["b"].is_active and rows["c"].is_active
    assert [r.alert_id for r in table.list_alerts().collect()] == ["a", "c"]


def test_stuck_notices_are_not_explained(spark):
    rows = [("fixed_rule", "x", True), ("operational_anomaly", "sensor_stuck::s", False), ("operational_anomaly", "zerada", True), ("predictive_statistics", "p", True)]
    df = spark.createDataFrame(rows, "layer string, rule_id string, expected boolean")
    assert df.where(triage.is_explained() != F.col("expected")).count() == 0


def test_doubled_hits_count_once(spark):
    from plantpulse.operators import alerts, episodes

    rows = [(1, 60_000_000 * k, k, "a") for k in (1, 2, 3, 4, 5, 6, 9, 10)]
    frame = spark.createDataFrame(rows, "asset_id long, us long, row_idx long, alert_id string")
    full = frame.select("*", *[F.lit(None).cast("map<string,string>" if c == "metadata" else "string").alias(c) for c in episodes.FROM_FIRST + episodes.FROM_LAST])
    for block_rows in (4, 1 << 20):
        found = episodes.build_episodes(full.unionByName(full), block_rows).orderBy("first_row").collect()
        assert [(r.first_row, r.last_row, r.readings) for r in found] == [(1, 6, 6), (9, 10, 2)]


def test_measured_sides_are_broadcast_and_hot_assets_are_not_shuffled(spark):
    from plantpulse.operators.serving import time_range

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        readings = spark.range(1000).selectExpr("id % 3 AS asset_id", "id * 1000000 AS us", "timestamp_micros(id * 1000000) AS ts")
        plan = time_range(readings, 1, "hours")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("max_rows", [10, 1000])
def test_places_in_a_long_history(spark, max_rows):
    """Ties of time go by severity and id; cells are split down to instants and the places run on across them."""
    rng = np.random.default_rng(6)
    rows = [(1 if k % 5 else 2, f"a{k % 4}", int(1_700_000_000_000_000 + rng.integers(0, 60) * 10**9), ["low", "high", "critical"][k % 3], k) for k in range(300)]
    frame = spark.createDataFrame(rows, "asset_id bigint, alert_id string, last_seen_us bigint, severity string, triggered_us bigint")
    found = [(r.asset_id, r.place, r.triggered_us) for r in episodes.placed_events(frame, max_rows).collect()]
    weight = {"low": 0, "high": 1, "critical": 2}
    expected = []
    for asset in (1, 2):
        own = sorted((r for r in rows if r[0] == asset), key=lambda r: (-r[2], -weight[r[3]], r[1], -r[4]))
        expected += [(asset, place, r[4]) for place, r in enumerate(own, 1)]
    assert sorted(found) == expected


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {name.rsplit("/", 1)[-1] for name in found if "shuffle_" in name}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """what was shuffled for a staged table stayed on disk next to it until the driver's garbage was collected."""
    before = shuffle_files(spark)
    setting = spark.conf.get(session._RELEASE, None)
    table = session.stored(spark.range(20_000).withColumn("k", F.xxhash64("id") % 50).repartition(6, "k").groupBy("k").agg(F.collect_list("id").alias("ids")))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(session._RELEASE, None) == setting and table.agg(F.sum(F.size("ids"))).first()[0] == 20_000


@pytest.fixture(scope="module")
def events_folder(spark, tmp_path_factory):
    """Readings of four assets every few minutes, over three days."""
    folder = str(tmp_path_factory.mktemp("events"))
    spark.sql("SELECT id AS event_id, timestamp_micros(1704067200000000 + id * 173000000)::timestamp_ntz AS ts, id % 7 AS user_id, 'a' AS event_type, "
              "(id * 37 % 101) * 2.0D AS value, concat('{\"k\": ', id * 13 % 97, '}') AS props FROM range(1500)").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture
def stages(monkeypatch):
    """The columns of each staged table, from an empty store."""
    written = []
    plain = tables.stored
    monkeypatch.setattr(tables, "_STAGES", {})
    monkeypatch.setattr(tables, "stored", lambda df: written.append(df.columns) or plain(df))
    return written


def test_features_of_hits_are_not_stored(spark, events_folder, stages):
    """every feature of every signal was stored with the readings, three quarters of what a8 wrote."""
    shown = ["asset_id", "us", "row_idx", "mode_key", "alert_id", "rule_id", "layer", "severity", "threshold", F.round("current_value", 6)]
    found = tables.hits(spark, events_folder)
    assert len(stages) == 2 and not any("__" in c for columns in stages for c in columns)
    expected = alerts.all_hits(tables.features(spark, events_folder), builtin_rules(spark))
    assert {r["layer"] for r in found.select("layer").distinct().collect()} == {"fixed_rule", "trend", "operational_anomaly"}
    assert sorted(map(str, found.select(shown).collect())) == sorted(map(str, expected.select(shown).collect()))


def test_readings_are_numbered_while_narrow(spark, events_folder, monkeypatch):
    """all signals of a reading went through the shuffle that numbers the readings."""
    expected = numbered_readings(D.readings(spark, events_folder))
    taken = []
    monkeypatch.setattr(D, "numbered_readings", lambda df: taken.append(df.columns) or numbered_readings(df))
    found = D.numbered(spark, events_folder)
    assert len(taken) == 1 and not set(taken[0]) & {*S.NUMERIC_SIGNALS}
    assert found.schema == expected.schema and sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
