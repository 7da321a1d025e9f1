"""Streaming operators (2.K): the events table split into files and replayed, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import signals as S
from ..config import DAY_US, HOUR_US
from ..operators.alerts import fixed_rule_hits, trend_feature_plan
from ..session import shared_folder, stored
from ..sources.alert_table import AlertTable
from ..sources.rules import builtin_rules
from ..streaming import carried, flows
from . import dataset as D
from .alerts import HITS, _table_view
from .common import query, r, sr

_KEPT = ["asset_id", "eid", "ts", "us", "day", "mode_key", "pv_corr_motor_a"]
_SPLIT = 10  # days per landing
_FILES = 4  # files per landing, written by as many tasks; a micro-batch takes one landing


def _landed(spark, sf, columns, extra=None):
    """Readings as they land, ten days at a time and in order, so that the file source replays the landings in order."""
    folder = shared_folder(spark)
    rows = D.readings(spark, sf).select(*columns)
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    for start in range(first, last + 1, _SPLIT):
        landing = F.col("day").between(start, start + _SPLIT - 1)
        if extra is None:
            part = D.readings(spark, sf, files=_FILES).where(landing).select(*columns)
        else:
            part = extra(rows.where(landing), start).repartition(_FILES)
        part.write.mode("append").parquet(folder)
    return folder, rows.schema


def _stream(spark, sf, extra=None, columns=_KEPT):
    folder, schema = _landed(spark, sf, columns, extra)
    return flows.reading_stream(spark, folder, schema, files_per_batch=_FILES)


def _collected(spark, stream):
    folder = shared_folder(spark)
    flows.drain(flows.append_to(stream, f"{folder}/out", f"{folder}/state"))
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("k1_incremental_ingestion", f"WITH {D.READINGS_SQL} SELECT asset_id, us, eid FROM readings")
def incremental_ingestion(spark, sf):
    return _collected(spark, flows.observed_rows(_stream(spark, sf))).select("asset_id", "us", "eid")


@query("k2_k4_late_rows_and_bounded_history", f"""
WITH {D.READINGS_SQL}, w AS (SELECT *, max(us) OVER (PARTITION BY asset_id) AS newest FROM readings)
SELECT asset_id, us, eid FROM w WHERE us >= newest - {3 * DAY_US}""")
def bounded_history(spark, sf):
    history, last = _history_with_late_rows(spark, sf)
    return history.at(last).select("asset_id", "us", "eid")


def _history_with_late_rows(spark, sf):
    rows = D.readings(spark, sf).select(*_KEPT)

    def with_late(part, start):
        """Every landing also brings old rows again, with another value: they are late and must not win."""
        late = rows.where((F.col("day") < start) & (F.pmod("eid", F.lit(3)) == 0)).withColumn("eid", F.lit(-1).cast("bigint"))
        return part.unionByName(late)

    history = flows.BoundedHistory(spark, shared_folder(spark), 3 * DAY_US)
    numbers = []
    def work(batch, number):
        history.add(batch, number, order=("us", "eid"))
        numbers.append(number)
    flows.drain(flows.per_batch(_stream(spark, sf, with_late), work, shared_folder(spark)))
    return history, max(numbers)


@query("k2_late_row_counts", f"""
WITH {D.READINGS_SQL}, first AS (SELECT min(day) AS d FROM readings),
part AS (SELECT r.*, (day - d) // {_SPLIT} AS batch, d FROM readings r, first),
old AS (SELECT b.batch, count(*) AS late_rows, sum(us)::BIGINT AS late_times FROM (SELECT DISTINCT batch FROM part) b JOIN part p ON p.batch < b.batch AND p.eid % 3 = 0 GROUP BY 1),
new AS (SELECT batch, count(*) AS new_rows, max(us) AS newest_us FROM part GROUP BY 1)
SELECT batch, new_rows + coalesce(late_rows, 0) AS rows, new_rows, coalesce(late_rows, 0) AS late_rows, newest_us, coalesce(late_times, 0) AS late_times
FROM new LEFT JOIN old USING (batch)""")
def late_row_counts(spark, sf):
    """The counts of each micro-batch, and the times of the rows that the side table keeps."""
    history, _ = _history_with_late_rows(spark, sf)
    kept = _summed_times(history.late_rows())
    return history.counts().join(kept, "batch", "left").withColumn("late_times", F.coalesce("late_times", F.lit(0).cast(kept.schema["late_times"].dataType)))


def _summed_times(late):
    """Sum of the event times per micro-batch, exact at any number of rows.

    Some thousands of times in microseconds pass 64 bits, so the sum is a decimal; the column is a bigint where every sum fits one.
    """
    kept = stored(late.groupBy("batch").agg(F.sum(F.col("us").cast("decimal(38,0)")).alias("late_times")))
    widest = kept.agg(F.max(F.abs("late_times"))).first()[0]
    return kept if widest is not None and widest >= 1 << 63 else kept.withColumn("late_times", F.col("late_times").cast("bigint"))


@query("k3_duplicates_within_watermark", f"WITH {D.READINGS_SQL} SELECT asset_id, us, eid FROM readings")
def duplicates(spark, sf):
    twice = lambda part, _start: part.unionByName(part.where(F.pmod("eid", F.lit(4)) == 0))
    return _collected(spark, flows.first_per_timestamp(_stream(spark, sf, twice), "10 days")).select("asset_id", "us", "eid")


@query("k3_newest_source_within_watermark", f"""
WITH {D.READINGS_SQL}, mark AS (SELECT max(us) // 1000 * 1000 - {12 * DAY_US} AS m FROM readings)
SELECT asset_id, us, CASE WHEN eid % 4 = 0 THEN eid + 100000000 ELSE eid END AS eid FROM readings, mark WHERE us <= m""")
def newest_source(spark, sf):
    """Each landing brings a quarter of the rows of the landing before again, from a newer source: these win while the watermark waits."""
    rows = D.readings(spark, sf).select(*_KEPT)

    def replaced(part, start):
        again = rows.where(F.col("day").between(start - _SPLIT, start - 1) & (F.pmod("eid", F.lit(4)) == 0))
        return part.unionByName(again.withColumn("eid", F.col("eid") + 100_000_000))

    found = _collected(spark, flows.newest_per_timestamp(_stream(spark, sf, replaced), "eid", "12 days"))
    return found.select("asset_id", "us", "eid")


@query("k5_tumbling_buckets", f"""
WITH {D.READINGS_SQL}, mark AS (SELECT max(us) - {HOUR_US} AS m FROM readings)
SELECT asset_id, us - us % {HOUR_US} AS us, {sr('avg(pv_corr_motor_a)', 'value')}, arg_max(mode_key, us) AS mode_key, count(pv_corr_motor_a) AS points
FROM readings, mark GROUP BY asset_id, us - us % {HOUR_US} HAVING us - us % {HOUR_US} + {HOUR_US} <= any_value(m)""")
def tumbling_buckets(spark, sf):
    found = _collected(spark, flows.bucket_stream(_stream(spark, sf), "pv_corr_motor_a"))
    return found.select("asset_id", "us", r("value"), "mode_key", "points")


@query("k6_sliding_statistics", f"""
WITH {D.READINGS_SQL}, mark AS (SELECT max(us) - {HOUR_US} AS m FROM readings),
w AS (SELECT asset_id, pv_corr_motor_a AS v, (us // {HOUR_US} + i) * {HOUR_US} AS ends FROM readings, range(1, 7) t(i))
SELECT asset_id, ends AS us, {sr('avg(v)', 'mean')}, {sr('stddev_samp(v)', 'std')}, {sr('min(v)', 'minimum')}, {sr('max(v)', 'maximum')} FROM w, mark GROUP BY 1, 2 HAVING ends <= any_value(m)""")
def sliding_statistics(spark, sf):
    found = _collected(spark, flows.sliding_stream(_stream(spark, sf), "pv_corr_motor_a"))
    return found.select("asset_id", "us", *[r(c) for c in ("mean", "std", "minimum", "maximum")])


def _feature_columns(wanted):
    return [f"{s}__{f}" for s, fs in wanted.items() for f in fs]


def _per_batch(name: str, wanted: dict[str, list[str]]):
    """Register the features of each micro-batch."""
    columns = _feature_columns(wanted)

    @query(name, f"WITH {D.features_sql(wanted)} SELECT asset_id, us, {', '.join(sr(c, c) for c in columns)} FROM features")
    def run(spark, sf):
        folder = shared_folder(spark)
        history = flows.BoundedHistory(spark, f"{folder}/history", DAY_US)
        stream = _stream(spark, sf, columns=[*_KEPT, *[s for s in wanted if s not in _KEPT]])
        flows.drain(flows.per_batch(stream, flows.feature_batches(history, f"{folder}/features", wanted, D.WIDTHS), f"{folder}/state"))
        return spark.read.parquet(f"{folder}/features").select("asset_id", "us", *[r(c) for c in columns])

    return run


_STATISTICS = ["ma_15m", "ma_1h", "std_1h", "slope_1h"]
_per_batch("k6_features_per_batch", {"pv_corr_motor_a": _STATISTICS})
_per_batch("k6_features_per_batch_of_trend_signals", {s: _STATISTICS for s in sorted(trend_feature_plan())})


_ALL = list(S.NUMERIC_SIGNALS)
_AVERAGES = [f"{s}__ewma" for s in _ALL]


@query("k7_stateful_segments_and_average", f"""
WITH {D.features_sql({s: ['ewma'] for s in _ALL})} SELECT asset_id, us, segment_id, {', '.join(sr(c, c) for c in _AVERAGES)} FROM features""")
def stateful_segments(spark, sf):
    """Segments and weighted averages of all signals, carried from micro-batch to micro-batch."""
    carry = carried.SmoothedStream(spark, shared_folder(spark), _ALL)
    stream = _stream(spark, sf, columns=[*_KEPT, *[s for s in _ALL if s not in _KEPT]])
    flows.drain(flows.per_batch(stream, carry.work, shared_folder(spark)))
    return carry.results().select("asset_id", "us", "segment_id", *[r(c) for c in _AVERAGES])


def _fixed_hits(numbered):
    return fixed_rule_hits(numbered, builtin_rules(numbered.sparkSession))


_EPISODE_SQL = f"""
f AS (SELECT * FROM hits WHERE layer = 'fixed_rule'),
i AS (SELECT *, row_idx - row_number() OVER (PARTITION BY asset_id, alert_id ORDER BY row_idx) AS island FROM f),
newest AS (SELECT asset_id, max(us) AS m FROM readings GROUP BY 1)"""


@query("k7_stateful_episodes", f"""
WITH {HITS}, {_EPISODE_SQL}
SELECT i.asset_id, alert_id, any_value(rule_id) AS rule_id, min(us) AS triggered_us, max(us) AS last_seen_us, count(*) AS readings,
  {sr('arg_max(current_value, row_idx)', 'v')}, CASE WHEN max(us) = any_value(m) THEN 1 ELSE 0 END AS active
FROM i JOIN newest n ON i.asset_id = n.asset_id GROUP BY i.asset_id, alert_id, island""")
def stateful_episodes(spark, sf):
    """Episodes of all fixed rules, open ones included."""
    carry = carried.EpisodeStream(spark, shared_folder(spark), _fixed_hits)
    flows.drain(flows.per_batch(_stream(spark, sf, columns=_EVERY), carry.work, shared_folder(spark)))
    return carry.episodes().select("asset_id", "alert_id", "rule_id", "triggered_us", "last_seen_us", "readings", r(F.col("current_value").cast("double"), 4, "v"),
                                   F.col("is_active").cast("int").alias("active"))


_EVERY = [*_KEPT, *[s for s in _ALL if s not in _KEPT]]


def _open_sql(batch: int) -> str:
    name = f"o{batch}"
    return f"""{name}_n AS (SELECT n.* FROM numbered n, (SELECT min(day) AS d FROM readings) WHERE day < d + {(batch + 1) * _SPLIT}),
{name}_e AS (SELECT asset_id, max(us) AS m FROM {name}_n GROUP BY 1),
{name}_i AS (SELECT f.*, f.row_idx - row_number() OVER (PARTITION BY f.asset_id, alert_id ORDER BY f.row_idx) AS island FROM f JOIN {name}_e e ON f.asset_id = e.asset_id AND f.us <= e.m),
{name} AS (SELECT i.asset_id, alert_id, any_value(rule_id) AS rule_id, min(us) AS t, max(us) AS l, arg_max(current_value, us) AS v FROM {name}_i i
  JOIN {name}_e e ON i.asset_id = e.asset_id GROUP BY i.asset_id, alert_id, island HAVING max(us) = any_value(m))"""


def _upsert_sql(new: str, old: str, name: str) -> str:
    return f"""{name} AS (SELECT coalesce(o.asset_id, n.asset_id) AS asset_id, coalesce(o.alert_id, n.alert_id) AS alert_id, coalesce(o.rule_id, n.rule_id) AS rule_id,
  coalesce(o.t, n.t) AS t, coalesce(n.l, o.l) AS l, coalesce(n.v, o.v) AS v, (n.asset_id IS NOT NULL)::INT AS active FROM {old} o FULL JOIN {new} n ON o.asset_id = n.asset_id AND o.alert_id = n.alert_id)"""


@query("k8_alert_upsert_per_batch", f"""
WITH {HITS}, {_EPISODE_SQL}, {_open_sql(0)}, {_open_sql(1)}, {_open_sql(2)}, {_upsert_sql('o1', 'o0', 'ab')}, {_upsert_sql('o2', 'ab', 'abc')}
SELECT asset_id, alert_id, rule_id, t AS triggered_us, l AS last_seen_us, {sr('v', 'v')}, active FROM abc""")
def upsert_per_batch(spark, sf):
    """The open episodes of all fixed rules go to the alert table after each micro-batch; no history is read for it."""
    folder = shared_folder(spark)
    table = AlertTable(spark, f"{folder}/alerts")
    carry = carried.EpisodeStream(spark, f"{folder}/episodes", _fixed_hits)

    def work(batch, number):
        carry.work(batch, number)
        table.replace_active(carry.active(number), number)

    flows.drain(flows.per_batch(_stream(spark, sf, columns=_EVERY), work, f"{folder}/state"))
    return _table_view(table.list_alerts(active_only=False))
