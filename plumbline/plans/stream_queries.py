"""Streaming queries, run over the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans import bindings as b
from plumbline.plans.registry import Tables, query, rounded
from plumbline.session import scratch_path
from plumbline.sources.versions import VersionedTable, stream_into
from plumbline.streaming import feeds


def _stream(t: Tables):
    schema = t.events.schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        t.folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _feed(t: Tables):
    return feeds.metric_feed(_stream(t), ["event_type"], "ts", "value", "1 day", "6 hours")


# a window is closed once the watermark, six hours behind the newest row, has passed its end
_CLOSED = """day + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) FROM events)
  - INTERVAL 6 HOUR"""


@query(f"""WITH {b.DAILY}, n AS (SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
  count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day AS window_start, day + INTERVAL 1 DAY AS window_end,
  round(metric, 6) AS metric_value, n FROM daily JOIN n USING (event_type, day) WHERE {_CLOSED}""")
def metric_feed(t: Tables):
    return rounded(feeds.run_to_table(_feed(t), "metric-feed"), "metric_value")


@query(f"""WITH RECURSIVE {b.DAILY_SCAN}
SELECT event_type, day AS window_start, day + INTERVAL 1 DAY AS window_end,
  round(metric, 6) AS metric_value, i AS position, round(e, 6) AS ewma,
  round(lim, 6) AS ewma_lower_limit, round(c, 6) AS cusum_down, trend_status
FROM points WHERE {_CLOSED}""")
def stream_drift_monitor(t: Tables):
    base = b.daily_baseline(b.daily(t)).select("event_type", "baseline_mean", "baseline_std")
    charts = feeds.stream_drift_monitor(_feed(t).join(base, "event_type"), "event_type")
    return rounded(feeds.run_to_table(charts, "stream-drift"), "metric_value", "ewma",
                   "ewma_lower_limit", "cusum_down")


@query(f"""WITH RECURSIVE {b.DAILY},
numbered AS (SELECT event_type, day, metric, mu, sd,
    row_number() OVER (PARTITION BY event_type ORDER BY day) AS i
  FROM daily JOIN base USING (event_type) WHERE event_type <> 'error' AND day(day) NOT IN (12, 20)),
{b.scan_sql("event_type", "day", "metric", "numbered")}
SELECT event_type, d.day AS window_start, CASE WHEN event_type = 'error' THEN 'NO_BASELINE'
    WHEN day(d.day) IN (12, 20) THEN 'NO_VALUE' ELSE p.trend_status END AS trend_status,
  coalesce(p.i, 0)::BIGINT AS position, round(p.e, 6) AS ewma, round(p.c, 6) AS cusum_down
FROM daily d LEFT JOIN numbered n USING (event_type, day) LEFT JOIN points p USING (event_type, i)
WHERE {_CLOSED.replace("day +", "d.day +")}""")
def stream_drift_gaps(t: Tables):
    """A day without values, a day without rows, and a series whose baseline has no spread."""
    rows = _stream(t).where(F.dayofmonth("ts") != 20).withColumn(
        "value", F.when(F.dayofmonth("ts") != 12, F.col("value")))
    feed = feeds.metric_feed(rows, ["event_type"], "ts", "value", "1 day", "6 hours")
    spread = F.when(F.col("event_type") != "error", F.col("baseline_std")).otherwise(0.0)
    base = b.daily_baseline(b.daily(t)).select("event_type", "baseline_mean", spread.alias("baseline_std"))
    charts = feeds.stream_drift_monitor(feed.join(base, "event_type"), "event_type")
    return rounded(feeds.run_to_table(charts, "stream-gaps").select(
        "event_type", "window_start", "trend_status", F.coalesce("position", F.lit(0)).alias("position"),
        "ewma", "cusum_down"), "ewma", "cusum_down")


@query("SELECT DISTINCT sha256(event_type || '|' || props) AS digest FROM events")
def stream_dedupe(t: Tables):
    rows = _stream(t).select(F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("digest"),
                             "ts")
    first = feeds.stream_dedupe(rows, "digest", "ts", "60 days")
    return feeds.run_to_table(first, "stream-dedupe").select("digest")


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_to_table(t: Tables):
    """A stream added to an audit table in batches, run twice over the same input."""
    table = VersionedTable(t.spark, scratch_path(t.spark, "stream-table"))
    rows = _stream(t).select("event_id", "user_id", "event_type", "value")
    for _ in range(2):  # the second run has lost its checkpoint and sends every batch again
        stream_into(rows, table, "events", scratch_path(t.spark, "stream-table-checkpoint"))
    return table.read()
