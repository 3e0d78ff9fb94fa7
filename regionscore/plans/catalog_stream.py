"""Streaming queries (R-1…R-3) over the events table, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionscore.plans.catalog import _r, query
from regionscore.streaming import intake as ST


@query("stream_intake", "SELECT event_id, user_id, event_type, value, ts FROM events")
def stream_intake(spark, d):
    return ST.intake_events(spark, d).select("event_id", "user_id", "event_type", "value", "ts")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def stream_dedup(spark, d):
    return ST.dedup_events(spark, d)


@query("stream_late", """
WITH e AS (SELECT *, event_id % 4 AS k FROM events), m AS (SELECT k, max(ts) AS mark FROM e GROUP BY k),
w AS (SELECT a.k, max(b.mark) - INTERVAL 1 HOUR AS mark FROM m a LEFT JOIN m b ON b.k < a.k GROUP BY a.k),
s AS (SELECT e.*, coalesce(ts < w.mark, false) AS late FROM e JOIN w ON e.k = w.k)
SELECT event_id, user_id, event_type, hour, side FROM (
  SELECT event_id, user_id, event_type, date_trunc('hour', ts) AS hour, 'kept' AS side,
         row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY k, ts, event_id) AS i FROM s WHERE NOT late) WHERE i = 1
UNION ALL SELECT event_id, user_id, event_type, date_trunc('hour', ts), 'late' FROM s WHERE late""")
def stream_late(spark, d):
    """The first row of each key, and the rows that came late, of a stream with a side output."""
    return ST.late_events(spark, d)


@query("stream_signal", """
SELECT event_type, round(avg(value), 6) AS mean_score, count(*) AS n FROM events GROUP BY event_type""")
def stream_signal(spark, d):
    return ST.signal_events(spark, d).select("event_type", _r("mean_score").alias("mean_score"), F.col("n"))
