"""Queries that run as streams over the files of a table; windows on event time go beyond the batch operators.

The tables are finite, so windows take no watermark: it would drop what comes late, and keep back what is still open.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.catalog import query
from siftstone.streaming import micro


@query("SELECT event_type, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    """X11: daily counts by event time; no row is late, however the files are ordered."""
    e = micro.source(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    rows = e.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    days = micro.latest_result(rows.select("event_type", F.col("window.start").alias("start"), "n", "total"))
    return days.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


@query("WITH e AS (SELECT event_type, epoch_us(ts) // 43200000000 AS h FROM events), w AS (SELECT event_type, unnest([h, h - 1]) AS h FROM e) SELECT event_type, strftime(make_timestamp(h * 43200000000), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM w GROUP BY ALL")
def stream_sliding(spark, d):
    """X11: windows of a day that begin every twelve hours; each row is in two."""
    e = micro.source(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    rows = e.groupBy(F.window("at", "1 day", "12 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    windows = micro.latest_result(rows.select("event_type", F.col("window.start").alias("start"), "n"))
    return windows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    """Each key once, however often it comes."""
    e = micro.source(spark, d, "events").select("user_id", "event_type")
    return micro.run_to_table(e.dropDuplicates(["user_id", "event_type"]))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_latest(spark, d):
    """The latest event of each user, merged batch by batch."""
    return micro.upsert_latest(micro.source(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def stream_fingerprints(spark, d):
    """Fingerprints in micro-batches, each one committed."""
    return micro.run_to_table(micro.source(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash")))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, d):
    """X11: sessions of a user's events with gaps under an hour; no row is late, and the last sessions are there."""
    e = micro.source(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    rows = e.groupBy(F.session_window("at", "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    sessions = micro.latest_result(rows.select("user_id", F.col("session_window.start").alias("start"), "n"))
    return sessions.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
