"""Streaming queries over `events`, run to the end of what is there and compared with their batch equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekwell.plans.registry import query
from seekwell.plans.service import GAPS
from seekwell.session import new_folder, table
from seekwell.streaming import streams


PARTS = 3


def events_in_time(spark, d):
    """`events` as a stream of several files, one to a batch: state and watermarks pass from batch to batch."""
    folder = streams.in_files(table(spark, d, "events"), new_folder(spark, "events"), PARTS)
    return streams.event_stream(spark, folder, None, 1)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_keyword_counts(spark, d):
    return streams.run_to_end(streams.keyword_counts(events_in_time(spark, d), "event_type"), "complete")


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS events FROM events")
def stream_dedup(spark, d):
    seen = streams.run_to_end(streams.first_seen(events_in_time(spark, d), ["user_id"], "ts", "400 days"))
    return seen.agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("events"))


def _window(width: str) -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"""


def _flat(df, *keys):
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), *keys, "n", F.round("total", 6).alias("total"))


@query(_window("1 day"))
def stream_tumbling(spark, d):
    """Complete mode shows every window; in append mode the last ones wait for the watermark."""
    out = streams.run_to_end(streams.windowed(events_in_time(spark, d), ["event_type"], "1 day", None, "1 day"), "complete")
    return _flat(out, "event_type")


@query("""SELECT time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '12 hours' AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, (VALUES (0), (1)) t(k) GROUP BY 1, 2""")
def stream_sliding(spark, d):
    out = streams.run_to_end(streams.windowed(events_in_time(spark, d), ["event_type"], "1 day", "12 hours", "1 day"), "complete")
    return _flat(out, "event_type")


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, d):
    out = streams.run_to_end(streams.sessions(events_in_time(spark, d), "user_id", "6 hours", "1 day"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"SELECT event_id, host, gap_us, coalesce(gap_us > 3600000000, true) AS ready FROM ({GAPS})")
def stream_paced(spark, d):
    return streams.run_to_end(streams.paced(events_in_time(spark, d), "user_id", 3600)).select("event_id", "host", "gap_us", "ready")


@query()
def stream_cache(spark, d):
    """Hits and misses of a cache with a time to live; sequential by nature, so tests compare with a plain loop."""
    out = streams.run_to_end(streams.cached(events_in_time(spark, d), "user_id", 6 * 3600))
    return out.groupBy("hit").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) AS tf FROM events GROUP BY 1, 2")
def stream_merged_index(spark, d):
    return streams.merged_index(events_in_time(spark, d), ["user_id", "event_type"])


@query("SELECT count(*) AS total, count(*) >= 100 AS reached FROM events")
def stream_progress(spark, d):
    reached: list[int] = []
    streams.progress(events_in_time(spark, d), "user_id", 100, reached.append)
    return spark.range(1).select(F.lit(max(reached, default=0)).cast("bigint").alias("total"), F.lit(bool(reached)).alias("reached"))
