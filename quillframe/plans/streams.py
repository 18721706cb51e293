"""Streaming queries, run over what is there, with batch SQL as counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.streaming import events


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.run_available(events.windowed(events.read_events(spark, sf_dir), "1 day"), "complete")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.run_available(events.windowed(events.read_events(spark, sf_dir), "12 hours", "6 hours"), "complete")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.run_available(events.sessions(events.read_events(spark, sf_dir), "2 hours"), "complete")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's types, each once, in the order of time as far as the watermark reaches."""
    seen = events.first_of_key(events.read_events(spark, sf_dir), ["user_id", "event_type"], "60 days")
    return events.run_available(seen, "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.run_available(events.running_totals(events.read_events(spark, sf_dir)), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


QUERIES = {f"q_{f.__name__}": f for f in (stream_tumbling, stream_sliding, stream_session, stream_dedup, stream_totals)}

ORACLES = {
    "q_stream_tumbling": "SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "q_stream_sliding": """
        WITH w AS (SELECT *, unnest([time_bucket(INTERVAL 6 hours, ts), time_bucket(INTERVAL 6 hours, ts) - INTERVAL 6 hours]) AS s FROM events)
        SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2""",
    "q_stream_session": """
        WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 hours THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "q_stream_dedup": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "q_stream_totals": "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1",
}
