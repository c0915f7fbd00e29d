"""Queries that run as streams over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..streaming.events import event_stream, first_seen, sessions, sliding, tumbling, upsert_to_end

_TEXT = "date_format(start, 'yyyy-MM-dd HH:mm:ss')"


def _places(spark: SparkSession) -> tuple[str, str]:
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts and sums by type, computed as a stream."""
    s = upsert_to_end(tumbling(event_stream(spark, d)), ["start", "event_type"], *_places(spark))
    return s.select(F.expr(_TEXT).alias("day"), "event_type", "n", "cents")


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Counts of two days, every day, computed as a stream."""
    return upsert_to_end(sliding(event_stream(spark, d)), ["start"], *_places(spark)).select(F.expr(_TEXT).alias("day"), "n")


def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Events by type after duplicates within the watermark are dropped, computed as a stream."""
    s = first_seen(event_stream(spark, d)).select("event_id", "event_type")
    out, state = _places(spark)
    return upsert_to_end(s, ["event_id"], out, state).groupBy("event_type").agg(F.count("*").alias("n"))


def batch_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user with a gap of six hours; the same plan runs as a stream."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e).select("user_id", F.expr(_TEXT).alias("start"), "n")


Q = {"stream_tumbling": stream_tumbling, "stream_sliding": stream_sliding, "stream_distinct": stream_distinct, "batch_sessions": batch_sessions}
SQL = {
    "stream_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS day, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1",
    "stream_distinct": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "batch_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""",
}
