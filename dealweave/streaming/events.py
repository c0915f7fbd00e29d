"""Incremental counts over an event stream: tumbling, sliding and session windows, and first-seen events.

Every job reads a stream, keeps its state behind a watermark and writes to files; ``run_to_end`` works off what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 day"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 8) -> DataFrame:
    """Events as a stream with ``ts`` as an event time."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    """``start, event_type, n, cents`` by tumbling window."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", size), "event_type") if events.isStreaming else events.groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    """``start, n`` by sliding window."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    return e.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """``user_id, start, end, n`` of each user's sessions."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame) -> DataFrame:
    """Events with each id once, however often it is sent within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Works off all input that is there, appending to ``out``, and returns what was written.

    The checkpoint makes each batch count once, also after a restart. Windows still open at the end stay in the state
    until later input closes them.
    """
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def upsert_to_end(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Works off all input in complete batches: every batch writes the changed groups, the last batch of a group counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    written = stream.sparkSession.read.parquet(f"{out}/batch=*")
    rest = [c for c in stream.columns if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(*keys, "r.*")
