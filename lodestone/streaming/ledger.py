"""Job ledgers as streams: status counts by window, and each job's latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_a_batch: int = 16) -> DataFrame:
    """Append-only event files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, events): counts by window; state is dropped once the watermark has passed a window."""
    w = events.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("events"))
    return w.select(F.col("window.start").alias("start"), kind, "events")


def latest_states(events: DataFrame, job: str, seq: str, kind: str) -> DataFrame:
    """(job, seq, kind): the last event of each job so far; one row of state a job (update mode)."""
    return events.groupBy(job).agg(F.max(seq).alias(seq), F.max_by(kind, F.col(seq)).alias(kind))
