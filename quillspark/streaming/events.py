"""Event streams: windowed counts with watermarks, dedup, job states. Each transformation runs on a batch table too, and gives the same rows.

These extend what the batch operators do; a stream's state is bounded by its watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    schema = (spark.read.parquet(path) if like is None else like).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks take no other type


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """window_start, event_type, n, total: tumbling, or sliding where slide is given."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, session_start, n: events of a user less than gap apart."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event_id once; on a stream, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def running_states(events: DataFrame) -> DataFrame:
    """user_id, n, last_type so far, per user and batch: a stateful operator."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, "")
        for df in frames:
            df = df.sort_values(["ts", "event_id"])
            n, last = n + len(df), df["event_type"].iloc[-1] if len(df) else last
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_type": [last]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, n long, last_type string", "n long, last_type string", "update", "NoTimeout")


def follow(events: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], every: str | None = None):
    """Starts a query that hands each micro-batch on; it resumes from its checkpoint."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
