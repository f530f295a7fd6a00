"""Event-time windows, deduplication and keyframe selection for Structured Streaming; each also runs on a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str, delay: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of fixed windows; rows later than the delay are dropped when streaming."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    g = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, slide: str, delay: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    return events.groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(events: DataFrame, key: list[str], delay: str = "10 minutes") -> DataFrame:
    """One row of each key; within the watermark when streaming."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def keyframes(frames: DataFrame, threshold: float, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), value: str = "value") -> DataFrame:
    """key, event_id, value of the frames that have moved at least `threshold` from the last keyframe of their stream.

    The state of a stream is the last keyframe's value; frames of a micro-batch are taken in order.
    Works on a streaming DataFrame (append mode) whose files arrive in time order.
    """
    kinds = dict(frames.dtypes)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(list(order))
        last = state.get[0] if state.exists else None
        kept = []
        for row in rows.itertuples(index=False):
            x = getattr(row, value)
            if last is None or abs(x - last) >= threshold:
                last = x
                kept.append((k[0], row.event_id, x))
        state.update((last,))
        yield pd.DataFrame(kept, columns=[key, "event_id", value])

    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, event_id long, {value} double", "last double", "append", GroupStateTimeout.NoTimeout)
