"""Frame streams: rows keyed by (stream, frame number), and operators over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import settled

#: Annotations that a stream may carry.
ATTRIBUTES = ("pose", "intrinsics", "camera_type", "instance", "mask", "metric_depth")


def seek(frames: DataFrame, start: int = 0, end: int = -1, step: int = 1, stream: str = "stream_id", raw: str = "raw_frame_idx") -> DataFrame:
    """Every step-th frame from start to end (-1: all), with frame_idx, the place among those.

    frame_idx is arithmetic on the place in the file, so nothing is shuffled; it needs raw places
    without gaps.
    """
    if start < 0 or end < -1 or step < 1:
        raise ValueError("start from 0, end from -1, step from 1")
    r = F.col(raw)
    inside = (r >= start) & ((r - start) % step == 0)
    if end >= 0:
        inside = inside & (r < end)
    return frames.where(inside).withColumn("frame_idx", F.floor((r - start) / step).cast("long"))


def number(rows: DataFrame, stream: list[str], order: list[str], name: str = "raw_frame_idx") -> DataFrame:
    """Places from 0 within each stream by a total order."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*stream).orderBy(*order)) - 1).cast("long"))


def place(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows numbered from 0 by a total order, without bringing them into one task.

    Rows are dealt out by ranges of the order and numbered within; what precedes a range is added from
    a table of one row for each range.
    """
    part, = (c for c in ("_range",) if c not in rows.columns)
    dealt = settled(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return dealt.withColumn("_inner", inner).join(F.broadcast(before), part).withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).drop(part, "_inner", "_before")


def seek_length(n_frames: Column, start: int, end: int, step: int) -> Column:
    stop = F.least(n_frames, F.lit(end)) if end >= 0 else n_frames
    return F.greatest(F.ceil((stop - start) / F.lit(step)), F.lit(0)).cast("long")


def stream_meta(frames: DataFrame, fps: float, stream: str = "stream_id", step: int = 1) -> DataFrame:
    """n_frames, fps and which attributes any frame has, one row for each stream."""
    has = [F.max(F.col(a).isNotNull()).alias(f"has_{a}") for a in ATTRIBUTES if a in frames.columns]
    return frames.groupBy(stream).agg(F.count(F.lit(1)).alias("n_frames"), *has).withColumn("fps", F.lit(fps / step))


def attributes(frames: DataFrame) -> Column:
    """Names of the attributes that a row has."""
    return F.array_compact(F.array(*(F.when(F.col(a).isNotNull(), F.lit(a)) for a in ATTRIBUTES if a in frames.columns)))


def assign_attributes(frames: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Per-frame values joined by place; frames without a value keep a null."""
    return frames.join(values, on, "left")


def multiview_zip(views: DataFrame, view: str, stream: str, frame: str, columns: list[str], n_views: int) -> DataFrame:
    """One row for each frame that all views have, with each column by view: <column>_<view number>."""
    picks = [F.max(F.when(F.col(view) == k, F.col(c))).alias(f"{c}_{k}") for k in range(n_views) for c in columns]
    return views.groupBy(stream, frame).agg(*picks, F.countDistinct(view).alias("_views")).where(F.col("_views") == n_views).drop("_views")


def unequal_views(views: DataFrame, view: str, stream: str) -> DataFrame:
    """Streams whose views have different lengths: the pre-check of a zip."""
    n = views.groupBy(stream, view).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(stream).agg(F.min("n").alias("shortest"), F.max("n").alias("longest")).where("shortest != longest")


def two_pass(rows: DataFrame, key: list[str], first: list[Column], second: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A processor of two passes: aggregates of each stream, then a projection that sees them."""
    return second(rows.join(rows.groupBy(*key).agg(*first), key))


def process(frames: DataFrame, *processors: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for p in processors:
        frames = frames.transform(p)
    return frames


def cached(frames: DataFrame, eager: bool = False) -> DataFrame:
    frames = frames.persist(StorageLevel.MEMORY_AND_DISK)
    if eager:
        frames.count()
    return frames


def skip_existing(todo: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(on).distinct(), on, "left_anti")


def last_wins(rows: DataFrame, key: list[str], item: str, value: str, order: list[str]) -> DataFrame:
    """Of each item the value of its last row: what merging maps from first to last leaves."""
    at = F.struct(*order)
    return rows.groupBy(*key, item).agg(F.max_by(value, at).alias(value))


def require_absent(frames: DataFrame, names: list[str]) -> DataFrame:
    """The frames, if they carry none of the attributes yet."""
    clash = sorted(set(names) & set(frames.columns))
    if clash:
        raise ValueError(f"the stream already has {clash}")
    return frames


def remove_and_renumber(rows: DataFrame, column: str, ix: int) -> DataFrame:
    """Without row ix, those after it one place earlier."""
    return rows.where(F.col(column) != ix).withColumn(column, F.when(F.col(column) > ix, F.col(column) - 1).otherwise(F.col(column)))


def batches(rows: DataFrame, place: str, size: int, name: str = "batch") -> DataFrame:
    return rows.withColumn(name, F.floor(F.col(place) / size).cast("long"))
