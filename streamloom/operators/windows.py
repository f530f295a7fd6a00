"""Ordered folds and windows over frames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exclusive_prefix(rows: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def carry_forward(rows: DataFrame, key: list[str], order: list[str], value: Column, initial: float, name: str) -> DataFrame:
    """The last non-null value up to each row; `initial` before the first."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(initial)))


def ema(rows: DataFrame, key: list[str], order: list[str], value: str, momentum: float = 0.99) -> DataFrame:
    """key, n, ema: the exponential average of each group's values in order, seeded with the first; nulls keep the last.

    In closed form: the value that r non-null ones follow weighs (1 - momentum) * momentum**r, the first one
    what is left. One shuffle and a window that spills, whatever a group's length.
    """
    x = F.col(value).cast("double")
    after = Window.partitionBy(*key).orderBy(*(F.col(o).desc() for o in order)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.select(*key, x.alias("_x"), F.count(x).over(after).alias("_r"))
    r = F.when(F.col("_x").isNotNull(), F.col("_r"))
    total = (1 - momentum) * F.sum(F.col("_x") * F.pow(F.lit(momentum), r)) + F.max_by("_x", r) * F.pow(F.lit(momentum), F.max(r) + 1)
    return ranked.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n"), total.alias("ema"))


def overlap_blend(rows: DataFrame, key: list[str], place: str, value: Column, size: int = 10, overlap: int = 3) -> DataFrame:
    """Windows of `size` frames every `size - overlap`: where two overlap, they are cross-faded with weights (k + 1) / (overlap + 1).

    value: the estimate of a frame in a window, an expression that may use `window_no`; it should be
    what the window's own computation gives. Each frame is in at most two windows.
    """
    hop = size - overlap
    p = F.col(place)
    own = F.floor(p / hop)
    spread = rows.withColumn("window_no", F.explode(F.when((own > 0) & (p % hop < overlap), F.array(own - 1, own)).otherwise(F.array(own))))
    k = (p % hop) + 1
    fading = (own > 0) & (p % hop < overlap)
    weight = F.when(~fading, 1.0).when(F.col("window_no") == own, k / (overlap + 1.0)).otherwise(1 - k / (overlap + 1.0))
    return spread.groupBy(*key, place).agg(F.sum(value * weight).alias("blended"), F.count(F.lit(1)).alias("n_windows"))


def extrapolated(rows: DataFrame, key: list[str], order: list[str], value: str, name: str, factor: float = 0.5) -> DataFrame:
    """x1 + factor * (x1 - x2) of the two rows before."""
    w = Window.partitionBy(*key).orderBy(*order)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return rows.withColumn(name, one + factor * (one - two))


def trajectory_length(rows: DataFrame, key: list[str], order: list[str], xyz: list[str], name: str = "length") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    step = None
    for c in xyz:
        d = F.col(c) - F.lag(c).over(w)
        step = d * d if step is None else step + d * d
    total = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_step", F.coalesce(F.sqrt(step), F.lit(0.0))).withColumn(name, F.sum("_step").over(total)).drop("_step")


def track_segments(tracks: DataFrame, key: list[str], order: str, valid: str) -> DataFrame:
    """Pairs of consecutive rows that are both valid."""
    w = Window.partitionBy(*key).orderBy(order)
    return tracks.withColumn("_next", F.lead(valid).over(w)).withColumn("next_at", F.lead(order).over(w)).where(F.col(valid) & F.col("_next")).drop("_next")


def islands(rows: DataFrame, key: list[str], order: list[str], on: Column) -> DataFrame:
    """Runs of consecutive rows with equal `on`: run number from 0, value, first place, length."""
    w = Window.partitionBy(*key).orderBy(*order)
    x = rows.withColumn("_on", on).withColumn("_at", F.row_number().over(w) - 1)
    x = x.withColumn("_turn", (F.coalesce(F.lag("_on").over(w) != F.col("_on"), F.lit(False))).cast("int"))
    x = x.withColumn("run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.groupBy(*key, "run").agg(F.first("_on").alias("value"), F.min("_at").alias("first"), F.count(F.lit(1)).alias("length"))


def keep_moved(rows: DataFrame, key: list[str], order: list[str], value: str, threshold: float) -> DataFrame:
    """Keyframes: the first row of each stream, and each whose value is at least `threshold` from the last keyframe's.

    Whether a row is kept depends on the last one kept, so sorted partitions are folded batch by batch: a task
    holds one batch and the last keyframe, whatever a stream's length. The first row of a stream is kept even
    where its value is null, and so is every row up to its first value; later nulls are not.
    """
    n = len(key)
    kept = rows.select(*key, *order, F.col(value).cast("double").alias(value))
    schema = T.StructType([*kept.schema.fields, T.StructField("keyframe", T.BooleanType(), False)])

    def fold(batches):
        stream = last = None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n)))) if n else [()] * batch.num_rows
            marks = []
            for k, x in zip(keys, batch.column(batch.num_columns - 1).to_pylist()):
                if k != stream:
                    stream, last = k, None
                keep = last is None or (x is not None and abs(x - last) >= threshold)
                last = x if keep else last
                marks.append(keep)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.bool_())], names=schema.names)

    return kept.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(fold, schema)


def neighbours_agree(rows: DataFrame, key: list[str], place: str, value: str, radius: int, tolerance: float) -> DataFrame:
    """count: how many of the rows within `radius` places of the same key agree with a row within the tolerance."""
    offsets = [d for d in range(-radius, radius + 1) if d]
    seen = rows.select(*key, F.explode(F.array(*map(F.lit, offsets))).alias("_d"), F.col(place).alias("_p"), F.col(value).alias("_x"))
    seen = seen.withColumn(place, F.col("_p") + F.col("_d")).select(*key, place, "_x")
    joined = rows.join(seen, [*key, place], "left")
    return joined.groupBy(*key, place).agg(F.count_if(F.abs(F.col("_x") - F.col(value)) < tolerance).alias("count"))
