"""Grids, crops and rigs generated beside each row."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_grid(rows: DataFrame, n: int) -> DataFrame:
    """The centres of n x n cells of the unit square, for each row."""
    out = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    v, u = F.floor(F.col("_k") / n).cast("int"), (F.col("_k") % n).cast("int")
    return out.withColumn("v", v).withColumn("u", u).drop("_k").withColumn("x", (F.col("u") + 0.5) / n).withColumn("y", (F.col("v") + 0.5) / n)


def crop_boxes(rows: DataFrame, height: int, width: int, layers: int, overlap: float) -> DataFrame:
    """The image (layer 0) and, in layer k, 2**k x 2**k overlapping crops: x0, y0, x1, y1."""
    boxes = [(0, 0, 0, width, height)]
    for layer in range(1, layers + 1):
        n = 2**layer
        lap = int(overlap * min(height, width) * 2 / n)
        w, h = math.ceil((lap * (n - 1) + width) / n), math.ceil((lap * (n - 1) + height) / n)
        for a in range(n):
            for b in range(n):
                x, y = (w - lap) * a, (h - lap) * b
                boxes.append((layer, x, y, min(x + w, width), min(y + h, height)))
    names = ("layer", "x0", "y0", "x1", "y1")
    each = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, b))) for b in boxes))
    return rows.withColumn("_b", F.explode(each)).select(*rows.columns, "_b.*")


def virtual_rig(rows: DataFrame, n: int, top: bool = True, bottom: bool = True) -> DataFrame:
    """camera, yaw, pitch of n level cameras around, and of one up and one down."""
    cameras = [(2 * math.pi * k / n, 0.0) for k in range(n)] + [(0.0, math.pi / 2)] * top + [(0.0, -math.pi / 2)] * bottom
    each = F.array(*(F.struct(F.lit(k).alias("camera"), F.lit(y).alias("yaw"), F.lit(p).alias("pitch")) for k, (y, p) in enumerate(cameras)))
    return rows.withColumn("_c", F.explode(each)).select(*rows.columns, "_c.*")


def lattice(rows: DataFrame, low: list[float], high: list[float], spacing: float) -> DataFrame:
    """Points every `spacing` from low up to, but not including, high."""
    for name, a, b in zip("xyz", low, high):
        n = max(1, math.ceil((b - a) / spacing - 1e-9))
        rows = rows.withColumn(name, F.explode(F.array(*(F.lit(a + k * spacing) for k in range(n)))))
    return rows
