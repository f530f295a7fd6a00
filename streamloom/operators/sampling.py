"""Sparse samples of depth grids by named patterns, and steps on the sphere of directions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Vec, dot, norm, scale, sub

#: Random samples beside the pattern itself.
EXTRA = 2000


def _random(cells: DataFrame, key: list[str], n: int, seed: int, allowed: Column) -> DataFrame:
    """picked: the n allowed cells of each grid with the smallest hashes."""
    w = Window.partitionBy(*key).orderBy(allowed.desc(), F.xxhash64(F.lit(seed), *key, "v", "u"), "v", "u")
    return cells.withColumn("picked", allowed & (F.row_number().over(w) <= n))


def sparse_pattern(cells: DataFrame, key: list[str], pattern: str, height: int, width: int, seed: int = 0, least: int = 5) -> DataFrame:
    """cells (key, v, u, value: depth, null or not above 0 where unknown) with `picked`.

    `N`: N random cells; `downscale_K`: every K-th row and column; `cubic_K`: EXTRA random cells outside
    a K x K hole in the middle; `distance_A_B`: EXTRA random cells with depths from A to B; `LiDAR_N`:
    N evenly spaced rows. Other patterns are an error; so is `least` below 1.
    """
    known = F.coalesce(F.col("value") > 0, F.lit(False))
    if re.fullmatch(r"\d+", pattern):
        return _random(cells, key, int(pattern), seed, known)
    if m := re.fullmatch(r"downscale_(\d+)", pattern):
        k = int(m[1])
        return cells.withColumn("picked", known & (F.col("v") % k == 0) & (F.col("u") % k == 0))
    if m := re.fullmatch(r"cubic_(\d+)", pattern):
        k = int(m[1])
        hole = F.col("v").between((height - k) // 2, (height + k) // 2 - 1) & F.col("u").between((width - k) // 2, (width + k) // 2 - 1)
        return _random(cells, key, EXTRA, seed, known & ~hole)
    if m := re.fullmatch(r"distance_([\d.]+)_([\d.]+)", pattern):
        return _random(cells, key, EXTRA, seed, known & F.col("value").between(float(m[1]), float(m[2])))
    if m := re.fullmatch(r"LiDAR_(\d+)", pattern):
        n = int(m[1])
        lines = sorted({round((k + 0.5) * height / n - 0.5) for k in range(n)})
        return cells.withColumn("picked", known & F.col("v").isin(lines))
    raise NotImplementedError(f"no sampling pattern {pattern!r}")


def too_few(cells: DataFrame, key: list[str], least: int = 5) -> DataFrame:
    """Grids with fewer picked cells than a fit needs."""
    return cells.groupBy(*key).agg(F.count_if("picked").alias("n")).where(F.col("n") < least)


def direction_step(g: Vec, a: Column, b: Column) -> Vec:
    """A unit vector moved along the sphere by (a, b) of its tangent plane.

    The plane's axes are the reflections of x and y by the Householder reflection that takes z to g.
    """
    e = Vec(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    w = sub(Vec(*g), e)
    n2 = dot(w, w)
    flat = n2 < 1e-12
    reflect = lambda p: Vec(*(F.when(flat, x).otherwise(y) for x, y in zip(p, sub(p, scale(w, 2 * dot(w, p) / F.when(flat, 1.0).otherwise(n2))))))
    x, y = reflect(Vec(F.lit(1.0), F.lit(0.0), F.lit(0.0))), reflect(Vec(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    t = Vec(*(a * p + b * q for p, q in zip(x, y)))
    th = norm(t)
    s = F.when(th < 1e-9, 1.0).otherwise(F.sin(th) / F.when(th < 1e-9, 1.0).otherwise(th))
    return Vec(*(F.cos(th) * p + s * q for p, q in zip(g, t)))
