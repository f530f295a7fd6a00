"""Preparing images for models, painting grids, and targets that tracks give: rows (image, v, u, value) or Columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import SE3, se3_inv, se3_to_matrix
from .grids import splat

# Mean and deviation of the red, green and blue channel that networks for photographs expect.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
# Seed of the colours of instances, and their least brightness.
PALETTE_SEED, PALETTE_LEAST = 200, 0.3
#: The phrase of instances that are sky.
SKY = "sky"


# -- sizes -------------------------------------------------------------------------------------


def fit_margins(height: Column, width: Column, multiple: int, mode: str = "center", crop: bool = False) -> tuple[Column, Column, Column, Column]:
    """(left, right, top, bottom) to add so that both sides are multiples; negative where they are cut instead."""
    if mode not in ("center", "left"):
        raise ValueError(mode)

    def split(n: Column) -> tuple[Column, Column]:
        add = -(n % multiple) if crop else (F.lit(multiple) - n % multiple) % multiple
        first = F.floor(add / 2) if mode == "center" else F.lit(0).cast("long")
        return first, add - first

    return (*split(width), *split(height))


def calibration_size(height: Column, width: Column, resize: int = 320, side: str = "short") -> tuple[Column, Column]:
    """(height, width) with the named side at `resize` and the other in proportion, rounded down."""
    aspect = width / height
    if side not in ("short", "long", "vert", "horz"):
        raise ValueError(side)
    upright = {"vert": F.lit(True), "horz": F.lit(False), "short": aspect >= 1.0, "long": aspect < 1.0}[side]
    return F.when(upright, F.lit(resize)).otherwise((resize / aspect).cast("int")), F.when(upright, (resize * aspect).cast("int")).otherwise(F.lit(resize))


def process_size(height: Column, width: Column, intrinsics: tuple[Column, ...], resolution: int = 504, method: str = "upper_bound_resize", patch: int = 14) -> tuple[Column, Column, tuple[Column, ...]]:
    """(height, width, (fx, fy, cx, cy)) of an image brought to a resolution and to multiples of the patch.

    `upper_bound` scales the longer side, `lower_bound` the shorter one; `resize` then goes to the nearest
    multiples (the upper of two), `crop` cuts down to them around the middle.
    """
    bound, _, fit = method.rpartition("_")
    if bound not in ("upper_bound", "lower_bound") or fit not in ("resize", "crop"):
        raise ValueError(method)
    k = resolution / (F.greatest(height, width) if bound == "upper_bound" else F.least(height, width)).cast("double")
    first = [F.greatest(F.bround(n * k), F.lit(1.0)) for n in (height, width)]
    down = [F.floor(n / patch) * patch for n in first]
    fx, fy, cx, cy = intrinsics
    if fit == "resize":
        h, w = (F.greatest(F.when(d + patch - n <= n - d, d + patch).otherwise(d), F.lit(1)) for n, d in zip(first, down))
        return h, w, (fx * w / width, fy * h / height, cx * w / width, cy * h / height)
    h, w = down
    ry, rx = first[0] / height, first[1] / width
    return h, w, (fx * rx, fy * ry, cx * rx - F.floor((first[1] - w) / 2), cy * ry - F.floor((first[0] - h) / 2))


def common_crop(images: DataFrame, batch: list[str]) -> DataFrame:
    """Images (height, width, cx, cy) of a batch cut around their middle to its least height and width."""
    least = images.groupBy(*batch).agg(F.min("height").alias("_h"), F.min("width").alias("_w"))
    out = images.join(least, batch).withColumn("cx", F.col("cx") - F.floor((F.col("width") - F.col("_w")) / 2)).withColumn("cy", F.col("cy") - F.floor((F.col("height") - F.col("_h")) / 2))
    return out.withColumn("height", F.col("_h")).withColumn("width", F.col("_w")).drop("_h", "_w")


def normalised(value: Column, channel: int) -> Column:
    """A byte of a channel (0 red, 1 green, 2 blue) as networks take it."""
    return (value / 255.0 - CHANNEL_MEAN[channel]) / CHANNEL_STD[channel]


def model_input(rgb: tuple[Column, Column, Column], pose: SE3, intrinsics: tuple[Column, ...]) -> Column:
    """Struct of a pinhole frame: colours (0 to 1) as bytes, the world-to-camera matrix, and the camera matrix."""
    fx, fy, cx, cy = intrinsics
    o, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(*(F.array(*row) for row in se3_to_matrix(se3_inv(pose))))
    return F.struct(F.array(*(F.floor(c * 255).cast("int") for c in rgb)).alias("rgb"), matrix.alias("w2c"), F.array(F.array(fx, o, cx), F.array(o, fy, cy), F.array(o, o, one)).alias("k"))


# -- resampling --------------------------------------------------------------------------------


def _antialiased(n: int, m: int) -> list[tuple[int, int, float]]:
    """(target, source, weight) of one axis: triangles as wide as a target cell, or a source cell when enlarging."""
    step = n / m
    reach = max(step, 1.0)
    source = np.arange(n) + 0.5
    taps = []
    for i in range(m):
        k = np.maximum(0.0, 1 - np.abs(source - step * (i + 0.5)) / reach)
        taps += [(i, int(j), float(k[j] / k.sum())) for j in np.flatnonzero(k)]
    return taps


def resize_antialiased(cells: DataFrame, key: list[str], h: int, w: int, height: int, width: int) -> DataFrame:
    """Bilinear resampling of an h x w grid with a filter as wide as the target's cells: key, v, u, value.

    One axis after the other, by tables of a few source cells for each target cell: their size is the call's.
    """
    if (h, w) == (height, width):
        return cells.select(*key, "v", "u", "value")
    out = cells
    for axis, other, n, m in (("v", "u", h, height), ("u", "v", w, width)):
        taps = cells.sparkSession.createDataFrame(_antialiased(n, m), f"_t int, {axis} int, _k double")
        out = out.join(F.broadcast(taps), axis).groupBy(*key, F.col("_t").alias(axis), other).agg(F.sum(F.col("value") * F.col("_k")).alias("value"))
    return out.select(*key, "v", "u", "value")


def quantile_sample(rows: DataFrame, key: list[str], order: Column, most: int = 100_000) -> DataFrame:
    """At most `most` rows of each group, those of the smallest `order` (a hash of a unique column): a sample is the feature."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


# -- colours and marks -------------------------------------------------------------------------


def jet(level: Column) -> Column:
    """[red, green, blue] of a level 0 to 255 on the scale from dark blue over cyan and yellow to dark red."""
    ramp = lambda middle: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(382.5 - F.abs(4.0 * level - middle)).cast("int")))
    return F.array(ramp(765), ramp(510), ramp(255))


def depth_level(depth: Column, clip: tuple[float, float] | None = (0.001, 10000.0), span: tuple[Column, Column] | None = None) -> Column:
    """A depth as a byte: clipped, brought to 0..1 by (least, greatest) where given, times 255, modulo 256."""
    d = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), depth)) if clip else depth
    if span:
        d = (d - span[0]) / (span[1] - span[0])
    return F.pmod(F.floor(d * 255), F.lit(256)).cast("int")


def palette(n: int = 256) -> list[list[int]]:
    """Colours of instances 0..n - 1: black, then seeded random bright ones."""
    draws = np.random.RandomState(PALETTE_SEED).random_sample((n - 1, 3))
    return [[0, 0, 0], *((PALETTE_LEAST + (1 - PALETTE_LEAST) * draws) * 255).astype(int).tolist()]


def instance_colour(instance: Column, colours: list[list[int]] | None = None) -> Column:
    table = F.array(*(F.array(*map(F.lit, c)) for c in colours or palette()))
    return F.element_at(table, (instance + 1).cast("int"))


def sky(instance: Column, phrases: Column) -> Column:
    """Whether a cell's instance has the phrase of the sky; phrases: a map from instance to phrase."""
    ids = F.map_keys(F.map_filter(phrases, lambda _, p: p == SKY))
    return F.coalesce(F.array_contains(ids, instance), F.lit(False))


def painted_masks(masks: DataFrame, key: list[str], box: list[Column], area: float, start: int = 1, share: float = 1.0) -> DataFrame:
    """key, v, u, object: masks (key, seq, v, u) painted in order, later ones on top, numbered from `start`.

    Masks whose box is above `share` of the image's area are left out and take no number.
    """
    wide = (box[2] - box[0]) * (box[3] - box[1]) > share * area
    kept = masks.where(~wide)
    w = Window.partitionBy(*key).orderBy("seq")
    numbers = kept.select(*key, "seq").distinct().withColumn("object", F.row_number().over(w) + start - 1)
    top = kept.groupBy(*key, "v", "u").agg(F.max("seq").alias("seq"))
    return top.join(numbers, [*key, "seq"]).select(*key, "v", "u", "object")


def lines_raster(segments: DataFrame, key: list[str], order: str, height: int, width: int) -> DataFrame:
    """key, v, u, order: cells of straight segments (x0, y0, x1, y1, whole cells), the last segment on top.

    A segment has a cell for each step of its longer side, the nearest ones, half cells away from zero.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.abs(dx), F.abs(dy))
    s = segments.withColumn("_n", n).withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long"))))
    at = lambda a, d: (F.col(a) + F.when(F.col("_n") > 0, F.round(F.col("_t") * d / F.col("_n"))).otherwise(0.0)).cast("int")
    cells = s.select(*key, order, at("y0", dy).alias("v"), at("x0", dx).alias("u"))
    return cells.where(F.col("v").between(0, height - 1) & F.col("u").between(0, width - 1)).groupBy(*key, "v", "u").agg(F.max(order).alias(order))


# -- targets of tracks, priors -----------------------------------------------------------------


def track_targets(edges: DataFrame, tracks: DataFrame, image: tuple[int, int], grid: tuple[int, int], least: float = 0.1) -> DataFrame:
    """Of each edge (edge, view_idx, i, j) and grid cell with weight: where the tracks say that it goes (x, y), and the weight.

    tracks: view_idx, frame_idx, kp_id, u, v in image pixels (height, width in `image`). Cells below the
    least weight get weight 0 and stay in place, and those without any are absent.
    """
    kx, ky = grid[1] / image[1], grid[0] / image[0]
    at = lambda frame, end: tracks.select("view_idx", F.col("frame_idx").alias(frame), "kp_id", (F.col("u") * kx).alias(f"_u{end}"), (F.col("v") * ky).alias(f"_v{end}"))
    moved = edges.join(at("i", 0), ["view_idx", "i"]).join(at("j", 1), ["view_idx", "j", "kp_id"])
    moved = moved.withColumn("_dx", F.col("_u1") - F.col("_u0")).withColumn("_dy", F.col("_v1") - F.col("_v0"))
    x = splat(moved, ["edge"], "_u0", "_v0", "_dx", *grid).withColumnRenamed("value", "x")
    y = splat(moved, ["edge"], "_u0", "_v0", "_dy", *grid).select("edge", "v", "u", F.col("value").alias("y"))
    out = x.join(y, ["edge", "v", "u"])
    enough = F.col("weight") >= least
    return out.select("edge", "v", "u", (F.col("u") + F.when(enough, F.col("x")).otherwise(0.0)).alias("x"), (F.col("v") + F.when(enough, F.col("y")).otherwise(0.0)).alias("y"), F.when(enough, F.col("weight")).otherwise(0.0).alias("weight"))


def rescaled_prior(disparity: Column, focal_before: Column, focal: Column) -> Column:
    """A metric model's disparity after the focal length has changed."""
    return disparity * focal_before / focal


def prior_disparity(cells: DataFrame, stride: int = 8) -> DataFrame:
    """Disparities (0 and below stay) of a depth grid's cells in the middle of each stride x stride block."""
    middle = (stride - 1) // 2
    picked = cells.where((F.col("v") % stride == middle) & (F.col("u") % stride == middle))
    place = lambda c: F.floor(F.col(c) / stride).cast("int")
    return picked.withColumns({"v": place("v"), "u": place("u"), "value": F.when(F.col("value") > 0, 1 / F.col("value")).otherwise(F.col("value"))})
