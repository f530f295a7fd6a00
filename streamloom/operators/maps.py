"""Point maps and depth maps between views: projection, merging, reprojection, video depth chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cameras as cam
from ..functions.geometry import SE3, Vec, se3_act, se3_inv, staged


def pose_columns(prefix: str) -> SE3:
    """A pose kept as columns <prefix>tx .. <prefix>qw."""
    from ..functions.geometry import Quat

    c = [F.col(f"{prefix}{n}") for n in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")]
    return SE3(Vec(*c[:3]), Quat(*c[3:]))


def frame_map(points: DataFrame, frames: DataFrame, height: int, width: int, reach: int = 3) -> DataFrame:
    """Depth maps of frames from the map points of the keyframes within `reach` ordinals: frame_idx, v, u, depth.

    points: kf (ordinal), x, y, z; frames: frame_idx, kf (ordinal of its keyframe), fx, fy, cx, cy and
    a camera-to-world pose as columns tx .. qw. A pixel that several points fall on has the nearest.
    The band is an equi-join on exploded ordinals.
    """
    wide = frames.withColumn("_kf", F.explode(F.sequence(F.col("kf") - reach, F.col("kf") + reach)))
    joined = wide.join(points.withColumnRenamed("kf", "_kf"), "_kf")
    joined, p = staged(joined, "_p", tuple(se3_act(se3_inv(pose_columns("")), Vec(F.col("x"), F.col("y"), F.col("z")))))
    u, v = cam.pinhole_project(Vec(*p), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    joined = joined.select("frame_idx", F.floor(u).cast("int").alias("u"), F.floor(v).cast("int").alias("v"), p[2].alias("depth"))
    inside = (F.col("depth") > cam.MIN_DEPTH) & F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1)
    return joined.where(inside).groupBy("frame_idx", "v", "u").agg(F.min("depth").alias("depth"))


def keep_consistent(cells: DataFrame, count: Column, frames: Column, share: float = 0.5) -> DataFrame:
    """Cells seen alike in enough frames (2, or all others where there are fewer), with more than half their frame's mean disparity, not masked."""
    mean = F.avg("disp").over(Window.partitionBy("kf"))
    return cells.withColumn("_mean", mean).where((count >= F.least(F.lit(2), frames - 1)) & (F.col("disp") > share * F.col("_mean")) & ~F.col("masked")).drop("_mean")


def mean_depth_threshold(threshold: float, disp: Column) -> Column:
    """An agreement threshold scaled by a frame's mean inverse depth."""
    return threshold / disp


def equirect_samples(grid: DataFrame, height: int, width: int, fov: float, yaw: Column, pitch: Column) -> DataFrame:
    """su, sv (0..1 on the panorama) of a virtual camera's pixels (v, u)."""
    from ..functions.geometry import rotate, yaw_pitch_quat

    f = width / 2 / F.tan(F.lit(fov) / 2)
    ray = Vec((F.col("u") + 0.5 - width / 2) / f, (F.col("v") + 0.5 - height / 2) / f, F.lit(1.0))
    grid, p = staged(grid, "_r", tuple(rotate(yaw_pitch_quat(yaw, pitch), ray)))
    su, sv = cam.panorama_project(Vec(*p))
    return grid.withColumn("su", su).withColumn("sv", sv).drop("_r0", "_r1", "_r2")


def sample_nearest(grid: DataFrame, image: DataFrame, on: list[str], height: int, width: int, value: str) -> DataFrame:
    """The value of the image's cell that (su, sv) falls in: an equi-join."""
    g = grid.withColumn("_v", F.least(F.floor(F.col("sv") * height), F.lit(height - 1)).cast("int")).withColumn("_u", F.least(F.floor(F.col("su") * width), F.lit(width - 1)).cast("int"))
    i = image.select(*on, F.col("v").alias("_v"), F.col("u").alias("_u"), F.col(value).alias(f"sampled_{value}"))
    return g.join(i, [*on, "_v", "_u"], "left").drop("_v", "_u")


def carried_scales(ratios: DataFrame, key: list[str], order: str, total: Column, least: float = 0.05) -> DataFrame:
    """Of each frame the lower median of its ratios; frames with no or too few keep the last one's (1 at the start).

    ratios: key, order, ratio (null: no valid pixel); total: the frame's number of pixels, an aggregate.
    """
    from .windows import carry_forward

    per = ratios.groupBy(*key, order).agg(F.expr("percentile_disc(0.5) within group (order by ratio)").alias("_m"), F.count("ratio").alias("_n"), total.alias("_t"))
    own = F.when((F.col("_n") > 0) & (F.col("_n") >= least * F.col("_t")), F.col("_m"))
    return carry_forward(per, key, [order], own, 1.0, "scale").select(*key, order, "scale")


def reprojected(pixels: DataFrame, height: int, width: int, key: list[str]) -> DataFrame:
    """Forward warp of frame 1's values into frame 2, near depths weighing more; key, v, u, value, weight.

    pixels: key, v, u, value, depth, fx .. cy of both frames (fx1 .. cy2) and the relative pose as
    columns rtx .. rqw (frame 1 to frame 2). Points behind frame 2 are dropped.
    """
    from .grids import splat

    d = F.col("depth")
    ray = cam.pinhole_unproject(F.col("u") + 0.5, F.col("v") + 0.5, F.col("fx1"), F.col("fy1"), F.col("cx1"), F.col("cy1"))
    pixels, p = staged(pixels, "_p", tuple(se3_act(pose_columns("r"), Vec(ray.x * d, ray.y * d, d))))
    u, v = cam.pinhole_project(Vec(*p), F.col("fx2"), F.col("fy2"), F.col("cx2"), F.col("cy2"), limit_min_depth=False)
    front = pixels.where(p[2] > 0).withColumn("_x", u).withColumn("_y", v)
    top = front.groupBy(*key).agg(F.max(F.log1p(p[2])).alias("_top"))
    front = front.join(top, key)
    return splat(front, key, "_x", "_y", "value", height, width, 1 / F.exp(50 * F.log1p(p[2]) / F.col("_top")))


def chained_windows(frames: DataFrame, key: list[str], window: str, place: str, value: str, overlap: int) -> DataFrame:
    """A video model's windows brought to the first one's scale: key, window, scale, shift to apply.

    Each window is fitted to the one before it on the frames they share (value there after its own
    fit), so fits compose along the chain: a window function over per-window fits, not a driver loop.
    frames: key, window (from 0), place (frame number), value; shared frames appear in both windows.
    """
    from .segments import scale_shift

    a = frames.select(*key, F.col(window).alias("_w"), place, F.col(value).alias("_x"))
    b = frames.select(*key, (F.col(window) + 1).alias("_w"), place, F.col(value).alias("_y"))
    fits = scale_shift(a.join(b, [*key, "_w", place]), [*key, "_w"], "_x", "_y")
    every = frames.select(*key, F.col(window).alias("_w")).distinct().join(fits, [*key, "_w"], "left")
    every = every.select(*key, "_w", F.coalesce("scale", F.lit(1.0)).alias("_s"), F.coalesce("shift", F.lit(0.0)).alias("_t"))
    # y = s_1 (s_2 (... s_n x + t_n ...) + t_2) + t_1: a window's scale is the product of those up to it, its
    # shift the sum of each t_k times the product before it. A product is the sum of logarithms, with its sign.
    w = Window.partitionBy(*key).orderBy("_w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.exp(F.sum(F.log(F.abs(F.when(F.col("_s") != 0, F.col("_s"))))).over(w))
    sign = 1 - 2 * (F.count_if(F.col("_s") < 0).over(w) % 2)
    chain = every.withColumn("_p", F.when(F.count_if(F.col("_s") == 0).over(w) > 0, 0.0).otherwise(size * sign))
    before = F.coalesce(F.lag("_p").over(Window.partitionBy(*key).orderBy("_w")), F.lit(1.0))
    chain = chain.withColumn("_b", before * F.col("_t"))
    return chain.select(*key, F.col("_w").alias(window), F.col("_p").alias("scale"), F.sum("_b").over(w).alias("shift"))


def correlation_lookup(volume: DataFrame, coords: DataFrame, edge: list[str], radius: int, height: int, width: int) -> DataFrame:
    """Bilinear samples of each source cell's correlation map around a moving point: edge, v, u, dy, dx, value.

    volume: edge, v, u (source cell), tv, tu (target cell), value; coords: edge, v, u, x, y.
    Targets outside the map count as 0.
    """
    window = F.sequence(F.lit(-radius), F.lit(radius))
    c = coords.withColumn("dy", F.explode(window)).withColumn("dx", F.explode(window))
    x, y = F.col("x") + F.col("dx"), F.col("y") + F.col("dy")
    fx, fy = x - F.floor(x), y - F.floor(y)
    corner = lambda a, b, k: F.struct((F.floor(x) + a).cast("int").alias("tu"), (F.floor(y) + b).cast("int").alias("tv"), k.alias("k"))
    c = c.withColumn("c", F.explode(F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))))
    c = c.select(*edge, "v", "u", "dy", "dx", F.col("c.tu").alias("tu"), F.col("c.tv").alias("tv"), F.col("c.k").alias("k"))
    hit = c.join(volume, [*edge, "v", "u", "tv", "tu"], "left")
    return hit.groupBy(*edge, "v", "u", "dy", "dx").agg(F.sum(F.coalesce(F.col("value") * F.col("k"), F.lit(0.0))).alias("value"))


def correlation_pyramid(volume: DataFrame, edge: list[str], level: int) -> DataFrame:
    """The volume's targets averaged over blocks of 2**level."""
    f = 2**level
    return volume.groupBy(*edge, "v", "u", F.floor(F.col("tv") / f).cast("int").alias("tv"), F.floor(F.col("tu") / f).cast("int").alias("tu")).agg(F.avg("value").alias("value"))


def cross_views(distances: DataFrame, limit: float = 400.0) -> DataFrame:
    """Of each (i, view) the frame and view at the least distance, if below the limit: i, view, other_i, other."""
    best = distances.groupBy("i", "view").agg(F.min_by(F.struct("other_i", "other", "d"), F.struct("d", "other_i", "other")).alias("b"))
    return best.where(F.col("b.d") < limit).select("i", "view", "b.other_i", "b.other")


def painted(points: DataFrame, key: list[str], order: str, colour: str, radius: int, height: int, width: int) -> DataFrame:
    """A canvas of square marks; later points lie on top."""
    r = F.sequence(F.lit(-radius), F.lit(radius))
    p = points.withColumn("_a", F.explode(r)).withColumn("_b", F.explode(r)).select(*key, (F.col("v") + F.col("_a")).alias("v"), (F.col("u") + F.col("_b")).alias("u"), order, colour)
    p = p.where(F.col("v").between(0, height - 1) & F.col("u").between(0, width - 1))
    return p.groupBy(*key, "v", "u").agg(F.max_by(colour, order).alias(colour))
