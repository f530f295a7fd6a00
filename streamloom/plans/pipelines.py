"""End-to-end pipelines over frame tables, assembled from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import cameras as cam
from ..operators import generators, grids, maps, models, streams, windows

#: name -> pipeline(cells, config)
PIPELINES: dict = {}


def pipeline(name: str):
    def add(f):
        PIPELINES[name] = f
        return f

    return add


def make(config: Config):
    return PIPELINES[config.pipeline]


def estimated_intrinsics(frames: DataFrame, fov: float, height: int, width: int, fps: float, gap_seconds: float = 1.0) -> DataFrame:
    """stream_id, intrinsics from a few frames' vertical fields of view (0, g and 2 g): their mean focal, the centre as principal point."""
    last = frames.groupBy("stream_id").agg((F.max("frame_idx") + 1).alias("n"))
    g = F.least(F.lit(int(gap_seconds * fps)), F.floor((F.col("n") - 1) / 2))
    picked = frames.join(last, "stream_id").where(F.col("frame_idx").isin(0) | (F.col("frame_idx") == g) | (F.col("frame_idx") == 2 * g))
    f = F.avg(cam.fov_to_focal(F.coalesce(F.col("fov"), F.lit(fov)) if "fov" in frames.columns else F.lit(fov), float(height)))
    return picked.groupBy("stream_id").agg(f.alias("f")).select("stream_id", F.array("f", "f", F.lit(width / 2), F.lit(height / 2)).alias("intrinsics"))


@pipeline("default")
def annotate(cells: DataFrame, config: Config, height: int, width: int) -> DataFrame:
    """cells (stream_id, frame_idx, v, u, value) -> the same with depth, reliable and keyframe.

    Seeks and strides, estimates depth by the configured model, marks reliable pixels, and marks as
    keyframes the frames whose mean value has moved enough.
    """
    streams.require_absent(cells, ["pose", "intrinsics", "metric_depth", "instance"])
    s = config.streams
    cells = streams.seek(cells.withColumnRenamed("frame_idx", "raw_frame_idx"), s.frame_start, s.frame_end, s.frame_skip)
    kind, estimate = models.make(config.depth_model, config.camera_type)
    depth = estimate(cells)
    if kind is models.DepthType.AFFINE_DISP:
        depth = depth.withColumn("depth", models.depth_to_disparity(F.col("depth")))
    key = ["stream_id", "frame_idx"]
    reliable = grids.reliable_depth(depth.select(*key, "v", "u", F.col("depth").alias("value")), key, height, width)
    mean = cells.groupBy(*key).agg(F.avg("value").alias("value"))
    kept = windows.keep_moved(mean, ["stream_id"], ["frame_idx"], "value", config.track.keyframe_threshold)
    out = depth.join(reliable.select(*key, "v", "u", "reliable"), [*key, "v", "u"])
    return out.join(kept.select(*key, "keyframe"), key)


@pipeline("panorama")
def panorama(cells: DataFrame, config: Config, height: int, width: int, view: int = 8) -> DataFrame:
    """cells of panoramas -> (stream_id, frame_idx, camera, v, u, sampled_value) of the virtual cameras of the configuration."""
    frames = cells.select("stream_id", "frame_idx").distinct()
    rig = generators.virtual_rig(frames, config.cameras.count, config.cameras.top, config.cameras.bottom)
    grid = rig.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(view - 1)))).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(view - 1))))
    placed = maps.equirect_samples(grid, view, view, config.cameras.fovx * cam.PI / 180, F.col("yaw"), F.col("pitch"))
    got = maps.sample_nearest(placed, cells, ["stream_id", "frame_idx"], height, width, "value")
    return got.select("stream_id", "frame_idx", "camera", "v", "u", "sampled_value")


def info(cells: DataFrame, residual: DataFrame | None = None) -> DataFrame:
    """stream_id, frames, keyframes and the mean residual (null where none is given)."""
    per = cells.groupBy("stream_id").agg(F.countDistinct("frame_idx").alias("frames"), F.countDistinct(F.when(F.col("keyframe"), F.col("frame_idx"))).alias("keyframes"))
    return per.withColumn("residual", F.lit(None).cast("double")) if residual is None else per.join(residual, "stream_id", "left")


def save(cells: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Write annotated cells as Parquet by stream; with a table of done streams only the others."""
    if done is not None:
        cells = streams.skip_existing(cells, done, "stream_id")
    cells.repartition("stream_id").write.mode("append").partitionBy("stream_id").parquet(path)


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
