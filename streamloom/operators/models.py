"""A registry of depth models as DataFrame operators, with analytic stand-ins for networks that are not here."""

from __future__ import annotations

import enum
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DepthType(enum.Enum):
    """What a model's output means, and so how it is brought to metric depth."""

    METRIC_DEPTH = "metric_depth"
    MODEL_METRIC_DEPTH = "model_metric_depth"
    MODEL_METRIC_DISTANCE = "model_metric_distance"
    AFFINE_DISP = "affine_disp"
    AFFINE_DEPTH = "affine_depth"


#: name -> (depth type, camera types, estimate(cells) -> cells with depth and confidence)
_MODELS: dict[str, tuple[DepthType, tuple[str, ...], Callable[..., DataFrame]]] = {}


def register(name: str, kind: DepthType, cameras: tuple[str, ...]):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _MODELS[name] = (kind, cameras, f)
        return f

    return add


def make(name: str, camera_type: str = "PINHOLE") -> tuple[DepthType, Callable[..., DataFrame]]:
    """The model of `family-variant` (the variant is left to the model)."""
    family = name.split("-", 1)[0]
    if family not in _MODELS:
        raise ValueError(f"no depth model {name!r}")
    kind, cameras, f = _MODELS[family]
    if camera_type not in cameras:
        raise ValueError(f"{name} does not take {camera_type}")
    return kind, f


@register("intensity", DepthType.MODEL_METRIC_DEPTH, ("PINHOLE",))
def _intensity(cells: DataFrame) -> DataFrame:
    """A stand-in: depth falls with the cell's value."""
    return cells.withColumn("depth", 1 + 9 / (1 + F.exp(F.col("value")))).withColumn("confidence", F.lit(1.0))


@register("plane", DepthType.METRIC_DEPTH, ("PINHOLE", "MEI"))
def _plane(cells: DataFrame) -> DataFrame:
    """A stand-in: a ground plane that comes nearer down the image."""
    return cells.withColumn("depth", 10 / (1 + F.col("v"))).withColumn("confidence", F.lit(1.0))


@register("disparity", DepthType.AFFINE_DISP, ("PINHOLE",))
def _disparity(cells: DataFrame) -> DataFrame:
    """A stand-in for a video model: inverse depth up to scale and shift."""
    return cells.withColumn("depth", F.abs("value")).withColumn("confidence", F.lit(1.0))


@register("sphere", DepthType.MODEL_METRIC_DISTANCE, ("PANORAMA",))
def _sphere(cells: DataFrame) -> DataFrame:
    return cells.withColumn("depth", F.lit(5.0)).withColumn("confidence", F.lit(1.0))


def metric_scaling(depth: Column, fx: Column, fy: Column, at: float = 300.0) -> Column:
    return depth * (fx + fy) / 2 / at


def depth_to_disparity(d: Column) -> Column:
    return F.when(d > 0, 1 / d).otherwise(0.0)


def sky_to_depth(depth: Column, sky: Column, far: float | Column = 200.0) -> Column:
    return F.when(sky, far if isinstance(far, Column) else F.lit(far)).otherwise(depth)


def alignment_mask(confidence: Column, sky: Column, depth: Column, metric: Column, median_confidence: Column, least: float = 1e-3, least_metric: float = 1e-2) -> Column:
    return (confidence >= median_confidence) & ~sky & (metric > least_metric) & (depth > least)


def complete_depth(cells: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """The coarse stage of depth completion: cells without a prior depth get the model's disparity, fitted to the k nearest known cells.

    cells: key, v, u, prior (null where unknown), pred (relative disparity). The fit is a weighted
    least squares of prior disparity on pred with weights of inverse distance; where it is singular
    the grid's global fit takes its place.
    """
    from .joins import nearest
    from .segments import scale_shift

    numbered = cells.withColumn("_id", F.col("v") * 65536 + F.col("u"))
    known = numbered.where("prior > 0").withColumn("_y", 1 / F.col("prior"))
    near = nearest(numbered.where("prior is null or prior <= 0"), known, key, ["v", "u"], k, "_id", "_id")
    near = near.join(known.select(*key, F.col("_id").alias("row"), F.col("pred").alias("_x"), "_y"), [*key, "row"])
    local = scale_shift(near, [*key, "query"], "_x", "_y", 1 / F.sqrt("dist2")).select(*key, F.col("query").alias("_id"), F.col("scale").alias("_a"), F.col("shift").alias("_b"))
    whole = scale_shift(known.withColumn("_x", F.col("pred")), key, "_x", "_y").select(*key, F.col("scale").alias("_ga"), F.col("shift").alias("_gb"))
    out = numbered.join(local, [*key, "_id"], "left").join(whole, key, "left")
    disp = F.coalesce("_a", "_ga") * F.col("pred") + F.coalesce("_b", "_gb")
    return out.withColumn("depth", F.when(F.col("prior") > 0, F.col("prior")).otherwise(depth_to_disparity(disp))).drop("_id", "_a", "_b", "_ga", "_gb")
