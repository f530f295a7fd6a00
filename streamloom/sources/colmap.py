"""COLMAP text export as lines of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Vec, array_matrix, dot, matrix_inverse, matrix_to_quat
from ..operators.streams import place


def camera_line(intrinsics: Column, width: int, height: int, camera_id: int = 1) -> Column:
    return F.format_string(f"{camera_id} PINHOLE {width} {height} %.9f %.9f %.9f %.9f", *(intrinsics[i].cast("double") for i in range(4)))


def image_lines(poses: DataFrame, pose: str = "pose", frame: str = "frame_idx") -> DataFrame:
    """frame, line: image id, world-to-camera quaternion (w first) and translation, camera id, name; the empty second line is in it."""
    m = matrix_inverse(array_matrix(F.col(pose)))
    q = matrix_to_quat([r[:3] for r in m[:3]])
    numbers = F.format_string("%.9f %.9f %.9f %.9f %.9f %.9f %.9f", q.w, q.x, q.y, q.z, m[0][3], m[1][3], m[2][3])
    name = F.format_string("frame_%06d.jpg", F.col(frame))
    return poses.select(frame, F.concat_ws(" ", (F.col(frame) + 1).cast("string"), numbers, F.lit("1"), name).alias("head")).select(frame, F.concat("head", F.lit("\n")).alias("line"))


def point_lines(points: DataFrame, order: list[str]) -> DataFrame:
    """point_id (from 1), line of map points x, y, z, r, g, b (colours 0..1)."""
    n = place(points, order, "point_id").withColumn("point_id", F.col("point_id") + 1)
    eight = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * 255).cast("int")
    return n.select("point_id", F.format_string("%d %.6f %.6f %.6f %d %d %d 0", "point_id", "x", "y", "z", eight("r"), eight("g"), eight("b")).alias("line"))


def depth_points(cells: DataFrame, frames: DataFrame, step: int, subsample: int = 4) -> DataFrame:
    """World points of every step-th frame's reliable cells, each subsample-th in both directions: frame_idx, v, u, x, y, z.

    cells: frame_idx, v, u, depth, reliable; frames: frame_idx, fx, fy, cx, cy and a camera-to-world
    pose of 16 entries.
    """
    picked = cells.where((F.col("frame_idx") % step == 0) & (F.col("v") % subsample == 0) & (F.col("u") % subsample == 0) & F.col("reliable"))
    joined = picked.join(frames, "frame_idx")
    d = F.col("depth")
    p = Vec((F.col("u") - F.col("cx")) / F.col("fx") * d, (F.col("v") - F.col("cy")) / F.col("fy") * d, d)
    m = array_matrix(F.col("pose"))
    out = [dot(tuple(m[i][:3]), p) + m[i][3] for i in range(3)]
    return joined.select("frame_idx", "v", "u", *(c.alias(n) for n, c in zip("xyz", out)))
