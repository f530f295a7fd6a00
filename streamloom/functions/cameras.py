"""Camera models as Column expressions: projection, its inverse, and changes of intrinsics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import SE3, Vec, dot, norm, scale, se3_act_homogeneous, se3_inv, se3_mul

#: Depths below this are projected as if they were 1.
MIN_DEPTH = 0.1
PI = math.pi

#: Camera types with their numbers of intrinsics.
INTRINSICS = {"PINHOLE": 4, "MEI": 5, "PANORAMA": 4}


def intrinsics_dim(camera_type: str) -> int:
    if camera_type not in INTRINSICS:
        raise ValueError(f"no camera model for {camera_type!r}")
    return INTRINSICS[camera_type]


def pinhole_unproject(u: Column, v: Column, fx, fy, cx, cy) -> Vec:
    return Vec((u - cx) / fx, (v - cy) / fy, F.lit(1.0))


def pinhole_project(p: Vec, fx, fy, cx, cy, limit_min_depth: bool = True) -> tuple[Column, Column]:
    z = F.when(p.z < MIN_DEPTH, 1.0).otherwise(p.z) if limit_min_depth else p.z
    return fx * p.x / z + cx, fy * p.y / z + cy


def pinhole_project_jacobian(p: Vec, fx, fy) -> list[list[Column]]:
    """Of the image point by the point; the depth as pinhole_project takes it."""
    z = F.when(p.z < MIN_DEPTH, 1.0).otherwise(p.z)
    o = F.lit(0.0)
    return [[fx / z, o, -fx * p.x / (z * z)], [o, fy / z, -fy * p.y / (z * z)]]


def mei_unproject(u: Column, v: Column, fx, fy, cx, cy, k1) -> Vec:
    """Unified model: a ray with z as the sphere gives it, scaled to z = 1."""
    x, y = (u - cx) / fx, (v - cy) / fy
    r2 = x * x + y * y
    f = (k1 + F.sqrt(1 + (1 - k1 * k1) * r2)) / (1 + r2)
    return Vec(f * x / (f - k1), f * y / (f - k1), F.lit(1.0))


def mei_project(p: Vec, fx, fy, cx, cy, k1, limit_min_depth: bool = True) -> tuple[Column, Column]:
    z = F.when(p.z < MIN_DEPTH, 1.0).otherwise(p.z) if limit_min_depth else p.z
    d = z + k1 * F.sqrt(p.x * p.x + p.y * p.y + z * z)
    return fx * p.x / d + cx, fy * p.y / d + cy


def mei_to_pinhole(fx, fy, cx, cy, k1) -> tuple:
    return fx / (1 + k1), fy / (1 + k1), cx, cy


def panorama_unproject(u: Column, v: Column) -> Vec:
    """u and v in 0..1 over the whole sphere; a unit ray, y down."""
    a, b = (u - 0.5) * (2 * PI), (v - 0.5) * PI
    return Vec(F.cos(b) * F.sin(a), F.sin(b), F.cos(b) * F.cos(a))


def panorama_project(p: Vec) -> tuple[Column, Column]:
    return F.atan2(p.x, p.z) / (2 * PI) + 0.5, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -p.y / norm(p)))) / PI


def scaled(intrinsics: Column, s: float, keep: int = 4) -> Column:
    """Intrinsics of an image scaled by s; those from number keep on (distortion) stay."""
    return F.transform(intrinsics, lambda x, i: F.when(i < keep, x * s).otherwise(x))


def cropped(intrinsics: Column, top: int, left: int) -> Column:
    return F.transform(intrinsics, lambda x, i: F.when(i == 2, x - left).when(i == 3, x - top).otherwise(x))


def resized(intrinsics: Column, rx: float, ry: float) -> Column:
    return F.transform(intrinsics, lambda x, i: F.when(i.isin(0, 2), x * rx).when(i.isin(1, 3), x * ry).otherwise(x))


def fov_to_focal(fov: Column, size: Column | float) -> Column:
    return size / (2 * F.tan(fov / 2))


def focal_to_fov(focal: Column, size: Column | float) -> Column:
    return 2 * F.atan(size / (2 * focal))


def eucm_project(p: Vec, fx, fy, cx, cy, alpha, beta) -> tuple[Column, Column]:
    d = F.sqrt(beta * (p.x * p.x + p.y * p.y) + p.z * p.z)
    k = alpha * d + (1 - alpha) * p.z
    return fx * p.x / k + cx, fy * p.y / k + cy


def eucm_unproject(u, v, fx, fy, cx, cy, alpha, beta) -> Vec:
    """A unit ray."""
    x, y = (u - cx) / fx, (v - cy) / fy
    r2 = x * x + y * y
    inner = 1 - (2 * alpha - 1) * beta * r2
    z = (1 - beta * alpha * alpha * r2) / (alpha * F.sqrt(F.greatest(inner, F.lit(0.0))) + (1 - alpha))
    n = F.sqrt(r2 + z * z)
    return Vec(x / n, y / n, z / n)


def radial_distort(x, y, k1) -> tuple[Column, Column]:
    k1 = F.greatest(F.lit(-0.7), F.least(F.lit(0.7), k1))
    f = 1 + k1 * (x * x + y * y)
    return x * f, y * f


def radial_undistort(x, y, k1) -> tuple[Column, Column]:
    """First-order inverse of radial_distort."""
    k1 = F.greatest(F.lit(-0.7), F.least(F.lit(0.7), k1))
    f = 1 - k1 * (x * x + y * y)
    return x * f, y * f


def divisional_undistort(x, y, k1) -> tuple[Column, Column]:
    f = 1 / (1 + k1 * (x * x + y * y))
    return x * f, y * f


def divisional_distort(x, y, k1) -> tuple[Column, Column]:
    r2 = x * x + y * y
    under = F.greatest(1 - 4 * k1 * r2, F.lit(0.0))
    f = F.when(F.abs(k1 * r2) < 1e-9, 1.0).otherwise((1 - F.sqrt(under)) / (2 * k1 * r2))
    return x * f, y * f


def spherical_to_euclidean(theta, phi, r) -> Vec:
    return Vec(r * F.sin(phi) * F.sin(theta), r * F.cos(phi), r * F.sin(phi) * F.cos(theta))


def euclidean_to_spherical(p: Vec) -> tuple[Column, Column, Column]:
    r = norm(p)
    return F.atan2(p.x, p.z), F.acos(p.y / r), r


def spherical_zbuffer_to_euclidean(theta, phi, z) -> Vec:
    x = z * F.tan(theta)
    return Vec(x, F.cos(phi) / F.sin(phi) * F.sqrt(x * x + z * z), z)


def rays_to_angles(p: Vec) -> tuple[Column, Column]:
    return F.atan2(p.x, p.z), F.atan2(p.y, F.sqrt(p.x * p.x + p.z * p.z))


def unit_ray(p: Vec) -> Vec:
    return scale(p, 1 / F.sqrt(dot(p, p)))


def up_field(x, y, g: Vec) -> tuple[Column, Column]:
    """Image direction of the upward vector at a normalised image point, as a unit vector."""
    ux, uy = -(g.x - g.z * x), -(g.y - g.z * y)
    n = F.sqrt(ux * ux + uy * uy)
    return ux / n, uy / n


def latitude_field(x, y, g: Vec) -> Column:
    n = F.sqrt(x * x + y * y + 1)
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (x * g.x + y * g.y + g.z) / n)))


def standard_resize(height: Column, width: Column, area: int = 384 * 512, multiple: int = 8) -> tuple[Column, Column, Column, Column]:
    """(height, width) after scaling to the area, and the bottom and right margins cut off to reach the multiple."""
    k = F.sqrt(F.lit(float(area)) / (height * width))
    h, w = F.floor(height * k), F.floor(width * k)
    return h, w, h % multiple, w % multiple


def horizon_line(roll: Column, pitch: Column, intrinsics: tuple[float, float, float, float], width: int, height: int, relative: bool = True) -> tuple[Column, Column]:
    """Where the horizon crosses the image's left and right border, as shares of its height (or in pixels)."""
    fx, fy, cx, cy = intrinsics
    x, y = F.sin(roll) * F.tan(pitch) * fx + cx, F.cos(roll) * F.tan(pitch) * fy + cy
    ends = y + x * F.tan(roll), y - (width - x) * F.tan(roll)
    return tuple(e / height for e in ends) if relative else ends


def scaled_jacobian(j: list[list[Column]], s: Column | float) -> list[list[Column]]:
    """A Jacobian by the intrinsics of an image scaled by s: every entry times s, that of the distortion too."""
    return [[x * s for x in row] for row in j]


#: Pinhole camera (fx, fy, cx, cy) that stands for a panorama: 512 x 256 pixels, 90 degrees wide.
PANORAMA_PINHOLE = (256.0, 256.0, 256.0, 128.0)


def project_any(kind: Column, p: Vec, k: list[Column]) -> tuple[Column, Column]:
    """Projection by each row's own camera type (PINHOLE, MEI, PANORAMA); k: fx, fy, cx, cy, k1. Other types give null."""
    made = {"PINHOLE": pinhole_project(p, *k[:4]), "MEI": mei_project(p, *k[:5]), "PANORAMA": panorama_project(p)}
    pick = lambda i: F.coalesce(*(F.when(kind == name, uv[i]) for name, uv in made.items()))
    return pick(0), pick(1)


def track_residual(u, v, disparity: Column, pose_i: SE3, pose_j: SE3, rig_i: SE3, rig_j: SE3, k: list, target: tuple[Column, Column]) -> tuple[Column, Column, Column, Column, Column]:
    """A track's residual (x, y) in view j, its derivatives by the disparity, and whether its point is in front.

    Poses are world to camera, rigs camera to rig; the residual is the projection less the target. The
    chain of poses is deep: stage them where many rows are at stake.
    """
    rel = se3_mul(se3_mul(se3_inv(rig_j), pose_j), se3_mul(se3_inv(pose_i), rig_i))
    p = Vec(*se3_act_homogeneous(rel, pinhole_unproject(u, v, *k), disparity))
    x, y = pinhole_project(p, *k)
    jx, jy = (sum((a * b for a, b in zip(row[1:], rel.t[1:])), row[0] * rel.t[0]) for row in pinhole_project_jacobian(p, k[0], k[1]))
    return x - target[0], y - target[1], jx, jy, p.z > MIN_DEPTH
