"""Lens models whose inverse needs iteration, and spherical harmonics: NumPy kernels behind Arrow-batched UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

ITERATIONS = 20


def opencv_distort(x: np.ndarray, y: np.ndarray, k: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """k: k1, k2, k3 radial, p1, p2 tangential, s1..s4 thin prism."""
    k1, k2, k3, p1, p2, s1, s2, s3, s4 = (list(k) + [0.0] * 9)[:9]
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x) + s1 * r2 + s2 * r2 * r2, y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y + s3 * r2 + s4 * r2 * r2


def fisheye_distort(x: np.ndarray, y: np.ndarray, k: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """k: six odd radial terms of the angle, p1, p2 tangential, s1..s4 thin prism."""
    k = (list(k) + [0.0] * 12)[:12]
    r = np.sqrt(x * x + y * y)
    th = np.arctan(r)
    th2 = th * th
    radial = th * (1 + sum(c * th2 ** (n + 1) for n, c in enumerate(k[:6])))
    scale = np.where(r > 1e-9, radial / np.maximum(r, 1e-9), 1.0)
    a, b = x * scale, y * scale
    r2 = a * a + b * b
    p1, p2, s1, s2, s3, s4 = k[6:]
    return a + 2 * p1 * a * b + p2 * (r2 + 2 * a * a) + s1 * r2 + s2 * r2 * r2, b + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b + s3 * r2 + s4 * r2 * r2


def undistort(distort: Callable, u: np.ndarray, v: np.ndarray, k: list[float], iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """The point that distorts to (u, v), by Newton steps with numeric derivatives."""
    x, y = u.copy(), v.copy()
    h = 1e-6
    for _ in range(iterations):
        fx, fy = distort(x, y, k)
        ax, ay = distort(x + h, y, k)
        bx, by = distort(x, y + h, k)
        a, b, c, d = (ax - fx) / h, (bx - fx) / h, (ay - fy) / h, (by - fy) / h
        det = a * d - b * c
        det = np.where(np.abs(det) < 1e-12, 1e-12, det)
        ex, ey = u - fx, v - fy
        x, y = x + (d * ex - b * ey) / det, y + (a * ey - c * ex) / det
    return x, y


def mei_sphere(x: np.ndarray, y: np.ndarray, z: np.ndarray, xi: float, k: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Unified model: onto the unit sphere, moved by xi, divided, and distorted (k1, k2, p1, p2)."""
    n = np.sqrt(x * x + y * y + z * z)
    d = z / n + xi
    k1, k2, p1, p2 = (list(k) + [0.0] * 4)[:4]
    return opencv_distort(x / n / d, y / n / d, [k1, k2, 0.0, p1, p2])


def mei_ray(u: np.ndarray, v: np.ndarray, xi: float, k: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit ray of a normalised image point."""
    k1, k2, p1, p2 = (list(k) + [0.0] * 4)[:4]
    x, y = undistort(opencv_distort, u, v, [k1, k2, 0.0, p1, p2])
    r2 = x * x + y * y
    f = (xi + np.sqrt(np.maximum(1 + (1 - xi * xi) * r2, 0))) / (1 + r2)
    return f * x, f * y, f - xi


_DISTORT = {"OPENCV": opencv_distort, "FISHEYE624": fisheye_distort}


def lens_udf(model: str, k: list[float], inverse: bool = False):
    """A UDF (x, y) -> struct<x, y> that distorts normalised points, or undoes it."""
    f = _DISTORT[model]

    @F.pandas_udf("x double, y double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        a, b = x.to_numpy(float), y.to_numpy(float)
        return pd.DataFrame(dict(zip("xy", undistort(f, a, b, k) if inverse else f(a, b, k))))

    return run


def legendre(degree: int, x: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Associated Legendre functions (without the alternating sign) of all orders up to the degree, by recurrence."""
    p = {(0, 0): np.ones_like(x)}
    s = np.sqrt(np.maximum(1 - x * x, 0))
    for m in range(1, degree + 1):
        p[m, m] = (2 * m - 1) * s * p[m - 1, m - 1]
    for m in range(degree):
        p[m + 1, m] = (2 * m + 1) * x * p[m, m]
    for m in range(degree + 1):
        for n in range(m + 2, degree + 1):
            p[n, m] = ((2 * n - 1) * x * p[n - 1, m] - (n + m - 1) * p[n - 2, m]) / (n - m)
    return p


def harmonics(degree: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Real spherical harmonics of unit directions, orthonormal, in the order (0,0), (1,-1), (1,0), (1,1), ..."""
    p, phi = legendre(degree, z), np.arctan2(y, x)
    out = []
    for n in range(degree + 1):
        for m in range(-n, n + 1):
            k = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - abs(m)) / math.factorial(n + abs(m)))
            base = k * p[n, abs(m)]
            out.append(base if m == 0 else math.sqrt(2) * base * (np.cos(m * phi) if m > 0 else np.sin(-m * phi)))
    return np.stack(out, -1)


def harmonics_udf(degree: int):
    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(list(harmonics(degree, x.to_numpy(float), y.to_numpy(float), z.to_numpy(float))))

    return run
