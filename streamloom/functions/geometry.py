"""Rigid and similarity transforms as Column expressions.

Vectors, quaternions (x, y, z, w) and transforms are tuples of Columns, so that a whole chain of them is
one projection inside generated code. Tangents are (translation, rotation[, log scale]).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 1e-8
PI = 3.141592653589793


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column


class Quat(NamedTuple):
    x: Column
    y: Column
    z: Column
    w: Column


class SE3(NamedTuple):
    t: Vec
    q: Quat


class Sim3(NamedTuple):
    t: Vec
    q: Quat
    s: Column


def staged(df: DataFrame, prefix: str, values: tuple) -> tuple[DataFrame, tuple]:
    """df with the Columns of a (nested) tuple as columns, and the same tuple of references to them.

    A Column holds its whole expression, so a long chain in which each step uses the last one several
    times should be cut by this between its steps.
    """
    columns: dict[str, Column] = {}

    def walk(v):
        if isinstance(v, tuple):
            made = [walk(x) for x in v]
            return type(v)(*made) if hasattr(v, "_fields") else tuple(made)
        name = f"{prefix}{len(columns)}"
        columns[name] = v
        return F.col(name)

    out = walk(values)
    return df.withColumns(columns), out


def vec(*c: Column | str | float) -> Vec:
    return Vec(*(F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x)) for x in c))


def add(a: Vec, b: Vec) -> Vec:
    return Vec(*(x + y for x, y in zip(a, b)))


def sub(a: Vec, b: Vec) -> Vec:
    return Vec(*(x - y for x, y in zip(a, b)))


def scale(a: Vec, k: Column | float) -> Vec:
    return Vec(*(x * k for x in a))


def dot(a: tuple, b: tuple) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def norm(a: tuple) -> Column:
    return F.sqrt(dot(a, a))


# -- rotations ---------------------------------------------------------------------------------


def identity_quat() -> Quat:
    return Quat(*(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))


def quat_mul(a: Quat, b: Quat) -> Quat:
    v = add(add(scale(Vec(*b[:3]), a.w), scale(Vec(*a[:3]), b.w)), cross(Vec(*a[:3]), Vec(*b[:3])))
    return Quat(*v, a.w * b.w - dot(a[:3], b[:3]))


def quat_inv(q: Quat) -> Quat:
    """Inverse of a unit quaternion."""
    return Quat(-q.x, -q.y, -q.z, q.w)


def quat_normalise(q: Quat) -> Quat:
    n = norm(q)
    return Quat(*(c / n for c in q))


def standardise_quat(q: Quat) -> Quat:
    """The one of q and -q with w >= 0."""
    return Quat(*(F.when(q.w < 0, -c).otherwise(c) for c in q))


def rotate(q: Quat, p: Vec) -> Vec:
    u = Vec(*q[:3])
    uv = scale(cross(u, p), 2.0)
    return add(add(p, scale(uv, q.w)), cross(u, uv))


def quat_to_matrix(q: Quat) -> list[list[Column]]:
    x, y, z, w = q
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]


def matrix_to_quat(m: list[list[Column]]) -> Quat:
    """Of a rotation matrix: by the largest of its diagonal entries and its trace, which is well conditioned everywhere."""
    t = m[0][0] + m[1][1] + m[2][2]
    large = F.greatest(m[0][0], m[1][1], m[2][2], t)

    def by_axis(i: int) -> tuple[Column, ...]:
        j, k = (i + 1) % 3, (i + 2) % 3
        own = {i: 1 - t + 2 * m[i][i], j: m[j][i] + m[i][j], k: m[k][i] + m[i][k]}
        return (own[0], own[1], own[2], m[k][j] - m[j][k])

    by_trace = (m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1], 1 + t)
    raw = [F.when(large == m[0][0], a).when(large == m[1][1], b).when(large == m[2][2], c).otherwise(d) for a, b, c, d in zip(by_axis(0), by_axis(1), by_axis(2), by_trace)]
    return quat_normalise(Quat(*raw))


def so3_exp(phi: Vec) -> Quat:
    th2 = dot(phi, phi)
    th = F.sqrt(th2)
    imag = F.when(th2 < SMALL, 0.5 - th2 / 48 + th2 * th2 / 3840).otherwise(F.sin(th / 2) / th)
    real = F.when(th2 < SMALL, 1 - th2 / 8 + th2 * th2 / 384).otherwise(F.cos(th / 2))
    return Quat(*scale(phi, imag), real)


def so3_log(q: Quat) -> Vec:
    n2 = dot(q[:3], q[:3])
    n = F.sqrt(n2)
    small = F.lit(2.0) / q.w - F.lit(2.0 / 3) * n2 / (q.w * q.w * q.w)
    large = 2 * F.atan2(F.when(q.w < 0, -n).otherwise(n), F.when(q.w < 0, -q.w).otherwise(q.w)) / n
    return scale(Vec(*q[:3]), F.when(n2 < SMALL, small).otherwise(large))


def rpy_to_matrix(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Rz(roll) Rx(pitch) Ry(yaw): the rotation of a camera whose z axis looks forward."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    z, x, y = [[cr, -sr, F.lit(0.0)], [sr, cr, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]], [[F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), cp, -sp], [F.lit(0.0), sp, cp]], [[cy, F.lit(0.0), sy], [F.lit(0.0), F.lit(1.0), F.lit(0.0)], [-sy, F.lit(0.0), cy]]
    return mat_mul(mat_mul(z, x), y)


def yaw_pitch_quat(yaw: Column, pitch: Column) -> Quat:
    """Extrinsic rotation by pitch about x and then by yaw about y."""
    zero = F.lit(0.0)
    return quat_mul(Quat(zero, F.sin(yaw / 2), zero, F.cos(yaw / 2)), Quat(F.sin(pitch / 2), zero, zero, F.cos(pitch / 2)))


def mat_mul(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[sum((a[i][k] * b[k][j] for k in range(1, len(b))), a[i][0] * b[0][j]) for j in range(len(b[0]))] for i in range(len(a))]


def mat_vec(m: list[list[Column]], v: Vec) -> Vec:
    return Vec(*(dot(tuple(r), v) for r in m))


def transpose(m: list[list[Column]]) -> list[list[Column]]:
    return [list(r) for r in zip(*m)]


def skew(v: Vec) -> list[list[Column]]:
    o = F.lit(0.0)
    return [[o, -v.z, v.y], [v.z, o, -v.x], [-v.y, v.x, o]]


# -- rigid transforms --------------------------------------------------------------------------


def se3_identity() -> SE3:
    return SE3(vec(0.0, 0.0, 0.0), identity_quat())


def se3_mul(a: SE3, b: SE3) -> SE3:
    return SE3(add(rotate(a.q, b.t), a.t), quat_mul(a.q, b.q))


def se3_inv(a: SE3) -> SE3:
    q = quat_inv(a.q)
    return SE3(scale(rotate(q, a.t), -1.0), q)


def se3_act(a: SE3, p: Vec) -> Vec:
    return add(rotate(a.q, p), a.t)


def se3_act_homogeneous(a: SE3, p: Vec, d: Column) -> Vec:
    """Of (p, d): a point p / d, kept scaled by d."""
    return add(rotate(a.q, p), scale(a.t, d))


def _v_terms(th2: Column) -> tuple[Column, Column]:
    th = F.sqrt(th2)
    return F.when(th2 < SMALL, 0.5 - th2 / 24).otherwise((1 - F.cos(th)) / th2), F.when(th2 < SMALL, F.lit(1.0 / 6) - th2 / 120).otherwise((th - F.sin(th)) / (th2 * th))


def se3_exp(tau: Vec, phi: Vec) -> SE3:
    a, b = _v_terms(dot(phi, phi))
    one = cross(phi, tau)
    return SE3(add(add(tau, scale(one, a)), scale(cross(phi, one), b)), so3_exp(phi))


def se3_log(x: SE3) -> tuple[Vec, Vec]:
    phi = so3_log(x.q)
    th2 = dot(phi, phi)
    th = F.sqrt(th2)
    c = F.when(th2 < SMALL, F.lit(1.0 / 12)).otherwise((1 - th * F.cos(th / 2) / (2 * F.sin(th / 2))) / th2)
    one = cross(phi, x.t)
    return add(sub(x.t, scale(one, 0.5)), scale(cross(phi, one), c)), phi


def se3_retract(tau: Vec, phi: Vec, x: SE3) -> SE3:
    """Left retraction: exp(tangent) x."""
    return se3_mul(se3_exp(tau, phi), x)


def se3_adj(x: SE3, tau: Vec, phi: Vec) -> tuple[Vec, Vec]:
    r = rotate(x.q, phi)
    return add(rotate(x.q, tau), cross(x.t, r)), r


def se3_adj_t(x: SE3, tau: Vec, phi: Vec) -> tuple[Vec, Vec]:
    """The transposed adjoint times a co-vector."""
    q = quat_inv(x.q)
    return rotate(q, tau), rotate(q, sub(phi, cross(x.t, tau)))


def se3_relative(i: SE3, j: SE3) -> SE3:
    """j * inverse(i)."""
    return se3_mul(j, se3_inv(i))


def se3_scale(x: SE3, s: Column | float) -> SE3:
    return SE3(scale(x.t, s), x.q)


def so3_left_jacobian_inverse(phi: Vec, v: Vec) -> Vec:
    th2 = dot(phi, phi)
    th = F.sqrt(th2)
    c = F.when(th2 < SMALL, F.lit(1.0 / 12)).otherwise((1 - th * F.cos(th / 2) / (2 * F.sin(th / 2))) / th2)
    one = cross(phi, v)
    return add(sub(v, scale(one, 0.5)), scale(cross(phi, one), c))


def se3_to_matrix(x: SE3) -> list[list[Column]]:
    r = quat_to_matrix(x.q)
    return [[*r[i], x.t[i]] for i in range(3)] + [[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]]


def matrix_to_se3(m: list[list[Column]]) -> SE3:
    return SE3(Vec(m[0][3], m[1][3], m[2][3]), matrix_to_quat([r[:3] for r in m[:3]]))


def matrix_inverse(m: list[list[Column]]) -> list[list[Column]]:
    """Of a rigid 4 x 4 matrix."""
    r = transpose([x[:3] for x in m[:3]])
    t = mat_vec(r, Vec(m[0][3], m[1][3], m[2][3]))
    return [[*r[i], -t[i]] for i in range(3)] + [[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]]


def array_matrix(m: Column, rows: int = 4, cols: int = 4) -> list[list[Column]]:
    """Entries of a row-major array column."""
    return [[m[i * cols + j] for j in range(cols)] for i in range(rows)]


def interpolate(a: SE3, b: SE3, u: Column) -> SE3:
    """Constant-velocity motion from a (u = 0) through b (u = 1)."""
    tau, phi = se3_log(se3_mul(b, se3_inv(a)))
    return se3_mul(se3_exp(scale(tau, u), scale(phi, u)), a)


# -- similarities ------------------------------------------------------------------------------


def rxso3_exp(phi: Vec, sigma: Column) -> tuple[Quat, Column]:
    return so3_exp(phi), F.exp(sigma)


def rxso3_log(q: Quat, s: Column) -> tuple[Vec, Column]:
    return so3_log(q), F.log(s)


def sim3_act(x: Sim3, p: Vec) -> Vec:
    return add(scale(rotate(x.q, p), x.s), x.t)


def sim3_mul(a: Sim3, b: Sim3) -> Sim3:
    return Sim3(sim3_act(a, b.t), quat_mul(a.q, b.q), a.s * b.s)


def sim3_inv(a: Sim3) -> Sim3:
    q = quat_inv(a.q)
    return Sim3(scale(rotate(q, a.t), -1 / a.s), q, 1 / a.s)


def sim3_apply_se3(a: Sim3, x: SE3) -> SE3:
    """A pose in the transformed world: positions move and scale, orientations turn."""
    return SE3(sim3_act(a, x.t), quat_mul(a.q, x.q))


def _w_terms(phi: Vec, sigma: Column) -> tuple[Column, Column, Column]:
    """Coefficients of the identity, of the skew matrix and of its square in the translation's Jacobian."""
    th2 = dot(phi, phi)
    th, s = F.sqrt(th2), F.exp(sigma)
    flat, still = F.abs(sigma) < 1e-6, th2 < SMALL
    c = F.when(flat, 1 + sigma / 2).otherwise((s - 1) / sigma)
    a0, b0 = _v_terms(th2)
    a = F.when(flat, a0).when(still, ((sigma - 1) * s + 1) / (sigma * sigma)).otherwise((s * F.sin(th) * sigma + (1 - s * F.cos(th)) * th) / (th * (th2 + sigma * sigma)))
    b = F.when(flat, b0).when(still, (s * sigma * sigma / 2 + s - 1 - sigma * s) / (sigma * sigma * sigma)).otherwise((c - ((s * F.cos(th) - 1) * sigma + s * F.sin(th) * th) / (th2 + sigma * sigma)) / th2)
    return c, a, b


def sim3_exp(tau: Vec, phi: Vec, sigma: Column) -> Sim3:
    c, a, b = _w_terms(phi, sigma)
    one = cross(phi, tau)
    return Sim3(add(add(scale(tau, c), scale(one, a)), scale(cross(phi, one), b)), so3_exp(phi), F.exp(sigma))


def sim3_jacobian(phi: Vec, sigma: Column) -> list[list[Column]]:
    """The matrix that takes a tangent's translation part to the transform's translation."""
    c, a, b = _w_terms(phi, sigma)
    k = skew(phi)
    kk = mat_mul(k, k)
    return [[(c if i == j else F.lit(0.0)) + a * k[i][j] + b * kk[i][j] for j in range(3)] for i in range(3)]


def sim3_log(x: Sim3) -> tuple[Vec, Vec, Column]:
    """A deep expression: stage the rotation's logarithm and the Jacobian where many rows are at stake."""
    phi, sigma = so3_log(x.q), F.log(x.s)
    return solve3(sim3_jacobian(phi, sigma), x.t), phi, sigma


def solve3(m: list[list[Column]], v: Vec) -> Vec:
    """The solution of a 3 x 3 system by Cramer's rule; null where it is singular."""
    cols = [Vec(*(m[i][j] for i in range(3))) for j in range(3)]
    det = dot(cols[0], cross(cols[1], cols[2]))
    d = F.when(det != 0, det)
    return Vec(dot(v, cross(cols[1], cols[2])) / d, dot(cols[0], cross(v, cols[2])) / d, dot(cols[0], cross(cols[1], v)) / d)


# -- gravity -----------------------------------------------------------------------------------


def gravity_from_rp(roll: Column, pitch: Column) -> Vec:
    return Vec(-F.sin(roll) * F.cos(pitch), -F.cos(roll) * F.cos(pitch), F.sin(pitch))


def rp_from_gravity(g: Vec) -> tuple[Column, Column]:
    roll = F.asin(-g.x / F.sqrt(F.greatest(1 - g.z * g.z, F.lit(1e-12))))
    offset = F.when(F.signum(g.x) == 0, -F.lit(PI)).otherwise(-F.lit(PI) * F.signum(g.x))
    return F.when(g.y < 0, roll).otherwise(offset - roll), F.asin(g.z)


# -- steps of a solver -------------------------------------------------------------------------


def retract_rotation(phi: Vec, x: SE3) -> SE3:
    """A pose of a rig after a step that may only turn it; its place turns too, as the step acts from the left."""
    return se3_retract(vec(0.0, 0.0, 0.0), phi, x)


def retract_disparity(disparity: Column, step: Column) -> Column:
    """A dense disparity after a step; steps above 10 count as none."""
    return disparity + F.when(step > 10, 0.0).otherwise(step)


def retract_track_disparity(disparity: Column, step: Column) -> Column:
    """A track's disparity after a step, within 0.001 and 10."""
    return F.least(F.lit(10.0), F.greatest(F.lit(1e-3), disparity + step))


def retract_intrinsics(intrinsics: Column, step: Column) -> Column:
    """(fx, fy, cx, cy, distortion ...) after a step (focal, distortion ...): one focal step, a hundredth of the others."""
    return F.transform(intrinsics, lambda x, i: x + F.when(i < 2, step[0]).when(i < 4, 0.0).otherwise(0.01 * F.get(step, i - 3)))


def sim3_apply_rig(a: Sim3, x: SE3, right: Vec) -> SE3:
    """A pose of a rig of which only the translation is known: the transform, the pose, then the translation."""
    moved = sim3_mul(a, Sim3(x.t, x.q, F.lit(1.0)))
    done = sim3_mul(moved, Sim3(right, identity_quat(), F.lit(1.0)))
    return SE3(done.t, done.q)


def random_normal(seed: int, *key: str) -> Column:
    """A standard normal of a row's key: the same on every run and under every partitioning."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * PI * unit(1))


def random_se3(sigma: float, seed: int, *key: str) -> SE3:
    """exp of six independent normals of deviation sigma."""
    draw = [random_normal(seed * 6 + k, *key) * sigma for k in range(6)]
    return se3_exp(Vec(*draw[:3]), Vec(*draw[3:]))
