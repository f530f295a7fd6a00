"""Gauss-Newton bundle adjustment of small frame graphs, and a damped least-squares camera fit.

A graph (poses, inverse depths on a coarse grid, flow targets on edges) is a bounded dense problem; many
graphs are solved side by side by applyInPandas over their keys, one graph in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_DEPTH = 0.1
MOST_STEP = 10.0


def quat_rotate(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    u, w = q[..., :3], q[..., 3:]
    t = 2 * np.cross(u, p)
    return p + w * t + np.cross(u, t)


def quat_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    av, aw, bv, bw = a[..., :3], a[..., 3:], b[..., :3], b[..., 3:]
    return np.concatenate([aw * bv + bw * av + np.cross(av, bv), aw * bw - (av * bv).sum(-1, keepdims=True)], -1)


def pose_inv(p: np.ndarray) -> np.ndarray:
    q = p[..., 3:] * np.array([-1, -1, -1, 1])
    return np.concatenate([-quat_rotate(q, p[..., :3]), q], -1)


def pose_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([quat_rotate(a[..., 3:], b[..., :3]) + a[..., :3], quat_mul(a[..., 3:], b[..., 3:])], -1)


def pose_exp(xi: np.ndarray) -> np.ndarray:
    tau, phi = xi[..., :3], xi[..., 3:]
    th2 = (phi * phi).sum(-1, keepdims=True)
    th = np.sqrt(np.maximum(th2, 1e-30))
    small = th2 < 1e-8
    s = np.where(small, 0.5 - th2 / 48, np.sin(th / 2) / th)
    c = np.where(small, 1 - th2 / 8, np.cos(th / 2))
    a, b = np.where(small, 0.5 - th2 / 24, (1 - np.cos(th)) / np.maximum(th2, 1e-30)), np.where(small, 1 / 6 - th2 / 120, (th - np.sin(th)) / np.maximum(th2 * th, 1e-30))
    one = np.cross(phi, tau)
    return np.concatenate([tau + a * one + b * np.cross(phi, one), phi * s, c], -1)


def pose_log(p: np.ndarray) -> np.ndarray:
    q = np.where(p[..., 6:] < 0, -p[..., 3:], p[..., 3:])
    n = np.linalg.norm(q[..., :3], axis=-1, keepdims=True)
    phi = q[..., :3] * np.where(n < 1e-9, 2.0, 2 * np.arctan2(n, q[..., 3:]) / np.maximum(n, 1e-30))
    th2 = (phi * phi).sum(-1, keepdims=True)
    th = np.sqrt(np.maximum(th2, 1e-30))
    c = np.where(th2 < 1e-8, 1 / 12, (1 - th * np.cos(th / 2) / (2 * np.maximum(np.sin(th / 2), 1e-30))) / np.maximum(th2, 1e-30))
    one = np.cross(phi, p[..., :3])
    return np.concatenate([p[..., :3] - one / 2 + c * np.cross(phi, one), phi], -1)


def adjoint_t(p: np.ndarray, J: np.ndarray) -> np.ndarray:
    """Rows J (..., 6) times the adjoint of p."""
    R = np.stack([quat_rotate(p[..., 3:], np.broadcast_to(e, p[..., :3].shape)) for e in np.eye(3)], -1)
    t = p[..., :3]
    T = np.zeros((*t.shape[:-1], 3, 3))
    T[..., 0, 1], T[..., 0, 2], T[..., 1, 0], T[..., 1, 2], T[..., 2, 0], T[..., 2, 1] = -t[..., 2], t[..., 1], t[..., 2], -t[..., 0], -t[..., 1], t[..., 0]
    left = J[..., :3] @ R
    right = J[..., :3] @ (T @ R) + J[..., 3:] @ R
    return np.concatenate([left, right], -1)


@dataclass
class Graph:
    """poses (n, 7) world to camera; disps (n, h, w); intrinsics fx fy cx cy; edges i, j with target and weight (e, h, w, 2)."""

    poses: np.ndarray
    disps: np.ndarray
    intrinsics: np.ndarray
    i: np.ndarray
    j: np.ndarray
    target: np.ndarray
    weight: np.ndarray


def reproject(g: Graph, jacobians: bool = True):
    """Of each edge and pixel: image point in j, validity, and Jacobians by pose i, pose j, inverse depth and focal."""
    fx, fy, cx, cy = g.intrinsics
    h, w = g.disps.shape[1:]
    v, u = np.mgrid[:h, :w].astype(float)
    ray = np.stack([(u - cx) / fx, (v - cy) / fy, np.ones_like(u)], -1)
    d = g.disps[g.i]
    rel = pose_mul(g.poses[g.j], pose_inv(g.poses[g.i]))
    rel[g.i == g.j] = np.array([0, 0, 0, 0, 0, 0, 1.0])
    e = rel[:, None, None, :]
    rotated = quat_rotate(np.broadcast_to(e[..., 3:], (*d.shape, 4)), np.broadcast_to(ray, (*d.shape, 3)))
    p = rotated + e[..., :3] * d[..., None]
    z = np.where(p[..., 2] < MIN_DEPTH, 1.0, p[..., 2])
    uv = np.stack([fx * p[..., 0] / z + cx, fy * p[..., 1] / z + cy], -1)
    valid = (p[..., 2] > MIN_DEPTH).astype(float)
    if not jacobians:
        return uv, valid
    Jp = np.zeros((*d.shape, 2, 3))
    Jp[..., 0, 0], Jp[..., 0, 2], Jp[..., 1, 1], Jp[..., 1, 2] = fx / z, -fx * p[..., 0] / z**2, fy / z, -fy * p[..., 1] / z**2
    act = np.zeros((*d.shape, 3, 6))
    act[..., 0, 0] = act[..., 1, 1] = act[..., 2, 2] = d
    X, Y, Z = p[..., 0], p[..., 1], p[..., 2]
    act[..., 0, 4], act[..., 0, 5], act[..., 1, 3], act[..., 1, 5], act[..., 2, 3], act[..., 2, 4] = Z, -Y, -Z, X, Y, -X
    Jj = Jp @ act
    Ji = -adjoint_t(rel[:, None, None, :].repeat(h, 1).repeat(w, 2), Jj)
    Jz = (Jp @ np.broadcast_to(e[..., :3], p.shape)[..., None])[..., 0]
    # A shared focal scale acts on the projection and, inversely, on the ray.
    ratio = fy / fx
    dray = np.stack([-(u - cx) / fx**2, -(v - cy) / fy**2 * ratio, np.zeros_like(u)], -1)
    turned = quat_rotate(np.broadcast_to(e[..., 3:], (*d.shape, 4)), np.broadcast_to(dray, (*d.shape, 3)))
    Jf = (Jp @ turned[..., None])[..., 0] + np.stack([p[..., 0] / z, ratio * p[..., 1] / z], -1)
    return uv, valid, Ji, Jj, Jz, Jf


def adjust(g: Graph, eta: np.ndarray, t0: int = 1, t1: int | None = None, iterations: int = 1, damping: float = 1e-4, ep: float = 0.1, sensor: np.ndarray | None = None, alpha: float = 0.0, motion_only: bool = False, focal: bool = False, robust=None) -> list[float]:
    """Gauss-Newton steps in place; the energy before each.

    Poses t0 .. t1 - 1 move (others are held); inverse depths of frames that start an edge are
    eliminated by the Schur complement; eta damps them; a sensor's inverse depths (0: none) draw them
    with weight alpha. A singular system moves nothing.
    """
    n, h, w = g.disps.shape
    t1 = n if t1 is None else t1
    energies = []
    for _ in range(iterations):
        uv, valid, Ji, Jj, Jz, Jf = reproject(g)
        r = g.target - uv
        weight = 1e-3 * g.weight * valid[..., None]
        if robust is not None:
            weight = weight * robust(np.sqrt((weight * r * r).sum(-1, keepdims=True)))
        energies.append(float((weight * r * r).sum()))
        P = t1 - t0
        m = 6 * P + int(focal)
        H, b = np.zeros((m, m)), np.zeros(m)
        frames = np.unique(g.i)
        slot = {f: k for k, f in enumerate(frames)}
        E, C, W = np.zeros((m, len(frames), h * w)), np.zeros((len(frames), h * w)), np.zeros((len(frames), h * w))
        for e, (i, j) in enumerate(zip(g.i, g.j)):
            rows = [(slice(6 * (f - t0), 6 * (f - t0) + 6), J[e].reshape(-1, 2, 6)) for f, J in ((i, Ji), (j, Jj)) if t0 <= f < t1 and i != j]
            if focal:
                rows.append((slice(m - 1, m), Jf[e].reshape(-1, 2, 1)))
            we, re, ze = weight[e].reshape(-1, 2), r[e].reshape(-1, 2), Jz[e].reshape(-1, 2)
            for a, Ja in rows:
                b[a] += np.einsum("pk,pkc,pk->c", we, Ja, re)
                for c, Jc in rows:
                    H[a, c] += np.einsum("pk,pka,pkc->ac", we, Ja, Jc)
                E[a, slot[i]] += np.einsum("pk,pka,pk->ap", we, Ja, ze)
            C[slot[i]] += (we * ze * ze).sum(1)
            W[slot[i]] += (we * ze * re).sum(1)
        if sensor is not None:
            s = sensor[frames].reshape(len(frames), -1)
            has = (s > 0).astype(float) * alpha
            C += has
            W += has * (s - g.disps[frames].reshape(len(frames), -1))
        C += eta[frames].reshape(len(frames), -1) + 1e-7
        H[np.diag_indices(m)] = H.diagonal() * (1 + damping) + ep
        S, v = H, b
        if not motion_only:
            Q = 1 / C
            S = H - np.einsum("afp,fp,bfp->ab", E, Q, E)
            v = b - np.einsum("afp,fp,fp->a", E, Q, W)
        try:
            np.linalg.cholesky(S)
            dx = np.linalg.solve(S, v)
        except np.linalg.LinAlgError:
            dx = np.zeros(m)
        if not motion_only:
            dz = (W - np.einsum("afp,a->fp", E, dx)) / C
            dz = np.where(dz > MOST_STEP, 0.0, dz).reshape(-1, h, w)
            for f, k in slot.items():
                g.disps[f] = g.disps[f] + dz[k]
        g.poses[t0:t1] = pose_mul(pose_exp(dx[: 6 * P].reshape(P, 6)), g.poses[t0:t1])
        g.poses[:, 3:] /= np.linalg.norm(g.poses[:, 3:], axis=1, keepdims=True)
        if focal:
            ratio = g.intrinsics[1] / g.intrinsics[0]
            g.intrinsics[0] += dx[-1]
            g.intrinsics[1] += dx[-1] * ratio
    return energies


def adjust_graphs(graphs: DataFrame, key: str, iterations: int = 2) -> DataFrame:
    """Rows (key, n, h, w, poses, disps, intrinsics, i, j, target, weight as flat arrays) -> (key, poses, energy before, energy after)."""
    kind = dict(graphs.dtypes)[key]

    def run(parts):
        for p in parts:
            out = []
            for _, x in p.iterrows():
                n, h, w = int(x["n"]), int(x["h"]), int(x["w"])
                e = len(x["i"])
                g = Graph(np.array(x["poses"], float).reshape(n, 7), np.array(x["disps"], float).reshape(n, h, w), np.array(x["intrinsics"], float), np.array(x["i"], int), np.array(x["j"], int), np.array(x["target"], float).reshape(e, h, w, 2), np.array(x["weight"], float).reshape(e, h, w, 2))
                energy = adjust(g, np.full((n, h, w), 0.1), iterations=iterations + 1)
                out.append([x[key], g.poses.ravel().tolist(), energy[0], energy[-1]])
            yield pd.DataFrame(out, columns=[key, "poses", "energy_before", "energy_after"])

    return graphs.mapInPandas(run, f"{key} {kind}, poses array<double>, energy_before double, energy_after double")


def damped_least_squares(residual, x: np.ndarray, steps: int = 30, lam: float = 0.1, bounds: tuple[float, float] = (1e-6, 1e2), tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Levenberg-Marquardt with numeric derivatives: (solution, covariance as the inverse of the normal matrix)."""
    x = x.astype(float).copy()
    cost = lambda v: float((residual(v) ** 2).sum())
    jacobian = lambda v: np.stack([(residual(v + d) - residual(v - d)) / (2 * d[k]) for k, d in enumerate(np.eye(len(v)) * 1e-6)], 1)
    now = cost(x)
    for _ in range(steps):
        r, J = residual(x), jacobian(x)
        H = J.T @ J
        step = np.linalg.lstsq(H + lam * np.diag(np.maximum(H.diagonal(), 1e-6)), -J.T @ r, rcond=None)[0]
        new = cost(x + step)
        better = new < now
        lam = float(np.clip(lam * (0.1 if better else 10.0), *bounds))
        if better:
            done = abs(now - new) <= tol * max(now, 1e-12)
            x, now = x + step, new
            if done:
                break
    J = jacobian(x)
    return x, np.linalg.pinv(J.T @ J)


def calibrate(fields: DataFrame, key: str, size: tuple[int, int], uncertainty: bool = False) -> DataFrame:
    """roll, pitch and vertical field of view of each image from its up and latitude fields.

    fields: key and arrays u, v (pixels), up_x, up_y, latitude. Starts level with a focal of 0.7 times the larger side.
    With uncertainty also the deviations that the inverse normal matrix gives, for residuals of deviation 1:
    roll_sd, pitch_sd, gravity_sd (the worst direction of both), focal_sd (half) and vfov_sd.
    """
    kind = dict(fields.dtypes)[key]
    height, width = size
    names = ["roll", "pitch", "vfov", *(["roll_sd", "pitch_sd", "gravity_sd", "focal_sd", "vfov_sd"] if uncertainty else [])]

    def run(parts):
        for p in parts:
            out = []
            for _, f in p.iterrows():
                u, v = np.array(f["u"], float), np.array(f["v"], float)

                def residual(x):
                    x0, y0 = (u - width / 2) / x[2], (v - height / 2) / x[2]
                    g = np.array([-np.sin(x[0]) * np.cos(x[1]), -np.cos(x[0]) * np.cos(x[1]), np.sin(x[1])])
                    a, b = -(g[0] - g[2] * x0), -(g[1] - g[2] * y0)
                    n = np.hypot(a, b) + 1e-12
                    lat = np.arcsin(np.clip((x0 * g[0] + y0 * g[1] + g[2]) / np.sqrt(x0**2 + y0**2 + 1), -1, 1))
                    return np.concatenate([a / n - np.array(f["up_x"], float), b / n - np.array(f["up_y"], float), lat - np.array(f["latitude"], float)])

                x, cov = damped_least_squares(residual, np.array([0.0, 0.0, 0.7 * max(size)]))
                row = [f[key], x[0], x[1], 2 * np.arctan(height / (2 * x[2]))]
                if uncertainty:
                    by_focal = 4 * height / (4 * x[2] ** 2 + height**2)
                    row += [cov[0, 0] ** 0.5, cov[1, 1] ** 0.5, np.linalg.eigvalsh(cov[:2, :2])[-1] ** 0.5, cov[2, 2] ** 0.5 / 2, by_focal * (cov[2, 2] / 2) ** 0.5]
                out.append(row)
            yield pd.DataFrame(out, columns=[key, *names])

    return fields.mapInPandas(run, ", ".join([f"{key} {kind}", *(f"{n} double" for n in names)]))


#: Poses whose derivatives are held at once.
ROWS_AT_ONCE = 8192


def _cross(a, b) -> np.ndarray:
    return np.stack([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])


def _hat(a: np.ndarray) -> np.ndarray:
    """Cross product matrices (3, 3, ...) of (3, ...)."""
    o = np.zeros_like(a[0])
    return np.array([[o, -a[2], a[1]], [a[2], o, -a[0]], [-a[1], a[0], o]])


def _turn(q: np.ndarray) -> np.ndarray:
    """Rotation matrices (3, 3, ...) of quaternions (4, ...)."""
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def _around(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of q -> a q b."""
    (x, y, z, w), (u, v, s, r) = a, b
    return np.array([[w, -z, y, x], [z, w, -x, y], [-y, x, w, z], [-x, -y, -z, w]]) @ np.array([[r, s, -v, u], [-s, r, u, v], [v, -u, r, s], [-u, -v, -s, r]])


def _both_sides_sums(x: np.ndarray, turns: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, H: np.ndarray | None = None, g: np.ndarray | None = None) -> float:
    """The sum of squares of e = log((left x right)^-1 y), x and y (7, n), turns of x; adds the normal matrix and gradient to H and g.

    The unknowns are steps l, r of left exp(l) and exp(r) right. With M = left x right the pose M becomes
    M exp(Ad(right^-1) (r + Ad(x^-1) l)), so e loses K Ad(right^-1) (r + Ad(x^-1) l), where K is the inverse
    left Jacobian [[A, B], [0, A]] of e: B is the derivative of A(phi) in the direction of rho.
    """
    Rl, Rr = _turn(left[3:]), _turn(right[3:])
    mx, my, mz, mw = _around(left[3:], right[3:]) @ x[3:]
    tx, ty, tz, tw = y[3:]
    # conj(M) y
    q = np.stack([mw * tx - mx * tw - my * tz + mz * ty, mw * ty + mx * tz - my * tw - mz * tx, mw * tz - mx * ty + my * tx - mz * tw])
    w = mw * tw + mx * tx + my * ty + mz * tz
    far = y[:3] - left[:3, None] - Rl @ (np.einsum("ijn,j->in", turns, right[:3]) + x[:3])
    half = 2 * _cross(far, (mx, my, mz))
    t = far + mw * half + _cross(half, (mx, my, mz))
    q, w = np.where(w < 0, -q, q), np.abs(w)
    n = np.sqrt((q * q).sum(0))
    phi = q * np.where(n < 1e-9, 2.0, 2 * np.arctan2(n, w) / np.maximum(n, 1e-30))
    th2 = (phi * phi).sum(0)
    small, wide = th2 < 1e-2, np.maximum(th2, 1e-2)
    th = np.sqrt(wide) / 2
    sine = np.sin(th)
    a, b = th * np.cos(th) / sine, (th / sine) ** 2
    c = np.where(small, 1 / 12 + th2 / 720 + th2**2 / 30240, (1 - a) / wide)
    one = _cross(phi, t)
    rho = t - one / 2 + c * _cross(phi, one)
    e = np.concatenate([rho, phi])
    if H is None:
        return float((e * e).sum())
    dc = np.where(small, 1 / 720 + th2 / 15120 + th2**2 / 403200, ((a + b) / 2 - 1) / wide**2)
    s, cross = (phi * rho).sum(0), phi[:, None] * rho
    square = phi[:, None] * phi
    A = c * square - _hat(phi / 2)
    B = c * (cross + cross.transpose(1, 0, 2)) + 2 * dc * s * square - _hat(rho / 2)
    for k in range(3):
        A[k, k] += 1 - c * th2
        B[k, k] -= 2 * s * (c + dc * th2)
    # Ad of an inverse pose is [[R', -R' hat(t)], [0, R']].
    A1 = Rr @ A
    B1 = Rr @ B - (Rr.T @ _hat(right[:3])).T @ A
    J = np.zeros((12, 6, x.shape[1]))
    J[:3, :3] = J[3:6, 3:] = np.einsum("ijn,kjn->kin", A1, turns)
    J[3:6, :3] = np.einsum("ijn,kjn->kin", B1, turns) - _cross(J[:3, :3], x[:3, None])
    J[6:9, :3] = J[9:, 3:] = A1.transpose(1, 0, 2)
    J[9:, :3] = B1.transpose(1, 0, 2)
    J = J.reshape(12, -1)
    H += J @ J.T
    g += J @ e.ravel()
    return float((e * e).sum())


def fit_both_sides(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(left, right, mean squared error) of poses (n, 7) by damped Gauss-Newton steps from the identity on."""
    n = len(x)
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    turns = _turn(x[3:])

    def total(left, right, *sums):
        parts = (slice(k, k + ROWS_AT_ONCE) for k in range(0, n, ROWS_AT_ONCE))
        return sum(_both_sides_sums(x[:, p], turns[..., p], y[:, p], left, right, *sums) for p in parts) / n

    left = right = np.array([0, 0, 0, 0, 0, 0, 1.0])
    lam, moved = 1e-3, True
    for _ in range(steps):
        if moved:
            H, g = np.zeros((12, 12)), np.zeros(12)
            now = total(left, right, H, g)
        step = np.linalg.lstsq(H + lam * np.diag(np.maximum(H.diagonal(), 1e-6 * n)), g, rcond=None)[0]
        by = pose_exp(step.reshape(2, 6))
        l, r = pose_mul(np.stack([left, by[1]]), np.stack([by[0], right]))
        l[3:] /= np.linalg.norm(l[3:])
        r[3:] /= np.linalg.norm(r[3:])
        new = total(l, r)
        moved = new < now
        if moved:
            left, right, now = l, r, new
        if np.abs(step).max() < 1e-8:
            break
        lam = float(np.clip(lam * (0.1 if moved else 10.0), 1e-9, 1e4))
    return left, right, now


def align_both_sides(rows: DataFrame, key: list[str], source: list[str], target: list[str]) -> DataFrame:
    """key, left and right transforms (l0 .. l6, r0 .. r6: place, quaternion) with left * source * right close to the targets, and the mean squared error.

    Least squares of the logarithm of what is left of each pose, from the identity on. One task takes a
    key's trajectory, whose length the caller bounds. source, target: px, py, pz, qx, qy, qz, qw. Poses
    with nulls take no part; a key without others is left out.
    """
    kinds = dict(rows.dtypes)
    names = [*(f"l{i}" for i in range(7)), *(f"r{i}" for i in range(7)), "error"]

    def solve(p: pa.Table) -> pa.Table:
        # Nulls are told here: as a filter it would repeat the expressions of all poses in each of its terms.
        x, y = (np.stack([p.column(c).to_numpy() for c in side], 1).astype(float) for side in (source, target))
        whole = ~(np.isnan(x).any(1) | np.isnan(y).any(1))
        out = p.select(key).slice(0, int(whole.any()))
        left, right, error = fit_both_sides(x[whole], y[whole]) if whole.any() else (np.zeros(7), np.zeros(7), 0.0)
        for name, v in zip(names, [*left, *right, error]):
            out = out.append_column(name, pa.array([v] * out.num_rows, pa.float64()))
        return out

    return rows.select(*key, *source, *target).groupBy(*key).applyInArrow(solve, ", ".join([*(f"{k} {kinds[k]}" for k in key), *(f"{n} double" for n in names)]))
