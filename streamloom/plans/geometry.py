"""Queries of cameras and rigid transforms, over rows whose numbers play tangents and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cameras as cam
from ..functions import geometry as geo
from ..operators import align, joins
from ..sources import colmap
from .base import GRID, cells, query, rounded

#: Tangents of each line item: columns and the same in SQL.
TAU = ("l_quantity / 50", "l_discount * 10", "l_tax * 10")
PHI = ("l_quantity / 40", "l_discount * 5 - 0.2", "l_tax * 8 - 0.3")
LINE = "l_orderkey, l_linenumber"


def lines(read, *more):
    li = read("lineitem").select("l_orderkey", "l_linenumber", *more, *(F.expr(e).alias(f"t{i}") for i, e in enumerate(TAU)), *(F.expr(e).alias(f"p{i}") for i, e in enumerate(PHI)))
    return li, geo.vec("t0", "t1", "t2"), geo.vec("p0", "p1", "p2")


def named(names: str, values) -> list:
    return [v.alias(n) for n, v in zip(names.split(), values)]


QSQL = f"""q AS (SELECT {LINE}, {TAU[0]} AS t0, {TAU[1]} AS t1, {TAU[2]} AS t2, {PHI[0]} AS p0, {PHI[1]} AS p1, {PHI[2]} AS p2, sqrt(({PHI[0]}) ** 2 + ({PHI[1]}) ** 2 + ({PHI[2]}) ** 2) AS th FROM lineitem),
e AS (SELECT *, p0 * sin(th / 2) / th AS qx, p1 * sin(th / 2) / th AS qy, p2 * sin(th / 2) / th AS qz, cos(th / 2) AS qw FROM q)"""


@query(f"WITH {QSQL} SELECT {LINE}, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz, round(qw, 6) AS qw FROM e")
def so3_exp(read):
    li, _, phi = lines(read)
    return rounded(li.select("l_orderkey", "l_linenumber", *named("qx qy qz qw", geo.so3_exp(phi))))


@query(f"WITH {QSQL} SELECT {LINE}, round(t0, 5) AS t0, round(t1, 5) AS t1, round(t2, 5) AS t2, round(p0, 5) AS p0, round(p1, 5) AS p1, round(p2, 5) AS p2 FROM q")
def se3_exp_log(read):
    """log(exp(x)) is x."""
    li, tau, phi = lines(read)
    li, x = geo.staged(li, "x", geo.se3_exp(tau, phi))
    li, r = geo.staged(li, "r", (geo.so3_log(x.q),))
    t, p = geo.so3_left_jacobian_inverse(r[0], x.t), r[0]
    return rounded(li.select("l_orderkey", "l_linenumber", *named("t0 t1 t2 p0 p1 p2", (*t, *p))), 5)


@query(f"WITH {QSQL} SELECT {LINE}, round(t0, 5) AS t0, round(t1, 5) AS t1, round(t2, 5) AS t2, round(p0, 5) AS p0, round(p1, 5) AS p1, round(p2, 5) AS p2, round(t0 - 0.4, 5) AS s FROM q")
def sim3_exp_log(read):
    li, tau, phi = lines(read)
    li, x = geo.staged(li, "x", geo.sim3_exp(tau, phi, F.col("t0") - 0.4))
    li, w = geo.staged(li, "w", (geo.so3_log(x.q), F.log(x.s)))
    li, w = geo.staged(li, "m", (w[0], w[1], *map(tuple, geo.sim3_jacobian(w[0], w[1]))))
    p, s, m = w[0], w[1], [list(r) for r in w[2:]]
    t = geo.solve3(m, x.t)
    return rounded(li.select("l_orderkey", "l_linenumber", *named("t0 t1 t2 p0 p1 p2 s", (*t, *p, s))), 5)


@query(f"""WITH {QSQL} SELECT {LINE}, round(1 - 2 * (qy * qy + qz * qz), 6) AS m00, round(2 * (qx * qy - qz * qw), 6) AS m01, round(2 * (qx * qz + qy * qw), 6) AS m02, round(2 * (qx * qy + qz * qw), 6) AS m10, round(2 * (qy * qz - qx * qw), 6) AS m12, round(1 - 2 * (qx * qx + qy * qy), 6) AS m22 FROM e""")
def quat_matrix(read):
    li, _, phi = lines(read)
    li, q = geo.staged(li, "q", geo.so3_exp(phi))
    m = geo.quat_to_matrix(q)
    return rounded(li.select("l_orderkey", "l_linenumber", *named("m00 m01 m02 m10 m12 m22", (m[0][0], m[0][1], m[0][2], m[1][0], m[1][2], m[2][2]))))


@query(f"""WITH {QSQL} SELECT {LINE}, round(qx * s, 6) AS qx, round(qy * s, 6) AS qy, round(qz * s, 6) AS qz, round(qw * s, 6) AS qw FROM (SELECT *, CASE WHEN qw < 0 THEN -1 ELSE 1 END AS s FROM e)""")
def matrix_quat(read):
    li, _, phi = lines(read)
    li, q = geo.staged(li, "q", geo.so3_exp(phi))
    li, m = geo.staged(li, "m", tuple(map(tuple, geo.quat_to_matrix(q))))
    li, q = geo.staged(li, "r", geo.matrix_to_quat(m))
    q = geo.standardise_quat(q)
    return rounded(li.select("l_orderkey", "l_linenumber", *named("qx qy qz qw", q)))


@query(f"""WITH {QSQL}, r AS (SELECT {LINE}, t0, t1, t2, qx, qy, qz, qw, 2 * (qy * 3 - qz * 2) AS ux, 2 * (qz * 1 - qx * 3) AS uy, 2 * (qx * 2 - qy * 1) AS uz FROM e)
SELECT {LINE}, round(1 + qw * ux + qy * uz - qz * uy + t0, 6) AS x, round(2 + qw * uy + qz * ux - qx * uz + t1, 6) AS y, round(3 + qw * uz + qx * uy - qy * ux + t2, 6) AS z FROM r""")
def se3_act(read):
    li, tau, phi = lines(read)
    li, q = geo.staged(li, "q", geo.so3_exp(phi))
    p = geo.se3_act(geo.SE3(tau, q), geo.vec(1.0, 2.0, 3.0))
    return rounded(li.select("l_orderkey", "l_linenumber", *named("x y z", p)))


@query(f"""SELECT {LINE}, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z, CAST(1 AS DOUBLE) AS w FROM lineitem""")
def se3_compose_inverse(read):
    """A pose times its inverse is the identity."""
    li, tau, phi = lines(read)
    li, a = geo.staged(li, "a", geo.se3_exp(tau, phi))
    i = geo.se3_mul(a, geo.se3_inv(a))
    return rounded(li.select("l_orderkey", "l_linenumber", *named("x y z w", (*i.t, F.abs(i.q.w)))))


@query(f"""WITH {QSQL} SELECT {LINE}, CAST(0 AS DOUBLE) AS gap FROM q""")
def se3_adjoint(read):
    """Adjoint and its transpose agree: <Ad a, b> = <a, AdT b>."""
    li, tau, phi = lines(read)
    li, x = geo.staged(li, "x", geo.se3_exp(tau, phi))
    a, b = (geo.vec(1.0, -2.0, 0.5), geo.vec(0.3, 0.2, -1.0)), (geo.vec(0.7, 1.1, -0.4), geo.vec(-0.6, 0.9, 0.1))
    left, right = geo.se3_adj(x, *a), geo.se3_adj_t(x, *b)
    gap = geo.dot(left[0], b[0]) + geo.dot(left[1], b[1]) - geo.dot(a[0], right[0]) - geo.dot(a[1], right[1])
    return rounded(li.select("l_orderkey", "l_linenumber", gap.alias("gap")))


@query(f"""WITH {GRID} SELECT vec_id, v, u, round((u - 4) / 8.0, 6) AS x, round((v - 4) / 8.0, 6) AS y, CAST(1 AS DOUBLE) AS z FROM g""")
def rays_pinhole(read):
    r = cam.pinhole_unproject(F.col("u"), F.col("v"), 8.0, 8.0, 4.0, 4.0)
    return rounded(cells(read).select("vec_id", "v", "u", *named("x y z", r)))


@query(f"""WITH {GRID} SELECT vec_id, v, u, CAST(u AS DOUBLE) AS pu, CAST(v AS DOUBLE) AS pv FROM g""")
def mei_round_trip(read):
    """Projecting an unprojected pixel gives the pixel."""
    k = (8.0, 8.0, 4.0, 4.0, F.lit(0.3))
    p = cam.mei_project(cam.mei_unproject(F.col("u"), F.col("v"), *k), *k)
    return rounded(cells(read).select("vec_id", "v", "u", *named("pu pv", p)), 5)


@query(f"""WITH {GRID}, r AS (SELECT vec_id, v, u, ((u + 0.5) / 8 - 0.5) * 2 * pi() AS a, ((v + 0.5) / 8 - 0.5) * pi() AS b FROM g)
SELECT vec_id, v, u, round(cos(b) * sin(a), 6) AS x, round(sin(b), 6) AS y, round(cos(b) * cos(a), 6) AS z FROM r""")
def rays_panorama(read):
    r = cam.panorama_unproject((F.col("u") + 0.5) / 8, (F.col("v") + 0.5) / 8)
    return rounded(cells(read).select("vec_id", "v", "u", *named("x y z", r)))


@query(f"""WITH {GRID}, p AS (SELECT vec_id, v, u, (u - 3.5) AS x, (v - 3.5) AS y, 2 + x AS z FROM g)
SELECT vec_id, v, u, round(40 * x / CASE WHEN z < 0.1 THEN 1 ELSE z END + 4, 5) AS pu, round(40 * y / CASE WHEN z < 0.1 THEN 1 ELSE z END + 4, 5) AS pv, round(atan2(x, z) / (2 * pi()) + 0.5, 6) AS su, round(acos(-y / sqrt(x * x + y * y + z * z)) / pi(), 6) AS sv FROM p""")
def project_points(read):
    p = geo.Vec(F.col("u") - 3.5, F.col("v") - 3.5, 2 + F.col("value"))
    c = cells(read).select("vec_id", "v", "u", *(F.round(x, 5).alias(n) for n, x in zip(("pu", "pv"), cam.pinhole_project(p, 40.0, 40.0, 4.0, 4.0))), *named("su sv", cam.panorama_project(p)))
    return rounded(c)


@query(f"""WITH {GRID} SELECT vec_id, v, u, CAST(u AS DOUBLE) AS eu, CAST(v AS DOUBLE) AS ev, round((u - 4) / 80.0, 6) AS dx FROM g""")
def distortion_round_trips(read):
    """EUCM and the division model undo themselves."""
    k = (40.0, 40.0, 4.0, 4.0, F.lit(0.6), F.lit(1.1))
    e = cam.eucm_project(cam.eucm_unproject(F.col("u"), F.col("v"), *k), *k)
    x, y = (F.col("u") - 4) / 80.0, (F.col("v") - 4) / 80.0
    d = cam.divisional_distort(*cam.divisional_undistort(x, y, F.lit(-0.2)), F.lit(-0.2))
    return rounded(cells(read).select("vec_id", "v", "u", F.round(e[0], 5).alias("eu"), F.round(e[1], 5).alias("ev"), d[0].alias("dx")))


@query(f"""WITH {QSQL} SELECT {LINE}, round(atan2(t0, t2 + 1), 6) AS theta, round(sqrt(t0 * t0 + t1 * t1 + (t2 + 1) * (t2 + 1)), 6) AS r, round(t0, 6) AS back FROM q""")
def spherical(read):
    li, tau, _ = lines(read)
    p = geo.Vec(tau.x, tau.y, tau.z + 1)
    th, ph, r = cam.euclidean_to_spherical(p)
    return rounded(li.select("l_orderkey", "l_linenumber", th.alias("theta"), r.alias("r"), cam.spherical_to_euclidean(th, ph, r).x.alias("back")))


@query("""SELECT p_partkey, round(2 * atan(p_size / (2.0 * (p_partkey % 50 + 10))), 6) AS fov, round(CAST(p_partkey % 50 + 10 AS DOUBLE), 6) AS focal FROM part""")
def fov_focal(read):
    f = (F.col("p_partkey") % 50 + 10).cast("double")
    fov = cam.focal_to_fov(f, F.col("p_size"))
    return rounded(read("part").select("p_partkey", fov.alias("fov"), cam.fov_to_focal(fov, F.col("p_size")).alias("focal")))


@query("""SELECT s_suppkey, CAST(floor(h * k) AS BIGINT) AS height, CAST(floor(w * k) AS BIGINT) AS width, CAST(floor(h * k) AS BIGINT) % 8 AS bottom, CAST(floor(w * k) AS BIGINT) % 8 AS right_ FROM
(SELECT s_suppkey, h, w, sqrt(196608.0 / (h * w)) AS k FROM (SELECT s_suppkey, 480 + s_suppkey % 7 * 60 AS h, 640 + s_suppkey % 5 * 80 AS w FROM supplier))""")
def standard_resize(read):
    h, w = F.lit(480) + F.col("s_suppkey") % 7 * 60, F.lit(640) + F.col("s_suppkey") % 5 * 80
    r = cam.standard_resize(h, w)
    return read("supplier").select("s_suppkey", *(x.cast("long").alias(n) for n, x in zip(("height", "width", "bottom", "right_"), r)))


@query("""WITH b AS (SELECT p_partkey, CAST(p_partkey % 13 AS DOUBLE) AS a0, CAST(p_partkey % 7 AS DOUBLE) AS a1, p_partkey % 13 + p_size + 1.0 AS a2, p_partkey % 7 + p_size + 2.0 AS a3, 5.0 AS b0, 3.0 AS b1, 25.0 AS b2, 30.0 AS b3 FROM part),
i AS (SELECT p_partkey, greatest(least(a2, b2) - greatest(a0, b0), 0) * greatest(least(a3, b3) - greatest(a1, b1), 0) AS n, (a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) AS s, (greatest(a2, b2) - least(a0, b0)) * (greatest(a3, b3) - least(a1, b1)) AS c FROM b)
SELECT p_partkey, round(n / (s - n + 1e-6), 6) AS iou, round(n / (s - n + 1e-6) - (c - (s - n)) / (c + 1e-6), 6) AS giou FROM i""")
def box_iou(read):
    x, y = (F.col("p_partkey") % 13).cast("double"), (F.col("p_partkey") % 7).cast("double")
    a, b = [x, y, x + F.col("p_size") + 1, y + F.col("p_size") + 2], [F.lit(v) for v in (5.0, 3.0, 25.0, 30.0)]
    return rounded(read("part").select("p_partkey", joins.iou(a, b)[0].alias("iou"), joins.giou(a, b).alias("giou")))


@query("""SELECT p_partkey, p_size + 1.0 AS x0, p_size * 1.5 AS y0, p_size * 3.0 + 1 AS x1, p_size * 2.5 AS y1 FROM part""")
def box_formats(read):
    s = F.col("p_size").cast("double")
    cx = joins.xyxy_to_cxcywh(s + 1, s * 1.5, s * 3 + 1, s * 2.5)
    return read("part").select("p_partkey", *named("x0 y0 x1 y1", joins.cxcywh_to_xyxy(*cx)))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS s0, round(avg(l_discount), 6) AS s1, round(avg(l_tax * l_quantity) , 6) AS c FROM lineitem GROUP BY 1, 2""")
def umeyama_moments(read):
    m = align.moments(read("lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax"], ["l_quantity", "l_discount", "l_tax"])
    return rounded(m.select("l_returnflag", "l_linestatus", F.col("n").cast("long").alias("n"), (F.col("s0") / F.col("n")).alias("s0"), (F.col("s1") / F.col("n")).alias("s1"), (F.col("c20") / F.col("n")).alias("c")))


@query("""SELECT l_returnflag, CAST(2 AS DOUBLE) AS scale, CAST(1 AS DOUBLE) AS t0, CAST(-3 AS DOUBLE) AS t1, CAST(0.5 AS DOUBLE) AS t2, CAST(0 AS DOUBLE) AS r00, CAST(-1 AS DOUBLE) AS r01 FROM lineitem GROUP BY 1""")
def umeyama(read):
    """A known similarity (a quarter turn, twice as large, moved) is found again."""
    li = read("lineitem").select("l_returnflag", "l_quantity", (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"))
    li = li.withColumn("x", -2 * F.col("d") + 1).withColumn("y", 2 * F.col("l_quantity") - 3).withColumn("z", 2 * F.col("t") + 0.5)
    fit = align.align_points(li, ["l_returnflag"], ["l_quantity", "d", "t"], ["x", "y", "z"])
    return rounded(fit.select("l_returnflag", "scale", "t0", "t1", "t2", "r00", "r01"))


@query()
def ransac_umeyama(read):
    li = read("lineitem").select("l_returnflag", "l_quantity", (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"), "l_orderkey")
    wrong = F.when(F.col("l_orderkey") % 9 == 0, 500.0).otherwise(0.0)
    li = li.withColumn("x", -2 * F.col("d") + 1 + wrong).withColumn("y", 2 * F.col("l_quantity") - 3).withColumn("z", 2 * F.col("t") + 0.5)
    return rounded(align.ransac_align(li, ["l_returnflag"], ["l_quantity", "d", "t"], ["x", "y", "z"], 120.0, 3), 4)


@query(f"""WITH {QSQL} SELECT l_orderkey, round(avg(qx * qw), 6) AS xw, round(avg(qw * qw), 6) AS ww FROM e GROUP BY 1""")
def rotation_moments(read):
    li, _, phi = lines(read)
    li, q = geo.staged(li, "q", geo.so3_exp(phi))
    return rounded(li.groupBy("l_orderkey").agg(F.avg(q.x * q.w).alias("xw"), F.avg(q.w * q.w).alias("ww")))


@query()
def rotation_average(read):
    li, _, phi = lines(read)
    return rounded(align.mean_rotation(li.select("l_orderkey", *named("qx qy qz qw", geo.so3_exp(phi))), ["l_orderkey"], ["qx", "qy", "qz", "qw"]))


@query(f"""SELECT vec_id, printf('1 PINHOLE 640 480 %.9f %.9f %.9f %.9f', CAST(500 + vec_id AS DOUBLE), CAST(500 AS DOUBLE), CAST(320 AS DOUBLE), CAST(240 AS DOUBLE)) AS line FROM embeddings""")
def colmap_cameras(read):
    k = F.array(500 + F.col("vec_id"), F.lit(500), F.lit(320), F.lit(240))
    return read("embeddings").select("vec_id", colmap.camera_line(k, 640, 480).alias("line"))


@query("""SELECT vec_id AS frame_idx, CAST(vec_id + 1 AS VARCHAR) || printf(' %.9f %.9f %.9f %.9f %.9f %.9f %.9f', CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), -CAST(vec_id + 1 AS DOUBLE), CAST(-2 AS DOUBLE), CAST(-3 AS DOUBLE)) || ' 1 ' || printf('frame_%06d.jpg', vec_id) || chr(10) AS line FROM embeddings""")
def colmap_images(read):
    one, o = F.lit(1.0), F.lit(0.0)
    pose = F.array(one, o, o, (F.col("vec_id") + 1).cast("double"), o, one, o, F.lit(2.0), o, o, one, F.lit(3.0), o, o, o, one)
    return colmap.image_lines(read("embeddings").select(F.col("vec_id").alias("frame_idx"), pose.alias("pose"))).select("frame_idx", "line")
