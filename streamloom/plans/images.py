"""Queries of image sizes, colours, marks, track targets and steps of a solver."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cameras as cam
from ..functions import geometry as geo
from ..operators import images, solver
from .base import GRID, SIZE, cells, query, rounded
from .geometry import LINE, QSQL, lines, named

PART = "SELECT p_partkey, p_size * 13 + 100 AS h, p_partkey % 700 + 90 AS w FROM part"


def sizes(read):
    return read("part").select("p_partkey", (F.col("p_size") * 13 + 100).alias("h"), (F.col("p_partkey") % 700 + 90).alias("w"))


@query(f"""WITH s AS ({PART}), a AS (SELECT *, (32 - w % 32) % 32 AS pw, (32 - h % 32) % 32 AS ph, -(w % 8) AS qw, -(h % 8) AS qh FROM s)
SELECT p_partkey, CAST(floor(pw / 2) AS BIGINT) AS l, CAST(pw - floor(pw / 2) AS BIGINT) AS r, CAST(floor(ph / 2) AS BIGINT) AS t, CAST(ph - floor(ph / 2) AS BIGINT) AS b,
CAST(floor(qw / 2) AS BIGINT) AS cl, CAST(qw - floor(qw / 2) AS BIGINT) AS cr, CAST(floor(qh / 2) AS BIGINT) AS ct, CAST(qh - floor(qh / 2) AS BIGINT) AS cb FROM a""")
def fit_margins(read):
    h, w = F.col("h"), F.col("w")
    pad, cut = images.fit_margins(h, w, 32), images.fit_margins(h, w, 8, crop=True)
    return sizes(read).select("p_partkey", *(c.cast("long").alias(n) for n, c in zip("l r t b cl cr ct cb".split(), (*pad, *cut))))


@query(f"""WITH s AS ({PART}), k AS (SELECT *, 504 / CAST(greatest(h, w) AS DOUBLE) AS k FROM s), f AS (SELECT *, greatest(round_even(h * k, 0), 1) AS h1, greatest(round_even(w * k, 0), 1) AS w1 FROM k),
d AS (SELECT *, floor(h1 / 14) * 14 AS hd, floor(w1 / 14) * 14 AS wd FROM f),
e AS (SELECT *, greatest(CASE WHEN hd + 14 - h1 <= h1 - hd THEN hd + 14 ELSE hd END, 1) AS h2, greatest(CASE WHEN wd + 14 - w1 <= w1 - wd THEN wd + 14 ELSE wd END, 1) AS w2 FROM d)
SELECT p_partkey, CAST(h2 AS BIGINT) AS height, CAST(w2 AS BIGINT) AS width, round(400.0 * w2 / w, 6)::DOUBLE AS fx, round(h2 / 2, 6)::DOUBLE AS cy, CAST(hd AS BIGINT) AS cut_height, round(w / 2.0 * w1 / w - floor((w1 - wd) / 2), 6)::DOUBLE AS cut_cx FROM e""")
def model_sizes(read):
    h, w = F.col("h"), F.col("w")
    k = (F.lit(400.0), F.lit(400.0), w / 2, h / 2)
    height, width, fit = images.process_size(h, w, k)
    cut_height, _, cut = images.process_size(h, w, k, method="upper_bound_crop")
    return rounded(sizes(read).select("p_partkey", height.cast("long").alias("height"), width.cast("long").alias("width"), fit[0].alias("fx"), fit[3].alias("cy"), cut_height.cast("long").alias("cut_height"), cut[2].alias("cut_cx")))


@query(f"""WITH s AS ({PART}), b AS (SELECT *, p_partkey % 7 AS batch FROM s), m AS (SELECT batch, min(h) AS mh, min(w) AS mw FROM b GROUP BY 1)
SELECT p_partkey, CAST(mh AS BIGINT) AS height, CAST(mw AS BIGINT) AS width, (w / 2.0 - floor((w - mw) / 2))::DOUBLE AS cx, (h / 2.0 - floor((h - mh) / 2))::DOUBLE AS cy FROM b JOIN m USING (batch)""")
def common_crop(read):
    s = sizes(read).select("p_partkey", (F.col("p_partkey") % 7).alias("batch"), F.col("h").cast("long").alias("height"), F.col("w").cast("long").alias("width"), (F.col("w") / 2).alias("cx"), (F.col("h") / 2).alias("cy"))
    return images.common_crop(s, ["batch"]).drop("batch").select("p_partkey", "height", "width", "cx", "cy")


@query(f"""WITH s AS ({PART}) SELECT p_partkey, CASE WHEN w >= h THEN 320 ELSE CAST(trunc(320 / (w / h)) AS INTEGER) END AS height, CASE WHEN w >= h THEN CAST(trunc(320 * (w / h)) AS INTEGER) ELSE 320 END AS width,
CASE WHEN w < h THEN 640 ELSE CAST(trunc(640 / (w / h)) AS INTEGER) END AS long_height FROM s""")
def calibration_sizes(read):
    h, w = images.calibration_size(F.col("h"), F.col("w"))
    tall, _ = images.calibration_size(F.col("h"), F.col("w"), 640, "long")
    return sizes(read).select("p_partkey", h.alias("height"), w.alias("width"), tall.alias("long_height"))


@query(f"""WITH {GRID} SELECT vec_id, v, u, (v + u) % 4 IN (1, 3) AS sky FROM g""")
def sky_cells(read):
    phrases = F.create_map(*(F.lit(x) for x in (0, "car", 1, "sky", 2, "skyline", 3, "sky")))
    return cells(read).select("vec_id", "v", "u", images.sky((F.col("v") + F.col("u")) % 4, phrases).alias("sky"))


@query(f"""WITH {QSQL} SELECT {LINE}, CAST(floor(t1 / 10 * 255) AS INTEGER) AS red, round(1 - 2 * (qy * qy + qz * qz), 5) AS m00, round(2 * (qx * qy + qz * qw), 5) AS m01,
round(-((1 - 2 * (qy * qy + qz * qz)) * t0 + 2 * (qx * qy + qz * qw) * t1 + 2 * (qx * qz - qy * qw) * t2), 5) AS m03, 500.0::DOUBLE AS fx FROM e""")
def model_inputs(read):
    li, t, phi = lines(read)
    li, q = geo.staged(li, "q", geo.so3_exp(phi))
    c = F.col("t1") / 10
    x = li.withColumn("m", images.model_input((c, c, c), geo.SE3(t, q), (F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0))))
    m = F.col("m.w2c")
    return rounded(x.select("l_orderkey", "l_linenumber", F.col("m.rgb")[0].alias("red"), m[0][0].alias("m00"), m[0][1].alias("m01"), m[0][3].alias("m03"), F.col("m.k")[0][0].alias("fx")), 5)


def _ramp(middle: int) -> str:
    return f"CAST(greatest(0, least(255, round_even(382.5 - abs(4.0 * l - {middle}), 0))) AS INTEGER)"


@query(f"""WITH {GRID}, r AS (SELECT vec_id, min(x) AS lo, max(x) AS hi FROM g GROUP BY 1), d AS (SELECT vec_id, v, u, CAST(floor((x - lo) / (hi - lo) * 255) AS INTEGER) AS l FROM g JOIN r USING (vec_id))
SELECT vec_id, v, u, {_ramp(765)} AS red, {_ramp(510)} AS green, {_ramp(255)} AS blue FROM d""")
def depth_colours(read):
    c = cells(read)
    span = c.groupBy("vec_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = c.join(span, "vec_id").withColumn("c", images.jet(images.depth_level(F.col("value"), None, (F.col("lo"), F.col("hi")))))
    return x.select("vec_id", "v", "u", *(F.col("c")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))))


@query(f"""SELECT p_partkey, c[1] AS red, c[2] AS green, c[3] AS blue FROM (SELECT p_partkey, ({images.palette()})[CAST(p_size % 256 + 1 AS INTEGER)] AS c FROM part)""")
def instance_colours(read):
    x = read("part").select("p_partkey", images.instance_colour(F.col("p_size") % 256).alias("c"))
    return x.select("p_partkey", *(F.col("c")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))))


@query("""WITH m AS (SELECT l_suppkey AS image, l_linenumber AS seq, l_orderkey % 8 AS v, l_partkey % 8 AS u FROM lineitem WHERE l_linenumber <> 4), n AS (SELECT image, seq, row_number() OVER (PARTITION BY image ORDER BY seq) AS object FROM (SELECT DISTINCT image, seq FROM m)),
t AS (SELECT image, v, u, max(seq) AS seq FROM m GROUP BY 1, 2, 3) SELECT image, v, u, CAST(object AS INTEGER) AS object FROM t JOIN n USING (image, seq)""")
def painted_masks(read):
    """Masks of line number 4 have a box that is too wide."""
    m = read("lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_linenumber").alias("seq"), (F.col("l_orderkey") % 8).alias("v"), (F.col("l_partkey") % 8).alias("u"))
    o = F.lit(0.0)
    return images.painted_masks(m, ["image"], [o, o, F.when(F.col("seq") == 4, 9.0).otherwise(3.0), F.lit(8.0)], 64.0, share=0.9)


@query("""WITH s AS (SELECT l_suppkey AS image, l_orderkey * 8 + l_linenumber AS mark, l_orderkey % 30 AS x0, l_partkey % 20 AS y0, l_partkey % 30 AS x1, l_orderkey % 20 AS y1 FROM lineitem), n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM s),
t AS (SELECT *, unnest(range(n + 1)) AS t FROM n), c AS (SELECT image, mark, CAST(x0 + CASE WHEN n > 0 THEN round(t * (x1 - x0) / n::DOUBLE) ELSE 0 END AS INTEGER) AS u, CAST(y0 + CASE WHEN n > 0 THEN round(t * (y1 - y0) / n::DOUBLE) ELSE 0 END AS INTEGER) AS v FROM t)
SELECT image, v, u, max(mark) AS mark FROM c WHERE v BETWEEN 0 AND 15 AND u BETWEEN 0 AND 23 GROUP BY 1, 2, 3""")
def line_marks(read):
    s = read("lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mark"), (F.col("l_orderkey") % 30).alias("x0"), (F.col("l_partkey") % 20).alias("y0"), (F.col("l_partkey") % 30).alias("x1"), (F.col("l_orderkey") % 20).alias("y1"))
    return images.lines_raster(s, ["image"], "mark", 16, 24)


@query(f"""WITH {GRID}, k AS (SELECT t, j, greatest(0, 1 - abs(j + 0.5 - 8 / 3.0::DOUBLE * (t + 0.5)) / (8 / 3.0::DOUBLE)) AS k FROM (SELECT unnest(range(3)) AS t), (SELECT unnest(range(8)) AS j)),
w AS (SELECT t, j, k / sum(k) OVER (PARTITION BY t) AS k FROM k) SELECT vec_id, CAST(a.t AS INTEGER) AS v, CAST(b.t AS INTEGER) AS u, round(sum(x * a.k * b.k), 6) AS value FROM g JOIN w a ON a.j = g.v JOIN w b ON b.j = g.u GROUP BY 1, 2, 3""")
def resize_antialiased(read):
    return rounded(images.resize_antialiased(cells(read), ["vec_id"], SIZE, SIZE, 3, 3))


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS total FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(l_orderkey || '-' || l_linenumber)) AS k FROM lineitem) WHERE k <= 1000 GROUP BY 1""")
def quantile_sample(read):
    s = images.quantile_sample(read("lineitem"), ["l_returnflag"], F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")), 1000)
    return rounded(s.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total")), 4)


@query("""WITH o AS (SELECT l_suppkey % 3 AS view_idx, l_linenumber AS frame_idx, l_orderkey AS kp_id, (l_partkey % 64) + 0.25 AS u, (l_suppkey * 7 + l_linenumber) % 48 + 0.5 AS v FROM lineitem),
m AS (SELECT a.view_idx, a.frame_idx AS i, a.u / 8 - 0.5 AS fx, a.v / 8 - 0.5 AS fy, (b.u - a.u) / 8 AS dx, (b.v - a.v) / 8 AS dy FROM o a JOIN o b ON a.view_idx = b.view_idx AND a.kp_id = b.kp_id AND b.frame_idx = a.frame_idx + 1),
c AS (SELECT *, CAST(floor(fx) + p AS INTEGER) AS cu, CAST(floor(fy) + q AS INTEGER) AS cv, (CASE WHEN p = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE WHEN q = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) AS k FROM m, (SELECT unnest(range(2)) AS p), (SELECT unnest(range(2)) AS q)),
s AS (SELECT i * 10 + view_idx AS edge, cv, cu, sum(k) AS k, sum(k * dx) / nullif(sum(k), 0) AS x, sum(k * dy) / nullif(sum(k), 0) AS y FROM c WHERE cu BETWEEN 0 AND 7 AND cv BETWEEN 0 AND 5 GROUP BY 1, 2, 3)
SELECT edge, cv AS v, cu AS u, round(cu + CASE WHEN k >= 0.1 THEN x ELSE 0 END, 6)::DOUBLE AS x, round(cv + CASE WHEN k >= 0.1 THEN y ELSE 0 END, 6)::DOUBLE AS y, round(CASE WHEN k >= 0.1 THEN k ELSE 0 END, 6)::DOUBLE AS weight FROM s""")
def track_targets(read):
    """Line numbers of an order play the frames that see a keypoint."""
    li = read("lineitem")
    o = li.select((F.col("l_suppkey") % 3).alias("view_idx"), F.col("l_linenumber").alias("frame_idx"), F.col("l_orderkey").alias("kp_id"), (F.col("l_partkey") % 64 + 0.25).alias("u"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 48 + 0.5).alias("v"))
    edges = li.sparkSession.range(1, 7).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.explode(F.array(*map(F.lit, range(3)))).alias("view_idx"))
    edges = edges.withColumn("edge", F.col("i") * 10 + F.col("view_idx"))
    return rounded(images.track_targets(edges, o, (48, 64), (6, 8)))


@query(f"""WITH {GRID} SELECT vec_id, CAST(v // 4 AS INTEGER) AS v, CAST(u // 4 AS INTEGER) AS u, round(CASE WHEN x > 0 THEN 1 / x ELSE x END * 1.25, 4) AS disparity FROM g WHERE v % 4 = 1 AND u % 4 = 1""")
def prior_disparity(read):
    p = images.prior_disparity(cells(read), 4)
    return rounded(p.select("vec_id", "v", "u", images.rescaled_prior(F.col("value"), F.lit(500.0), F.lit(400.0)).alias("disparity")), 4)


@query("""SELECT l_orderkey, l_linenumber, round(least(10, greatest(0.001, l_tax * 100 - 3 + l_quantity / 8)), 6) AS track, round(l_tax + CASE WHEN l_quantity > 10 THEN 0 ELSE l_quantity END, 6) AS dense,
round(500 + l_quantity, 6)::DOUBLE AS fx, 320.0::DOUBLE AS cx, round(0.1 + 0.01 * l_discount, 6)::DOUBLE AS k1 FROM lineitem""")
def retractions(read):
    q = F.col("l_quantity").cast("double")
    k = geo.retract_intrinsics(F.array(F.lit(500.0), F.lit(510.0), F.lit(320.0), F.lit(240.0), F.lit(0.1)), F.array(q, F.col("l_discount").cast("double")))
    li = read("lineitem").withColumn("k", k)
    return rounded(li.select("l_orderkey", "l_linenumber", geo.retract_track_disparity(F.col("l_tax") * 100 - 3, q / 8).alias("track"), geo.retract_disparity(F.col("l_tax"), q).alias("dense"), F.col("k")[0].alias("fx"), F.col("k")[2].alias("cx"), F.col("k")[4].alias("k1")))


@query(f"""WITH {QSQL}, r AS (SELECT *, 1 - 2 * (qy * qy + qz * qz) AS r00, 2 * (qx * qy - qz * qw) AS r01, 2 * (qx * qz + qy * qw) AS r02 FROM e)
SELECT {LINE}, round(1 + 2 * (t0 + 0.1 * r00 + 0.2 * r01 + 0.3 * r02), 5) AS x, round(r00 * t0 + r01 * t1 + r02 * t2, 5) AS turned_x, round(qw, 5) AS qw FROM r""")
def rig_of_translations(read):
    """A transform of scale 2 before, an arm of (0.1, 0.2, 0.3) after each pose; and rotation-only steps."""
    li, t, phi = lines(read)
    li, q = geo.staged(li, "q", geo.so3_exp(phi))
    pose = geo.SE3(t, q)
    moved = geo.sim3_apply_rig(geo.Sim3(geo.vec(1.0, 0.0, 0.0), geo.identity_quat(), F.lit(2.0)), pose, geo.vec(0.1, 0.2, 0.3))
    turned = geo.retract_rotation(phi, geo.SE3(t, geo.identity_quat()))
    return rounded(li.select("l_orderkey", "l_linenumber", moved.t.x.alias("x"), turned.t.x.alias("turned_x"), moved.q.w.alias("qw")), 5)


@query(f"""WITH {GRID}, p AS (SELECT vec_id, v, u, (u - 3.5) AS x, (v - 3.5) AS y, 4 + x AS z, (v + u) % 4 AS kind FROM g), d AS (SELECT *, z + 0.5 * sqrt(x * x + y * y + z * z) AS d, sqrt(x * x + y * y + z * z) AS n FROM p)
SELECT vec_id, v, u, round(CASE kind WHEN 0 THEN 256 * x / z + 256 WHEN 1 THEN 256 * x / d + 256 WHEN 2 THEN atan2(x, z) / (2 * pi()) + 0.5 END, 5) AS px, round(CASE kind WHEN 0 THEN 256 * y / z + 128 WHEN 1 THEN 256 * y / d + 128 WHEN 2 THEN acos(-y / n) / pi() END, 5) AS py FROM d""")
def mixed_cameras(read):
    """Each cell by its own camera type; one type is unknown."""
    kind = F.element_at(F.array(*map(F.lit, ("PINHOLE", "MEI", "PANORAMA", "NONE"))), ((F.col("v") + F.col("u")) % 4 + 1).cast("int"))
    p = geo.Vec(F.col("u") - 3.5, F.col("v") - 3.5, 4 + F.col("value"))
    u, v = cam.project_any(kind, p, [*map(F.lit, cam.PANORAMA_PINHOLE), F.lit(0.5)])
    return rounded(cells(read).select("vec_id", "v", "u", u.alias("px"), v.alias("py")), 5)


@query()
def random_poses(read):
    li = read("lineitem").select("l_orderkey", "l_linenumber")
    li, x = geo.staged(li, "x", geo.random_se3(0.1, 7, "l_orderkey", "l_linenumber"))
    return li.select("l_orderkey", "l_linenumber", *named("tx ty tz qx qy qz qw", (*x.t, *x.q)))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 640 AS u, l_suppkey % 480 AS v, 0.1 + l_discount AS d, 0.5 * l_linenumber - 0.3 AS tx, l_tax AS tz FROM lineitem), q AS (SELECT *, (u - 320) / 400.0 + tx * d AS x, (v - 240) / 400.0 AS y, 1 + tz * d AS z FROM p)
SELECT l_orderkey, l_linenumber, round(400 * x / z + 320 - u, 5)::DOUBLE AS rx, round(400 * y / z + 240 - v, 5)::DOUBLE AS ry, round(400 * tx / z - 400 * x / (z * z) * tz, 5)::DOUBLE AS jx, z > 0.1 AS valid FROM q""")
def track_residuals(read):
    """Two frames half a unit a line apart, the second camera 0.3 to the side on its rig."""
    li = read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 640).cast("double").alias("u"), (F.col("l_suppkey") % 480).cast("double").alias("v"), (0.1 + F.col("l_discount")).cast("double").alias("d"), (0.5 * F.col("l_linenumber")).cast("double").alias("tx"), F.col("l_tax").cast("double").alias("tz"))
    at = lambda x, z: geo.SE3(geo.Vec(x, F.lit(0.0), z), geo.identity_quat())
    o = F.lit(0.0)
    rx, ry, jx, _, valid = cam.track_residual(F.col("u"), F.col("v"), F.col("d"), at(o, o), at(F.col("tx"), F.col("tz")), at(o, o), at(F.lit(0.3), o), [*map(F.lit, (400.0, 400.0, 320.0, 240.0))], (F.col("u"), F.col("v")))
    return rounded(li.select("l_orderkey", "l_linenumber", rx.alias("rx"), ry.alias("ry"), jx.alias("jx"), valid.alias("valid")), 5)


@query("""SELECT l_suppkey, 0.3::DOUBLE AS l0, -0.1::DOUBLE AS l1, 0.1::DOUBLE AS r2, 1.0::DOUBLE AS lw, 0.0::DOUBLE AS error FROM lineitem GROUP BY 1""")
def both_sides_alignment(read):
    """Each supplier's poses moved on the left by (0.3, -0.1, 0) and on the right by (0, 0, 0.1): both are found again."""
    li, t, phi = lines(read, "l_suppkey")
    li, q = geo.staged(li, "q", geo.so3_exp(phi))
    # The shuffle stands between the quaternion and its uses, so that it is computed once.
    li = li.drop("l_orderkey", "l_linenumber").repartition("l_suppkey")
    x = geo.SE3(t, q)
    y = geo.SE3(geo.add(geo.add(t, geo.rotate(q, geo.vec(0.0, 0.0, 0.1))), geo.vec(0.3, -0.1, 0.0)), q)
    names = "px py pz qx qy qz qw".split()
    li = li.select("l_suppkey", *(c.alias(f"a{n}") for n, c in zip(names, (*x.t, *x.q))), *(c.alias(f"b{n}") for n, c in zip(names, (*y.t, *y.q))))
    fit = solver.align_both_sides(li, ["l_suppkey"], [f"a{n}" for n in names], [f"b{n}" for n in names])
    return rounded(fit.select("l_suppkey", "l0", "l1", "r2", F.col("l6").alias("lw"), "error"), 4)
