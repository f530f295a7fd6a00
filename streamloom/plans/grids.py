"""Queries over 8 x 8 grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import greedy, grids, joins, models, segments
from .base import GRID, SIZE, cells, query, rounded

KEY = ["vec_id"]
DEPTH = "1 + abs(x)"
NEAR = lambda r: f"b.vec_id = a.vec_id AND abs(b.v - a.v) <= {r} AND abs(b.u - a.u) <= {r}"


def depth(read):
    return cells(read, 1 + F.abs(F.col("_x").cast("double")))


@query(f"""WITH {GRID}, d AS (SELECT vec_id, v, u, {DEPTH} AS d FROM g),
r AS (SELECT a.vec_id, a.v, a.u, any_value(a.d) AS d, (max(b.d) - min(b.d)) / (sum(b.d) / 9.0 + 1e-6) < 0.6 AS ok FROM d a JOIN d b ON {NEAR(1)} GROUP BY a.vec_id, a.v, a.u)
SELECT vec_id, count(*) AS points, round(avg((u - 4) / 8.0 * d), 6) AS x, round(avg((v - 4) / 8.0 * d), 6) AS y, round(avg(d), 6) AS z FROM r WHERE ok AND d > 0 GROUP BY 1""")
def unproject_filter_export(read):
    """Unproject a depth grid, keep reliable points, and sum up each grid: the flagship of the catalogue."""
    from ..functions.cameras import pinhole_unproject

    d = grids.reliable_depth(depth(read), KEY, SIZE, SIZE, 1, 0.6).where("reliable")
    ray = pinhole_unproject(F.col("u"), F.col("v"), 8.0, 8.0, 4.0, 4.0)
    d = d.select("vec_id", *((c * F.col("value")).alias(n) for n, c in zip("xyz", ray)))
    return rounded(d.groupBy("vec_id").agg(F.count(F.lit(1)).alias("points"), *(F.avg(n).alias(n) for n in "xyz")))


@query(f"""WITH {GRID} SELECT a.vec_id, a.v, a.u, round(max(b.x), 6) AS value FROM g a JOIN g b ON {NEAR(2)} GROUP BY 1, 2, 3""")
def dilate(read):
    return rounded(grids.dilate(cells(read), KEY, SIZE, SIZE, 2))


@query(f"""WITH {GRID} SELECT a.vec_id, a.v, a.u, round(min(b.x), 6) AS value FROM g a JOIN g b ON {NEAR(2)} GROUP BY 1, 2, 3""")
def erode(read):
    return rounded(grids.erode(cells(read), KEY, SIZE, SIZE, 2))


@query(f"""WITH {GRID}, m AS (SELECT vec_id, v, u, CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END AS x FROM g)
SELECT a.vec_id, a.v, a.u, CAST(CASE WHEN sum(b.x) = 9 THEN 1 ELSE 0 END AS DOUBLE) AS value FROM m a JOIN m b ON {NEAR(1)} GROUP BY 1, 2, 3""")
def erode_binary(read):
    return grids.erode(cells(read, (F.col("_x") > 0).cast("double")), KEY, SIZE, SIZE, 1, zero_padding=True)


@query(f"""WITH {GRID}, o AS (SELECT unnest(range(-1, 2)) AS d), n AS (SELECT a.vec_id, a.v, a.u, least(greatest(a.v + o.d, 0), 7) AS bv, least(greatest(a.u + q.d, 0), 7) AS bu FROM g a, o, o q)
SELECT n.vec_id, n.v, n.u, round(ln(sum(exp(2.0 * g.x))) / 2.0, 6) AS value FROM n JOIN g ON g.vec_id = n.vec_id AND g.v = n.bv AND g.u = n.bu GROUP BY 1, 2, 3""")
def soft_dilate(read):
    return rounded(grids.soft_dilate(cells(read), KEY, SIZE, SIZE, 1, 2.0))


@query(f"""WITH {GRID}, d AS (SELECT vec_id, v, u, {DEPTH} AS d FROM g)
SELECT a.vec_id, a.v, a.u, (max(b.d) - min(b.d)) / (sum(b.d) / 25.0 + 1e-6) < 1.0 AND any_value(a.d) > 0 AS reliable FROM d a JOIN d b ON {NEAR(2)} GROUP BY 1, 2, 3""")
def reliable_mask(read):
    return grids.reliable_depth(depth(read), KEY, SIZE, SIZE, 2, 1.0).select("vec_id", "v", "u", "reliable")


@query(f"""WITH {GRID}, t AS (SELECT CAST(p // 4 AS INTEGER) AS tv, CAST(p % 4 AS INTEGER) AS tu FROM (SELECT unnest(range(16)) AS p))
SELECT vec_id, tv AS v, tu AS u, round(avg(x), 6) AS value FROM g JOIN t ON v // 2 = tv AND u // 2 = tu GROUP BY 1, 2, 3""")
def resize_bilinear(read):
    """Halving: each target lies between four sources."""
    return rounded(grids.resize_bilinear(cells(read), KEY, SIZE, SIZE, 4, 4))


@query(f"""WITH {GRID} SELECT vec_id, CAST(v - 1 AS INTEGER) AS v, CAST(u - 2 AS INTEGER) AS u, round(x, 6) AS value FROM g WHERE v BETWEEN 1 AND 6 AND u BETWEEN 2 AND 4""")
def crop(read):
    return rounded(grids.crop(cells(read), 1, 1, 2, 3, SIZE, SIZE))


@query(f"""WITH {GRID} SELECT vec_id, CAST(v // 2 AS INTEGER) AS v, CAST(u // 2 AS INTEGER) AS u, round(coalesce(min(CASE WHEN x > 0 THEN x END), 0), 6) AS value FROM g GROUP BY 1, 2, 3""")
def block_pool(read):
    return rounded(grids.valid_min_pool(cells(read), KEY, 2))


@query(f"""WITH {GRID}, p AS (SELECT vec_id, u + 0.5 + 0.25 AS x, v + 0.5 + 0.5 AS y, x AS d FROM g), c AS (
SELECT vec_id, CAST(floor(x - 0.5) + dx AS INTEGER) AS u, CAST(floor(y - 0.5) + dy AS INTEGER) AS v, CASE WHEN dx = 0 THEN 1 - (x - 0.5 - floor(x - 0.5)) ELSE x - 0.5 - floor(x - 0.5) END * CASE WHEN dy = 0 THEN 1 - (y - 0.5 - floor(y - 0.5)) ELSE y - 0.5 - floor(y - 0.5) END AS k, d
FROM p, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)) SELECT vec_id, v, u, round(sum(k * d) / sum(k), 6) AS value, round(sum(k), 6) AS weight FROM c WHERE u BETWEEN 0 AND 7 AND v BETWEEN 0 AND 7 GROUP BY 1, 2, 3""")
def bilinear_splat(read):
    p = cells(read).select("vec_id", (F.col("u") + 0.75).alias("x"), (F.col("v") + 1.0).alias("y"), "value")
    return rounded(grids.splat(p, KEY, "x", "y", "value", SIZE, SIZE))


@query(f"""WITH {GRID}, t AS (SELECT vec_id, u * 8 + v AS p, x > 0 AS b, CASE WHEN lag(x > 0) OVER w <> (x > 0) THEN 1 ELSE 0 END AS turn FROM g WINDOW w AS (PARTITION BY vec_id ORDER BY u * 8 + v)),
r AS (SELECT vec_id, s, any_value(b) AS b, count(*) AS n FROM (SELECT *, sum(turn) OVER (PARTITION BY vec_id ORDER BY p) AS s FROM t) GROUP BY 1, 2)
SELECT vec_id, CAST(CASE WHEN arg_min(b, s) THEN 1 ELSE 0 END + count(*) AS INTEGER) AS runs, CAST(coalesce(sum(n) FILTER (WHERE b), 0) AS INTEGER) AS area FROM r GROUP BY 1""")
def rle_encode(read):
    r = grids.rle_encode(cells(read), KEY, F.col("value") > 0, SIZE, SIZE)
    return r.select("vec_id", F.size("counts").alias("runs"), grids.rle_area(F.col("counts")).alias("area"))


@query(f"""WITH {GRID} SELECT vec_id, v, u FROM g WHERE x > 0""")
def rle_decode(read):
    """What is decoded of encoded masks: their set cells."""
    return grids.rle_decode(grids.rle_encode(cells(read), KEY, F.col("value") > 0, SIZE, SIZE), KEY, "counts", SIZE)


@query(f"""WITH {GRID} SELECT vec_id, coalesce(min(u) FILTER (WHERE x > 0.2), 0) AS x0, coalesce(min(v) FILTER (WHERE x > 0.2), 0) AS y0, coalesce(max(u) FILTER (WHERE x > 0.2), 0) AS x1, coalesce(max(v) FILTER (WHERE x > 0.2), 0) AS y1 FROM g GROUP BY 1""")
def mask_to_box(read):
    return grids.mask_boxes(cells(read), KEY, F.col("value") > 0.2)


@query(f"""WITH {GRID} SELECT vec_id, round(count(*) FILTER (WHERE x > 0.05) / CAST(count(*) FILTER (WHERE x > -0.05) AS DOUBLE), 6) AS stability FROM g GROUP BY 1""")
def stability_score(read):
    return rounded(grids.stability(cells(read), KEY, 0.0, 0.05))


@query(f"""WITH {GRID} SELECT vec_id, round(count(*) FILTER (WHERE x > 0 AND x < 0.1) / CAST(greatest(count(*) FILTER (WHERE x > 0 OR x < 0.1), 1) AS DOUBLE), 6) AS iou FROM g GROUP BY 1""")
def mask_iou(read):
    c = cells(read)
    return rounded(grids.mask_iou(c.where("value > 0"), c.where("value < 0.1"), KEY))


@query(f"""WITH {GRID} SELECT vec_id, round(avg(hit), 6) AS coverage FROM (SELECT vec_id, max(CASE WHEN x > 0.15 THEN 1 ELSE 0 END) AS hit FROM g GROUP BY vec_id, v // 2, u // 2) GROUP BY 1""")
def uv_score(read):
    return rounded(segments.coverage(cells(read), KEY, [F.floor(F.col("v") / 2), F.floor(F.col("u") / 2)], F.col("value") > 0.15))


@query(f"""WITH {GRID}, m AS (SELECT a.vec_id, a.v, a.u, any_value(a.x) AS x, max(b.x) AS top FROM g a JOIN g b ON {NEAR(1)} GROUP BY 1, 2, 3), k AS (SELECT vec_id, v, u, x = top AS keep, x FROM m),
s AS (SELECT a.vec_id, a.v, a.u, bool_or(b.keep) AS near, any_value(a.x) AS x, any_value(a.keep) AS keep FROM k a JOIN k b ON {NEAR(1)} GROUP BY 1, 2, 3), y AS (SELECT *, CASE WHEN near THEN 0 ELSE x END AS x2 FROM s),
t AS (SELECT a.vec_id, a.v, a.u, any_value(a.keep) AS keep, any_value(a.near) AS near, any_value(a.x2) AS x2, max(b.x2) AS top FROM y a JOIN y b ON {NEAR(1)} GROUP BY 1, 2, 3)
SELECT vec_id, v, u FROM t WHERE keep OR (x2 = top AND NOT near)""")
def nms_grid(read):
    return grids.local_maxima(cells(read), KEY, SIZE, SIZE, 1, 1).where("keep").select("vec_id", "v", "u")


@query(f"""WITH {GRID} SELECT vec_id, v, u, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, v * 8 + u) AS k FROM g) WHERE k <= 5""")
def topk_keypoints(read):
    c = cells(read).withColumn("at", F.col("v") * SIZE + F.col("u"))
    return greedy.top_k(c, KEY, "value", "at", 5).select("vec_id", "v", "u", "rank")


@query(f"""WITH {GRID}, n AS (SELECT a.vec_id, a.v, a.u, b.x, row_number() OVER (PARTITION BY a.vec_id, a.v, a.u ORDER BY (a.v - b.v) * (a.v - b.v) + (a.u - b.u) * (a.u - b.u), b.v * 65536 + b.u) AS k
FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.x < -0.15 AND b.x >= -0.15), f AS (SELECT vec_id, v, u, avg(x) AS fill FROM n WHERE k <= 5 GROUP BY 1, 2, 3)
SELECT vec_id, v, u, round(CASE WHEN x < -0.15 THEN fill ELSE x END, 6) AS value FROM g LEFT JOIN f USING (vec_id, v, u)""")
def knn_infill_mean(read):
    c = cells(read).withColumn("value", F.when(F.col("value") >= -0.15, F.col("value")))
    return rounded(joins.infill_mean(c, KEY, 5))


@query(f"""WITH {GRID}, q AS (SELECT vec_id, v * 8 + u AS query, v, u FROM g WHERE x > 0.2), r AS (SELECT vec_id, v * 8 + u AS row, v, u FROM g WHERE x < -0.2)
SELECT vec_id, query, row, CAST(d AS DOUBLE) AS dist2, CAST(k AS INTEGER) AS rank FROM (SELECT vec_id, query, row, (q.v - r.v) * (q.v - r.v) + (q.u - r.u) * (q.u - r.u) AS d,
row_number() OVER (PARTITION BY vec_id, query ORDER BY (q.v - r.v) * (q.v - r.v) + (q.u - r.u) * (q.u - r.u), row) AS k FROM q JOIN r USING (vec_id)) WHERE k <= 3""")
def knn_k3(read):
    c = cells(read).withColumn("at", F.col("v") * SIZE + F.col("u"))
    return joins.nearest(c.where("value > 0.2"), c.where("value < -0.2"), KEY, ["v", "u"], 3, "at", "at")


@query(f"""WITH {GRID} SELECT vec_id, v, u, round(9 / (1 + exp(x)) + 1, 6) AS depth FROM g""")
def depth_model(read):
    _, estimate = models.make("intensity-l")
    return rounded(estimate(cells(read)).select("vec_id", "v", "u", "depth"))


@query(f"""WITH {GRID} SELECT vec_id, v, u, round(CASE WHEN x > 0 THEN 1 / x ELSE 0 END, 4) AS disparity, round((1 + abs(x)) * 1.5, 6) AS metric, CASE WHEN x > 0.2 THEN 200.0 ELSE round(x, 6) END AS with_sky FROM g""")
def depth_conversions(read):
    c = cells(read)
    x = F.col("value")
    return rounded(c.select("vec_id", "v", "u", F.round(models.depth_to_disparity(x), 4).alias("disparity"), models.metric_scaling(1 + F.abs(x), F.lit(500.0), F.lit(400.0)).alias("metric"), models.sky_to_depth(x, x > 0.2).alias("with_sky")))


@query()
def depth_completion(read):
    c = depth(read).withColumn("prior", F.when((F.col("v") * 3 + F.col("u")) % 4 == 0, F.col("value"))).withColumn("pred", 1 / F.col("value") + 0.1)
    return rounded(models.complete_depth(c, KEY).select("vec_id", "v", "u", "depth"))


@query()
def small_region_removal(read):
    c = cells(read).select("vec_id", "v", "u", (F.col("value") > 0).alias("on"))
    return greedy.small_regions(c, KEY, "on", 3, "islands")


@query("""SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / 8.0, 6) AS corr FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN 1 AND 3""")
def corr_volume(read):
    e = read("embeddings").select("vec_id", "embedding")
    edges = e.select(F.col("vec_id").alias("i"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("d"), F.col("embedding").alias("a")).withColumn("j", F.col("i") + F.col("d"))
    return rounded(edges.join(e.select(F.col("vec_id").alias("j"), F.col("embedding").alias("b")), "j").select("i", "j", joins.correlation(F.col("a"), F.col("b"), 8.0).alias("corr")))


@query("SELECT r_regionkey, CAST(k // 4 AS INTEGER) AS v, CAST(k % 4 AS INTEGER) AS u, (k % 4 + 0.5) / 4.0 AS x, (k // 4 + 0.5) / 4.0 AS y FROM region, (SELECT unnest(range(16)) AS k)")
def point_grid(read):
    from ..operators import generators

    return generators.point_grid(read("region").select("r_regionkey"), 4)


@query("""SELECT n_nationkey, CAST(i AS INTEGER) AS camera, round(2 * pi() * i / 6, 6) AS yaw FROM nation, (SELECT unnest(range(6)) AS i)""")
def virtual_rig(read):
    from ..operators import generators

    return rounded(generators.virtual_rig(read("nation").select("n_nationkey"), 6).where("pitch = 0").select("n_nationkey", "camera", "yaw"))


@query()
def crop_boxes(read):
    from ..operators import generators

    return generators.crop_boxes(read("region").select("r_regionkey"), 480, 640, 2, 512 / 1500)


@query("""SELECT r_regionkey, x * 0.5 AS x, y * 0.5 AS y, z * 0.5 AS z FROM region, (SELECT unnest(range(3)) AS x), (SELECT unnest(range(3)) AS y), (SELECT unnest(range(2)) AS z)""")
def aabb_lattice(read):
    from ..operators import generators

    return generators.lattice(read("region").select("r_regionkey"), [0.0, 0.0, 0.0], [1.5, 1.5, 1.0], 0.5)
