"""Queries of lenses, maps, chains and whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import compose
from ..functions import lenses
from ..operators import align, joins, maps, models
from . import pipelines
from .base import EV, GRID, SIZE, cells, frames, query, rounded



@query(f"WITH {GRID} SELECT vec_id, v, u, round((u - 4) / 16.0, 5) AS x, round((v - 4) / 16.0, 5) AS y FROM g")
def lens_round_trip(read):
    """Undistorting a distorted point gives the point."""
    k = [0.1, -0.05, 0.01, 0.002, -0.003, 0.001, 0.0, -0.001, 0.0]
    c = cells(read).withColumn("d", lenses.lens_udf("OPENCV", k)((F.col("u") - 4) / 16.0, (F.col("v") - 4) / 16.0))
    c = c.withColumn("r", lenses.lens_udf("OPENCV", k, inverse=True)("d.x", "d.y"))
    return rounded(c.select("vec_id", "v", "u", "r.x", "r.y"), 5)


@query(f"WITH {GRID} SELECT vec_id, v, u, round((u - 4) / 8.0, 5) AS x, round((v - 4) / 8.0, 5) AS y FROM g")
def fisheye_round_trip(read):
    k = [0.02, -0.01, 0.003, 0.0, 0.0, 0.0, 0.001, -0.001, 0.0005, 0.0, 0.0005, 0.0]
    c = cells(read).withColumn("d", lenses.lens_udf("FISHEYE624", k)((F.col("u") - 4) / 8.0, (F.col("v") - 4) / 8.0))
    c = c.withColumn("r", lenses.lens_udf("FISHEYE624", k, inverse=True)("d.x", "d.y"))
    return rounded(c.select("vec_id", "v", "u", "r.x", "r.y"), 5)


@query(f"""WITH {GRID}, r AS (SELECT vec_id, v, u, (u - 4) / 8.0 AS x, (v - 4) / 8.0 AS y FROM g), d AS (SELECT *, sqrt(x * x + y * y + 1) AS n FROM r)
SELECT vec_id, v, u, round(0.5 / sqrt(pi()), 6) AS y00, round(sqrt(3 / (4 * pi())) * y / n, 6) AS y1m, round(sqrt(3 / (4 * pi())) / n, 6) AS y10, round(sqrt(3 / (4 * pi())) * x / n, 6) AS y11, round(0.25 * sqrt(5 / pi()) * (3 / (n * n) - 1), 6) AS y20 FROM d""")
def spherical_harmonics(read):
    x, y = (F.col("u") - 4) / 8.0, (F.col("v") - 4) / 8.0
    n = F.sqrt(x * x + y * y + 1)
    c = cells(read).withColumn("h", lenses.harmonics_udf(4)(x / n, y / n, 1 / n))
    return rounded(c.select("vec_id", "v", "u", *(F.col("h")[k].alias(name) for k, name in ((0, "y00"), (1, "y1m"), (2, "y10"), (3, "y11"), (6, "y20")))))


@query(f"""WITH {GRID}, p AS (SELECT vec_id AS kf, (u - 3.5) AS x, (v - 3.5) AS y, 4 + x AS z FROM g), f AS (SELECT vec_id AS frame_idx, vec_id AS kf, 0.1 * (vec_id % 3) AS tx FROM embeddings)
SELECT frame_idx, CAST(floor(8 * y / z + 4) AS INTEGER) AS v, CAST(floor(8 * (x - tx) / z + 4) AS INTEGER) AS u, round(min(z), 6) AS depth FROM f JOIN p ON p.kf BETWEEN f.kf - 3 AND f.kf + 3
WHERE z > 0.1 AND floor(8 * y / z + 4) BETWEEN 0 AND 7 AND floor(8 * (x - tx) / z + 4) BETWEEN 0 AND 7 GROUP BY 1, 2, 3""")
def project_map_window(read):
    p = cells(read).select(F.col("vec_id").alias("kf"), (F.col("u") - 3.5).alias("x"), (F.col("v") - 3.5).alias("y"), (4 + F.col("value")).alias("z"))
    o = F.lit(0.0)
    f = read("embeddings").select(F.col("vec_id").alias("frame_idx"), F.col("vec_id").alias("kf"), *(F.lit(v).alias(n) for n, v in (("fx", 8.0), ("fy", 8.0), ("cx", 4.0), ("cy", 4.0))), (0.1 * (F.col("vec_id") % 3)).alias("tx"), *(o.alias(n) for n in ("ty", "tz", "qx", "qy", "qz")), F.lit(1.0).alias("qw"))
    return rounded(maps.frame_map(p, f, SIZE, SIZE, 3))


@query(f"""WITH {EV}, r AS (SELECT stream_id, raw_frame_idx // 6 AS f, CASE WHEN value > 60 THEN value / 60 END AS ratio FROM ev), p AS (SELECT stream_id, f, quantile_disc(ratio, 0.5) AS m, count(ratio) AS n, count(*) AS t FROM r GROUP BY 1, 2)
SELECT stream_id, CAST(f AS BIGINT) AS f, round(coalesce(last_value(CASE WHEN n > 0 AND n >= 0.4 * t THEN m END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY f ROWS UNBOUNDED PRECEDING), 1.0), 6) AS scale FROM p""")
def panorama_scales(read):
    r = frames(read).select("stream_id", F.floor(F.col("raw_frame_idx") / 6).cast("long").alias("f"), F.when(F.col("value") > 60, F.col("value") / 60).alias("ratio"))
    return rounded(maps.carried_scales(r, ["stream_id"], "f", F.count(F.lit(1)), 0.4))


@query(f"""WITH {EV}, n AS (SELECT stream_id, greatest(count(*) // 8 - 1, 0) AS last FROM ev GROUP BY 1)
SELECT stream_id, CAST(w AS BIGINT) AS w, CASE WHEN w % 2 = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS scale, CASE WHEN w % 2 = 1 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS shift FROM (SELECT stream_id, unnest(range(last + 1)) AS w FROM n)""")
def video_depth_chain(read):
    """Windows of a video model over whole streams, every other one off by a scale and a shift, are chained back.

    Windows of 8 frames share 4 with the one before; the last takes what is left of its stream.
    """
    f = frames(read).select("stream_id", "raw_frame_idx", "value")
    n = f.groupBy("stream_id").agg(F.greatest(F.floor(F.count(F.lit(1)) / 8) - 1, F.lit(0)).alias("last"))
    f = f.join(n, "stream_id").withColumn("own", F.least(F.floor(F.col("raw_frame_idx") / 8), F.col("last")))
    own = F.col("own")
    f = f.withColumn("w", F.explode(F.when((own > 0) & (F.col("raw_frame_idx") - own * 8 < 4), F.array(own - 1, own)).otherwise(F.array(own))))
    f = f.withColumn("x", F.when(F.col("w") % 2 == 1, (F.col("value") - 3.0) / 2).otherwise(F.col("value")))
    return rounded(maps.chained_windows(f, ["stream_id"], "w", "raw_frame_idx", "x", 4), 4)


@query(f"""WITH a AS (SELECT vec_id, embedding FROM embeddings), g AS (SELECT vec_id, CAST((p - 1) // 8 AS INTEGER) AS v, CAST((p - 1) % 8 AS INTEGER) AS u, CAST(embedding[p] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM a))
SELECT s.vec_id AS e, s.v, s.u, CAST(t.v // 2 AS INTEGER) AS tv, CAST(t.u // 2 AS INTEGER) AS tu, round(avg(s.x * t.x), 6) AS value FROM g s JOIN g t ON t.vec_id = s.vec_id WHERE s.v = s.u GROUP BY 1, 2, 3, 4, 5""")
def corr_pyramid(read):
    return rounded(maps.correlation_pyramid(_volume(read), ["e"], 1))


def _volume(read):
    c = cells(read).select(F.col("vec_id").alias("e"), "v", "u", "value")
    t = c.select("e", F.col("v").alias("tv"), F.col("u").alias("tu"), F.col("value").alias("y"))
    return c.where("v = u").join(t, "e").select("e", "v", "u", "tv", "tu", (F.col("value") * F.col("y")).alias("value"))


@query("""WITH a AS (SELECT vec_id, embedding FROM embeddings), g AS (SELECT vec_id, CAST((p - 1) // 8 AS INTEGER) AS v, CAST((p - 1) % 8 AS INTEGER) AS u, CAST(embedding[p] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM a)),
w AS (SELECT s.vec_id AS e, s.v, s.u, s.x AS sx, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, s.u + dx AS x0, s.v + dy AS y0 FROM g s, (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx) WHERE s.v = s.u)
SELECT w.e, w.v, w.u, dy, dx, round(w.sx * (0.75 * coalesce(a.x, 0) + 0.25 * coalesce(b.x, 0)), 6) AS value FROM w LEFT JOIN g a ON a.vec_id = w.e AND a.v = y0 AND a.u = x0 LEFT JOIN g b ON b.vec_id = w.e AND b.v = y0 AND b.u = x0 + 1""")
def corr_lookup(read):
    v = _volume(read)
    coords = v.select("e", "v", "u").distinct().withColumn("x", F.col("u") + 0.25).withColumn("y", F.col("v") + 0.0)
    return rounded(maps.correlation_lookup(v, coords, ["e"], 1, SIZE, SIZE))


@query(f"""WITH {GRID}, c AS (SELECT vec_id, v + a.d AS v, u + b.d AS u, v * 8 + u AS o FROM g, (SELECT unnest(range(-1, 2)) AS d) a, (SELECT unnest(range(-1, 2)) AS d) b WHERE x > 0.2)
SELECT vec_id, CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u, CAST(max(o) AS INTEGER) AS colour FROM c WHERE v BETWEEN 0 AND 7 AND u BETWEEN 0 AND 7 GROUP BY 1, 2, 3""")
def painted_points(read):
    c = cells(read).where("value > 0.2").withColumn("o", F.col("v") * SIZE + F.col("u")).withColumn("colour", F.col("o"))
    return maps.painted(c, ["vec_id"], "o", "colour", 1, SIZE, SIZE)


@query("""SELECT i, view, CAST(other_i AS BIGINT) AS other_i, CAST(other AS INTEGER) AS other FROM (SELECT l_suppkey AS i, CAST(l_linenumber % 3 AS INTEGER) AS view, l_partkey AS other_i, l_linenumber AS other, l_extendedprice AS d,
row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 3 ORDER BY l_extendedprice, l_partkey, l_linenumber) AS k FROM lineitem) WHERE k = 1 AND d < 1500""")
def cross_view_min(read):
    d = read("lineitem").select(F.col("l_suppkey").alias("i"), (F.col("l_linenumber") % 3).cast("int").alias("view"), F.col("l_partkey").alias("other_i"), F.col("l_linenumber").alias("other"), F.col("l_extendedprice").alias("d"))
    return maps.cross_views(d, 1500.0)


@query(f"""WITH {EV}, n AS (SELECT stream_id, count(*) AS n FROM ev GROUP BY 1), g AS (SELECT stream_id, least(30, (n - 1) // 2) AS g FROM n), p AS (SELECT e.stream_id, 0.5 + value / 1000 AS fov FROM ev e JOIN g USING (stream_id) WHERE raw_frame_idx IN (0, g, 2 * g))
SELECT stream_id, round(avg(480 / (2 * tan(fov / 2))), 4) AS focal, CAST(320 AS DOUBLE) AS cx FROM p GROUP BY 1""")
def estimated_intrinsics(read):
    f = frames(read).select("stream_id", F.col("raw_frame_idx").alias("frame_idx"), (0.5 + F.col("value") / 1000).alias("fov"))
    k = pipelines.estimated_intrinsics(f, 1.0, 480, 640, 30.0)
    return rounded(k.select("stream_id", F.col("intrinsics")[0].alias("focal"), F.col("intrinsics")[2].alias("cx")), 4)


@query(f"""WITH {GRID}, d AS (SELECT vec_id, v, u, 9 / (1 + exp(x)) + 1 AS d FROM g), r AS (SELECT a.vec_id, a.v, a.u, any_value(a.d) AS d, (max(b.d) - min(b.d)) / (sum(b.d) / 25.0 + 1e-6) < 0.1 AS ok FROM d a JOIN d b ON b.vec_id = a.vec_id AND abs(b.v - a.v) <= 2 AND abs(b.u - a.u) <= 2 GROUP BY 1, 2, 3)
SELECT vec_id % 10 AS stream_id, vec_id // 10 AS frame_idx, v, u, round(d, 6) AS depth, ok AS reliable FROM r""")
def default_pipeline(read):
    c = cells(read).select((F.col("vec_id") % 10).alias("stream_id"), F.floor(F.col("vec_id") / 10).cast("long").alias("frame_idx"), "v", "u", "value")
    config = compose("default", ["track.keyframe_threshold=0.05"])
    return rounded(pipelines.make(config)(c, config, SIZE, SIZE).select("stream_id", "frame_idx", "v", "u", "depth", "reliable"))


@query()
def panorama_pipeline(read):
    c = cells(read).select((F.col("vec_id") % 10).alias("stream_id"), F.floor(F.col("vec_id") / 10).cast("long").alias("frame_idx"), "v", "u", "value")
    config = compose("panorama", ["cameras.count=4"])
    return rounded(pipelines.make(config)(c, config, SIZE, SIZE))


@query(f"""WITH {GRID} SELECT vec_id, round(sum(d * m) / greatest(sum(d * d), 1e-12), 6) AS scale FROM (SELECT vec_id, 1 + abs(x) AS d, 2 * (1 + abs(x)) + x AS m, x FROM g) WHERE x > -0.1 GROUP BY 1""")
def nested_depth_scale(read):
    """The scale of a relative depth map to a metric one, over trusted pixels."""
    from ..operators import segments

    d, m = 1 + F.abs("value"), 2 * (1 + F.abs("value")) + F.col("value")
    ok = models.alignment_mask(F.lit(1.0), F.col("value") <= -0.1, d, m, F.lit(0.5))
    return rounded(cells(read).where(ok).groupBy("vec_id").agg(segments.scale_scalar(m, d).alias("scale")))


@query("""SELECT o_custkey AS k, round(min(d), 4) AS nearest FROM (SELECT a.o_custkey, abs(a.o_totalprice - b.o_totalprice) AS d FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey) GROUP BY 1""")
def median_nearest(read):
    """The distance of each customer's closest two orders: nearest neighbours within a key."""
    o = read("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))
    n = joins.nearest(o, o, ["k"], ["p"], 2, "id", "id").where("query <> row")
    return rounded(n.groupBy("k").agg(F.min(F.sqrt("dist2")).alias("nearest")), 4)


@query()
def rigid_alignment(read):
    """Trajectories of a sensor that is mounted off the other's centre: similarity and offset by turns."""
    one, o = F.lit(1.0), F.lit(0.0)
    a = F.col("l_quantity") / 10
    c, s = F.cos(a), F.sin(a)
    li = read("lineitem").select("l_returnflag", F.col("l_quantity").alias("px"), (F.col("l_discount") * 100).alias("py"), (F.col("l_tax") * 100).alias("pz"), *(e.alias(f"m{k}") for k, e in enumerate((c, -s, o, s, c, o, o, o, one))))
    li = li.withColumn("x", F.col("px") + 0.3 * F.col("m0")).withColumn("y", F.col("py") + 0.3 * F.col("m3")).withColumn("z", F.col("pz") + 0.0)
    fits, offset = align.align_rigid(li, ["l_returnflag"], ["px", "py", "pz", *(f"m{k}" for k in range(9))], ["x", "y", "z"])
    return rounded(fits.join(offset, "l_returnflag"), 4)


@query(f"""WITH {GRID} SELECT vec_id, v, u FROM g WHERE v % 4 = 0 AND u % 4 = 0 UNION ALL SELECT vec_id, v, u FROM g WHERE v IN (2, 6) AND NOT (v % 4 = 0 AND u % 4 = 0)""")
def sparse_patterns(read):
    """Every fourth cell, and two scan lines."""
    from ..operators import sampling

    c = cells(read, 1 + F.abs(F.col("_x").cast("double")))
    pick = lambda p: sampling.sparse_pattern(c, ["vec_id"], p, SIZE, SIZE).where("picked").select("vec_id", "v", "u")
    return pick("downscale_4").unionByName(pick("LiDAR_2"))


@query(f"""WITH {GRID} SELECT vec_id, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 10""")
def sparse_random(read):
    """Ten random cells of each grid: as many as asked for, on grids of 64."""
    from ..operators import sampling

    c = cells(read, 1 + F.abs(F.col("_x").cast("double")))
    n = sampling.sparse_pattern(c, ["vec_id"], "10", SIZE, SIZE).groupBy("vec_id").agg(F.count_if("picked").alias("k"), F.count(F.lit(1)).alias("n"))
    return n.where("k = 10").select("vec_id", "n")


@query(f"""WITH {GRID}, d AS (SELECT vec_id, v, u, 1 + abs(x) AS d FROM g WHERE vec_id % 3 = 0 AND v % 4 = 0 AND u % 4 = 0 AND x > -0.1)
SELECT vec_id AS frame_idx, v, u, round((u - 4) / 8.0 * d + vec_id, 6) AS x, round((v - 4) / 8.0 * d + 2, 6) AS y, round(d + 3, 6) AS z FROM d""")
def colmap_depth_points(read):
    from ..sources import colmap

    c = cells(read).select(F.col("vec_id").alias("frame_idx"), "v", "u", (1 + F.abs("value")).alias("depth"), (F.col("value") > -0.1).alias("reliable"))
    o, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(one, o, o, F.col("vec_id").cast("double"), o, one, o, F.lit(2.0), o, o, one, F.lit(3.0), o, o, o, one)
    f = read("embeddings").select(F.col("vec_id").alias("frame_idx"), pose.alias("pose"), *(F.lit(v).alias(n) for n, v in (("fx", 8.0), ("fy", 8.0), ("cx", 4.0), ("cy", 4.0))))
    return rounded(colmap.depth_points(c, f, 3, 4))


@query("""SELECT n_nationkey, CAST(1 AS DOUBLE) AS length, round(cos(0.1 + n_nationkey / 50.0), 6) AS cosine FROM nation""")
def direction_steps(read):
    """A step along the sphere of directions: unit length, and turned by the step's size."""
    from ..functions import geometry as geo
    from ..operators import sampling

    g = geo.gravity_from_rp(F.col("n_nationkey") / 30.0, F.lit(0.2))
    size = 0.1 + F.col("n_nationkey") / 50.0
    n, g = geo.staged(read("nation").select("n_nationkey"), "g", tuple(g))
    h = sampling.direction_step(geo.Vec(*g), size * 0.6, size * 0.8)
    return rounded(n.select("n_nationkey", geo.norm(h).alias("length"), geo.dot(h, g).alias("cosine")))


@query("""SELECT vec_id, round(embedding[1] + vec_id % 7, 6) AS x0, round(embedding[2] + vec_id % 5, 6) AS y0, round(embedding[1] + abs(embedding[3]) + vec_id % 7, 6) AS x1,
round(embedding[2] + abs(embedding[4]) + vec_id % 5, 6) AS y1, round(embedding[5] + vec_id % 7, 6) AS px, round(embedding[6] + vec_id % 5, 6) AS py
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE len(embedding) >= 6)""")
def uncrop_boxes(read):
    """Boxes and points of crops, whose corners depend on the row, in their images."""
    e = lambda k: F.col("embedding")[k].cast("double")
    x, y = F.col("vec_id") % 7, F.col("vec_id") % 5
    box = joins.uncrop_box([e(0), e(1), e(0) + F.abs(e(2)), e(1) + F.abs(e(3))], x, y)
    point = joins.uncrop_point([e(4), e(5)], x, y)
    rows = read("embeddings").where(F.size("embedding") >= 6)
    return rounded(rows.select("vec_id", *(c.alias(n) for c, n in zip([*box, *point], ("x0", "y0", "x1", "y1", "px", "py")))))


@query(f"""WITH {GRID}, image AS (SELECT vec_id, v, u FROM (SELECT DISTINCT vec_id FROM g), unnest(range(0, 12)) AS a(v), unnest(range(0, 16)) AS b(u))
SELECT image.vec_id, CAST(image.v AS INTEGER) AS v, CAST(image.u AS INTEGER) AS u, coalesce(g.x > 0, false) AS inside
FROM image LEFT JOIN g ON g.vec_id = image.vec_id AND g.v + 3 = image.v AND g.u + 5 = image.u""")
def uncrop_masks(read):
    from ..operators import grids

    return grids.uncrop(cells(read, F.col("_x").cast("double") > 0), ["vec_id"], 5, 3, 12, 16).withColumnRenamed("value", "inside")


@query(f"""WITH {EV}, w AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS k FROM ev),
r AS (SELECT event_id, stream_id, k, row_number() OVER (ORDER BY stream_id % 13, event_id DESC) <= 48 AS active FROM w) SELECT event_id, active FROM r""")
def youngest_edges(read):
    """The 48 youngest of all edges stay active."""
    e = read("events").select("event_id", (F.col("user_id") % 13).alias("age"))
    return joins.evict_oldest(e, 48, "age", "event_id").select("event_id", "active")


@query("""WITH g AS (SELECT n_nationkey, n_nationkey / 40.0 - 0.3 AS r, 0.4 - n_nationkey / 30.0 AS p FROM nation),
m AS (SELECT *, 500 * sin(r) * tan(p) + 320 AS x, 510 * cos(r) * tan(p) + 240 AS y FROM g)
SELECT n_nationkey, round((y + x * tan(r)) / 480, 6) AS left_end, round((y - (640 - x) * tan(r)) / 480, 6) AS right_end FROM m""")
def horizon_lines(read):
    from ..functions import cameras

    roll, pitch = F.col("n_nationkey") / 40.0 - 0.3, 0.4 - F.col("n_nationkey") / 30.0
    left, right = cameras.horizon_line(roll, pitch, (500.0, 510.0, 320.0, 240.0), 640, 480)
    return rounded(read("nation").select("n_nationkey", left.alias("left_end"), right.alias("right_end")))
