"""Queries of segment aggregates, fits, sparse blocks and graphs over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, greedy, joins, segments, solver
from .base import QUERIES, cells, frames, query, rounded


def _scatter(kind: str, sql: str, empty: str):
    @query(f"""SELECT i AS index, round(coalesce(x, {empty}), 4) AS value FROM (SELECT unnest(range(60)) AS i) LEFT JOIN (SELECT CAST(l_quantity AS BIGINT) AS k, {sql} AS x FROM lineitem GROUP BY 1) ON i = k""")
    def run(read):
        return rounded(segments.scatter(read("lineitem"), "l_quantity", "l_discount" if kind != "mul" else "f", kind, 60), 4) if kind != "mul" else rounded(segments.scatter(read("lineitem").withColumn("f", 1 + (F.col("l_tax") - 0.04) / 100), "l_quantity", "f", "mul", 60), 4)

    return run


def _register_scatter():
    from .base import ORACLE_SQL

    for kind, sql, empty in (("sum", "sum(l_discount)", "0"), ("mean", "avg(l_discount)", "0"), ("mul", "product(1 + (l_tax - 0.04) / 100)", "1")):
        _scatter(kind, sql, empty)
        QUERIES[f"scatter_{kind}"], ORACLE_SQL[f"scatter_{kind}"] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


_register_scatter()


@query("""SELECT l_suppkey AS index, round(min(l_extendedprice), 4) AS value, arg_min(l_orderkey * 10 + l_linenumber, struct_pack(a := l_extendedprice, b := l_orderkey * 10 + l_linenumber)) AS arg FROM lineitem GROUP BY 1""")
def scatter_min(read):
    li = read("lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(segments.scatter(li, "l_suppkey", "l_extendedprice", "min", position="at"), 4)


@query("""SELECT l_suppkey AS index, round(max(l_extendedprice), 4) AS value, arg_min(l_orderkey * 10 + l_linenumber, struct_pack(a := -l_extendedprice, b := l_orderkey * 10 + l_linenumber)) AS arg FROM lineitem GROUP BY 1""")
def scatter_max(read):
    li = read("lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(segments.scatter(li, "l_suppkey", "l_extendedprice", "max", position="at"), 4)


@query("""SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.5) AS lower_median, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90 FROM lineitem GROUP BY 1, 2""")
def medians_and_quantiles(read):
    g = read("lineitem").groupBy("l_returnflag", "l_linestatus")
    return rounded(g.agg(segments.lower_median("l_extendedprice").alias("lower_median"), segments.quantile("l_extendedprice", 0.9).alias("q90")), 4)


METRICS = "o := l_extendedprice / l_quantity / 1000"


@query("""WITH m AS (SELECT l_returnflag, l_extendedprice / l_quantity / 1000 AS o, 1 + l_tax AS t, l_discount > 0.02 AS ok FROM lineitem)
SELECT l_returnflag, round(avg(abs(o - t) / t) FILTER (WHERE ok), 6) AS absrel, round(sqrt(avg((ln(o) - ln(t)) ** 2) FILTER (WHERE ok)), 6) AS rmse_log, round(avg(CASE WHEN greatest(o / t, t / o) < 1.25 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok), 6) AS delta1 FROM m GROUP BY 1""")
def depth_metrics(read):
    o, t, ok = F.col("l_extendedprice") / F.col("l_quantity") / 1000, 1 + F.col("l_tax"), F.col("l_discount") > 0.02
    g = read("lineitem").groupBy("l_returnflag")
    return rounded(g.agg(segments.abs_relative(o, t, ok).alias("absrel"), segments.rmse_log(o, t, ok).alias("rmse_log"), segments.delta1(o, t, ok).alias("delta1")))


@query("""SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 3) AS scale, round(regr_intercept(l_extendedprice, l_quantity), 3) AS shift FROM lineitem GROUP BY 1""")
def scale_shift(read):
    return rounded(segments.scale_shift(read("lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"), 3)


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.9) AS b FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS scale, round(regr_intercept(l_extendedprice, l_quantity), 3) AS shift FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice > a AND l_extendedprice < b GROUP BY 1""")
def quantile_trim_lstsq(read):
    return rounded(segments.scale_shift(segments.trimmed(read("lineitem"), ["l_returnflag"], "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 3)


@query("""SELECT l_shipmode_, round(sum(l_quantity * l_extendedprice) / (sum(l_quantity * l_quantity) + 1e-6), 4) AS scale, round(sum(l_extendedprice * l_quantity) / greatest(sum(l_quantity * l_quantity), 1e-12), 4) AS scalar_, quantile_disc(l_extendedprice / l_quantity, 0.5) AS median_ratio FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY 1""")
def scale_only(read):
    li = read("lineitem").withColumn("ratio", F.col("l_extendedprice") / F.col("l_quantity")).withColumnRenamed("l_returnflag", "l_shipmode_")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    out = li.groupBy("l_shipmode_").agg(segments.scale_only(q, p).alias("scale"), segments.scale_scalar(p, q).alias("scalar_"), segments.lower_median("ratio").alias("median_ratio"))
    return out.select("l_shipmode_", F.round("scale", 4).alias("scale"), F.round("scalar_", 4).alias("scalar_"), "median_ratio")


@query("""WITH r AS (SELECT event_id, (value - 100) / 50 AS r FROM events) SELECT event_id, round(CASE WHEN abs(r) <= 1 THEN 1 ELSE 1 / abs(r) END, 6) AS huber, round(greatest(1 - (r / 2.0) ** 2, 0) ** 2, 6) AS tukey,
round(CASE WHEN r * r <= 0.75 THEN 1 WHEN r * r >= 4.0 / 3 THEN 0 ELSE sqrt(12.0) / abs(r) - 3 END, 6) AS tls FROM r""")
def robust_weights(read):
    r = (F.col("value") - 100) / 50
    return rounded(read("events").select("event_id", segments.huber_weight(r, 1.0).alias("huber"), segments.tukey_weight(r, 2.0).alias("tukey"), segments.tls_weight(r, 1.0, 3.0).alias("tls")))


@query("""SELECT i, j, CAST(0 AS INTEGER) AS r, CAST(0 AS INTEGER) AS c, round(sum(x), 4) AS x FROM (SELECT l_suppkey AS i, l_partkey % 50 AS j, l_extendedprice AS x FROM lineitem) GROUP BY 1, 2""")
def block_coalesce(read):
    return rounded(blocks.coalesce(_entries(read)), 4)


def _entries(read, i="l_suppkey", j="l_partkey", mod=50, x="l_extendedprice"):
    o = F.lit(0)
    return read("lineitem").select(F.col(i).alias("i"), (F.col(j) % mod).alias("j"), o.alias("r"), o.alias("c"), F.col(x).alias("x"))


@query("""SELECT j AS i, CAST(0 AS INTEGER) AS r, round(sum(x * (i % 7)), 3) AS x FROM (SELECT l_suppkey AS i, l_partkey % 50 AS j, l_quantity AS x FROM lineitem) GROUP BY 1""")
def block_matvec(read):
    a = _entries(read, x="l_quantity")
    v = a.select("i").distinct().select("i", F.lit(0).alias("r"), (F.col("i") % 7).cast("double").alias("x"))
    return rounded(blocks.tmult_vec(a, v), 3)


@query("""WITH a AS (SELECT l_suppkey AS i, l_partkey % 20 AS j, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey AS i, l_linenumber % 5 AS j, sum(l_tax) AS x FROM lineitem GROUP BY 1, 2)
SELECT a.j AS i, CAST(b.j AS INTEGER) AS j, CAST(0 AS INTEGER) AS r, CAST(0 AS INTEGER) AS c, round(sum(a.x * b.x), 3) AS x FROM a JOIN b USING (i) GROUP BY 1, 2""")
def block_matmul(read):
    a = blocks.coalesce(_entries(read, mod=20, x="l_quantity"))
    b = blocks.coalesce(_entries(read, j="l_linenumber", mod=5, x="l_tax"))
    return rounded(blocks.tmult(a, b), 3)


@query("""WITH m AS (SELECT l_linenumber AS i, CAST(l_partkey % 7 AS INTEGER) + 1 AS j, sum(l_tax) AS x FROM lineitem GROUP BY 1, 2), u AS (SELECT * FROM m WHERE i <= j)
SELECT i, j, round(x, 5) AS x FROM u UNION ALL SELECT j AS i, i AS j, round(x, 5) AS x FROM u WHERE i <> j""")
def block_symmetric(read):
    m = read("lineitem").select(F.col("l_linenumber").alias("i"), ((F.col("l_partkey") % 7).cast("int") + 1).alias("j"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("l_tax").alias("x"))
    return rounded(blocks.symmetric(blocks.coalesce(m).where("i <= j")).select("i", "j", "x"), 5)


@query("""SELECT i, j, round(sum(x), 4) AS x FROM (SELECT l_suppkey AS i, l_partkey % 50 AS j, l_quantity AS x FROM lineitem) WHERE j NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1, 2""")
def remove_fixed_columns(read):
    m = blocks.without_columns(_entries(read, x="l_quantity"), read("nation").select(F.col("n_nationkey").alias("j")))
    return rounded(blocks.coalesce(m).select("i", "j", "x"), 4)


@query("""WITH u AS (SELECT DISTINCT l_partkey AS i FROM lineitem WHERE l_quantity > 49) SELECT i, row_number() OVER (ORDER BY i) - 1 AS at FROM u""")
def ravel_mapping(read):
    return blocks.ravel_mapping(read("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("i")))


@query("""SELECT i, j, round(CASE WHEN i = j THEN x * 1.001 + 0.1 ELSE x END, 5) AS x FROM (SELECT l_linenumber AS i, CAST(l_partkey % 7 AS INTEGER) + 1 AS j, sum(l_tax) AS x FROM lineitem GROUP BY 1, 2)""")
def block_damping(read):
    m = read("lineitem").select(F.col("l_linenumber").alias("i"), ((F.col("l_partkey") % 7).cast("int") + 1).alias("j"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("l_tax").alias("x"))
    return rounded(blocks.damped(blocks.coalesce(m), 0.001, 0.1).select("i", "j", "x"), 5)


@query("""WITH e AS (SELECT l_linenumber AS i, CAST(l_suppkey AS BIGINT) AS j, sum(l_tax) AS x FROM lineitem GROUP BY 1, 2), c AS (SELECT l_suppkey AS j, sum(l_quantity) AS x FROM lineitem GROUP BY 1)
SELECT a.i, b.i AS j, round(CASE WHEN a.i = b.i THEN 1000 ELSE 0 END - sum(a.x * b.x / c.x), 5) AS x FROM e a JOIN e b ON a.j = b.j JOIN c ON c.j = a.j GROUP BY 1, 2""")
def schur_complement(read):
    li, o = read("lineitem"), F.lit(0)
    e = blocks.coalesce(li.select(F.col("l_linenumber").cast("long").alias("i"), F.col("l_suppkey").alias("j"), o.alias("r"), o.alias("c"), F.col("l_tax").alias("x")))
    c = li.groupBy(F.col("l_suppkey").alias("i")).agg(F.sum("l_quantity").alias("x")).select("i", F.col("i").alias("j"), o.alias("r"), o.alias("c"), "x")
    pose = e.select("i").distinct().select("i", F.col("i").alias("j"), o.alias("r"), o.alias("c"), F.lit(1000.0).alias("x"))
    v, w = pose.select("i", "r", F.lit(0.0).alias("x")), c.select("i", "r", "x")
    s, _ = blocks.schur(pose, e, c, v, w)
    return rounded(s.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "x"), 5)


@query("""SELECT DISTINCT l_suppkey AS i, l_partkey AS j FROM lineitem WHERE (l_suppkey, l_partkey) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 25)""")
def edge_anti_join(read):
    e = read("lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), "l_quantity")
    return joins.new_edges(e, e.where("l_quantity > 25"))


@query("""SELECT l_orderkey AS i, CAST(l_partkey AS BIGINT) AS j, CAST(v AS INTEGER) AS view_i, CAST((v + 1) % 3 AS INTEGER) AS view_j FROM lineitem, (SELECT unnest(range(3)) AS v) WHERE l_quantity > 45""")
def expand_multiview(read):
    e = read("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"))
    return joins.expand_multiview(e, 3, None, 1)


@query("""SELECT user_id AS key_, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) < 0.75 THEN 1000.0 ELSE 0.3 * sum(CASE WHEN value > 20 THEN value ELSE 0 END) / count(*) FILTER (WHERE value > 20) + 0.7 * sum(CASE WHEN value > 20 THEN value / 2 ELSE 0 END) / count(*) FILTER (WHERE value > 20) END, 4) AS distance FROM events GROUP BY 1""")
def frame_distance(read):
    e = read("events").withColumnRenamed("user_id", "key_")
    d = joins.frame_distance(e, ["key_"], F.col("value"), F.col("value") / 2, F.col("value") > 20)
    return rounded(e.groupBy("key_").agg(F.count(F.lit(1)).alias("n")).join(d, "key_"), 4)


@query("""WITH p AS (SELECT vec_id, CAST((k - 1) // 8 AS INTEGER) AS v, embedding[k] > 0 AS t, embedding[k] > -0.1 AS s, label FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS k FROM embeddings)),
g AS (SELECT vec_id, v + 1 AS seg, count(*) AS area, avg(CASE WHEN t THEN 0.0 ELSE 1.0 END) AS free FROM p WHERE s GROUP BY 1, 2)
SELECT vec_id, CAST(seg AS INTEGER) AS seg, area, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY seg) + 4 AS INTEGER) AS new_id FROM g WHERE free >= 0.4 AND area >= 4""")
def new_objects(read):
    c = cells(read)
    c = c.select("vec_id", F.when(F.col("value").cast("float") > 0, 1).otherwise(0).alias("track"), F.when(F.col("value").cast("float") > -0.1, F.col("v") + 1).otherwise(0).alias("seg"))
    return joins.new_objects(c, ["vec_id"], "track", "seg", 5, 0.4, 4).select("vec_id", "seg", "area", "new_id")


@query()
def nms_greedy(read):
    p = read("part").select((F.col("p_partkey") % 20).alias("image"), "p_partkey", (F.col("p_partkey") % 97).cast("double").alias("x0"), (F.col("p_partkey") % 89).cast("double").alias("y0"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("score"))
    p = p.withColumn("x1", F.col("x0") + F.col("s") + 5).withColumn("y1", F.col("y0") + F.col("s") + 5)
    return greedy.suppress_boxes(p, ["image"], ["x0", "y0", "x1", "y1"], "score", "p_partkey", 0.3)


@query()
def proximity_greedy(read):
    # Offsets up to 12 lose no edge: from 11 frames on the neighbourhoods alone are above the 48 edges that end the search.
    f = frames(read).select("stream_id", F.col("raw_frame_idx").alias("i"), "value")
    pairs = joins.band_edges(f, ["stream_id"], "i", 12)
    d = pairs.join(f.withColumnRenamed("value", "a"), ["stream_id", "i"]).join(f.select("stream_id", F.col("i").alias("j"), F.col("value").alias("b")), ["stream_id", "j"])
    return greedy.propose_edges(d.where("i > j").select("stream_id", "i", "j", (F.abs(F.col("a") - F.col("b"))).alias("d")), ["stream_id"], None, 2, 2, 16.0, 48)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey - o_custkey % 7 AS b FROM orders UNION SELECT DISTINCT o_custkey - o_custkey % 7, o_custkey - o_custkey % 14 FROM orders)
SELECT id, min(id - id % 14) AS component FROM (SELECT a AS id FROM e UNION SELECT b FROM e) GROUP BY id""")
def connected_components(read):
    c = read("orders").select(F.col("o_custkey").alias("k"))
    e = c.select(F.col("k").alias("a"), (F.col("k") - F.col("k") % 7).alias("b")).unionByName(c.select((F.col("k") - F.col("k") % 7).alias("a"), (F.col("k") - F.col("k") % 14).alias("b")))
    return greedy.components(e)


@query()
def bundle_adjustment(read):
    """Small frame graphs (four frames, 4 x 5 pixels), one for each part supplier, adjusted side by side."""
    s = read("supplier").select("s_suppkey")
    rep = lambda x, n: F.array_repeat(F.lit(x), n)
    poses = F.flatten(F.array(*(F.array(*(F.lit(v) for v in (0.01 * k, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))) for k in range(4))))
    edge = lambda xs: F.array(*map(F.lit, xs))
    k = F.sequence(F.lit(0), F.lit(5 * 4 * 5 * 2 - 1))
    target = F.transform(k, lambda x: F.when(x % 2 == 0, F.floor(x / 2) % 5).otherwise(F.floor(x / 10) % 4) + 0.1 * F.sin(x + F.col("s_suppkey")))
    g = s.select("s_suppkey", F.lit(4).alias("n"), F.lit(4).alias("h"), F.lit(5).alias("w"), poses.alias("poses"), rep(0.8, 80).alias("disps"), edge([40.0, 40.0, 2.0, 2.0]).alias("intrinsics"), edge([1, 2, 2, 3, 3]).alias("i"), edge([0, 0, 1, 1, 2]).alias("j"), target.alias("target"), rep(1.0, 200).alias("weight"))
    return rounded(solver.adjust_graphs(g, "s_suppkey").select("s_suppkey", "energy_before", "energy_after"), 4)


@query("""SELECT n_nationkey, round(n_nationkey / 100.0 - 0.1, 3) AS roll, round(0.15 - n_nationkey / 120.0, 3) AS pitch, round(2 * atan(240 / (400.0 + n_nationkey)), 3) AS vfov FROM nation""")
def camera_calibration(read):
    """Known cameras are found again from their perspective fields."""
    from ..functions import cameras as cam
    from ..functions import geometry as geo

    n = read("nation").select("n_nationkey", (F.col("n_nationkey") / 100.0 - 0.1).alias("roll"), (0.15 - F.col("n_nationkey") / 120.0).alias("pitch"), (400.0 + F.col("n_nationkey")).alias("f"))
    p = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(47)))).withColumn("u", (F.col("k") % 8) * 80.0 + 40).withColumn("v", F.floor(F.col("k") / 8) * 80.0 + 40)
    g = geo.gravity_from_rp(F.col("roll"), F.col("pitch"))
    x, y = (F.col("u") - 320) / F.col("f"), (F.col("v") - 240) / F.col("f")
    up = cam.up_field(x, y, g)
    p = p.select("n_nationkey", F.struct("k", "u", "v", up[0].alias("up_x"), up[1].alias("up_y"), cam.latitude_field(x, y, g).alias("latitude")).alias("s"))
    f = p.groupBy("n_nationkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    f = f.select("n_nationkey", *(F.col(f"s.{c}").alias(c) for c in ("u", "v", "up_x", "up_y", "latitude")))
    return rounded(solver.calibrate(f, "n_nationkey", (480, 640)), 3)
