"""Operators against NumPy and against cases worked out by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from streamloom.functions import cameras as cam
from streamloom.functions import geometry as geo
from streamloom.functions import text
from streamloom.operators import align, blocks, greedy, grids, images, joins, maps, models, segments, solver, streams, windows
from streamloom.sources import artifacts, codecs


def test_seek_of_short_and_empty_streams(spark):
    f = spark.range(5).select(F.lit("a").alias("stream_id"), F.col("id").alias("raw_frame_idx"))
    assert [tuple(r) for r in streams.seek(f, 1, -1, 2).select("raw_frame_idx", "frame_idx").collect()] == [(1, 0), (3, 1)]
    assert streams.seek(f, 10, -1, 1).count() == 0
    with pytest.raises(ValueError):
        streams.seek(f, 0, -1, 0)


def test_asof_both_ways_with_ties(spark):
    left = spark.createDataFrame([("a", t) for t in (0, 1, 2, 5)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 5, 50)], "k string, t int, x int")
    out = joins.asof(joins.asof(left, right, ["k"], "t", ["x"], "backward"), right, ["k"], "t", ["x"], "forward")
    got = {r.t: (r.backward_x, r.forward_x) for r in out.collect()}
    assert got == {0: (None, 10), 1: (10, 50), 2: (10, 50), 5: (50, None)}


@pytest.mark.parametrize("axis", [(0.3, -0.2, 0.9), (1e-6, 0, 0), (0.0, 3.1, 0.0), (0.0, 0.0, 0.0)])
def test_se3_log_inverts_exp(spark, axis):
    df = spark.createDataFrame([(1.0, -2.0, 0.5, *map(float, axis))], "a double, b double, c double, d double, e double, f double")
    df, x = geo.staged(df, "x", geo.se3_exp(geo.vec("a", "b", "c"), geo.vec("d", "e", "f")))
    tau, phi = geo.se3_log(x)
    assert np.allclose(df.select(*tau, *phi).first(), (1.0, -2.0, 0.5, *axis), atol=1e-6)


def test_adjoint_moves_tangents_across(spark):
    """x exp(a) = exp(Ad a) x."""
    df = spark.range(1)
    df, x = geo.staged(df, "x", geo.se3_exp(geo.vec(0.4, -0.1, 0.8), geo.vec(0.2, 0.5, -0.3)))
    a = (geo.vec(0.1, 0.2, -0.4), geo.vec(-0.3, 0.1, 0.25))
    df, moved = geo.staged(df, "m", geo.se3_adj(x, *a))
    df, l = geo.staged(df, "l", geo.se3_exp(*a))  # noqa: E741
    df, r = geo.staged(df, "r", geo.se3_exp(*moved))
    left, right = geo.se3_mul(x, l), geo.se3_mul(r, x)
    got = df.select(*left.t, *left.q, *right.t, *right.q).first()
    assert np.allclose(got[:7], got[7:])


def test_gravity_round_trip(spark):
    r, p = geo.rp_from_gravity(geo.gravity_from_rp(F.lit(0.3), F.lit(-0.4)))
    assert np.allclose(spark.range(1).select(r, p).first(), (0.3, -0.4))


def test_projection_behind_the_camera(spark):
    u, v = cam.pinhole_project(geo.vec(1.0, 2.0, -3.0), 10.0, 10.0, 5.0, 5.0)
    assert tuple(spark.range(1).select(u, v).first()) == (15.0, 25.0)
    with pytest.raises(ValueError):
        cam.intrinsics_dim("SIMPLE_DIVISIONAL")


def test_scatter_gaps_and_ties(spark):
    rows = spark.createDataFrame([(0, 5.0, 0), (0, 5.0, 1), (2, -1.0, 2)], "i int, x double, at int")
    got = {r["index"]: (r.value, r.arg) for r in segments.scatter(rows, "i", "x", "max", 3, "at").collect()}
    assert got == {0: (5.0, 0), 1: (0.0, None), 2: (-1.0, 2)}
    with pytest.raises(ValueError):
        segments.scatter(rows, "i", "x", "median")


def test_lower_median_and_singular_fit(spark):
    rows = spark.createDataFrame([(float(x), 1.0) for x in (4, 1, 3, 2)], "y double, x double")
    assert rows.agg(segments.lower_median("y")).first()[0] == 2.0
    assert tuple(segments.scale_shift(rows, [], "x", "y").first()) == (None, None)


def test_neighbourhoods_match_numpy(spark):
    x = np.random.default_rng(1).normal(size=(5, 6))
    df = spark.createDataFrame([(0, v, u, float(x[v, u])) for v in range(5) for u in range(6)], "g int, v int, u int, value double")
    pad = np.pad(x, 2, mode="edge")
    want = np.array([[np.log(np.exp(3 * pad[v : v + 5, u : u + 5]).sum()) / 3 for u in range(6)] for v in range(5)])
    got = grids.soft_dilate(df, ["g"], 5, 6, 2, 3.0).toPandas().set_index(["v", "u"]).value
    assert all(abs(got[v, u] - want[v, u]) < 1e-9 for v in range(5) for u in range(6))


@pytest.mark.parametrize("bits", ["0000", "1111", "1001", "0110"])
def test_rle_round_trip(spark, bits):
    df = spark.createDataFrame([(1, k % 2, k // 2, int(b)) for k, b in enumerate(bits)], "g int, v int, u int, b int")
    code = grids.rle_encode(df, ["g"], F.col("b") == 1, 2, 2)
    assert code.select(grids.rle_area(F.col("counts"))).first()[0] == bits.count("1")
    back = {(r.v, r.u) for r in grids.rle_decode(code, ["g"], "counts", 2).collect()}
    assert back == {(k % 2, k // 2) for k, b in enumerate(bits) if b == "1"}


def test_phrases_with_colons_and_names(spark):
    df = spark.range(1).select(text.parse_phrases(F.lit("0: background\n7: a: b\n")).alias("m"), text.caption(F.lit(" A Cat ")).alias("c"), text.clock_seconds(F.lit("01:02:03.5")).alias("s"), text.version_numbers(F.lit("1.2.x+3")).alias("v"))
    r = df.first()
    assert (r.m, r.c, r.s, r.v) == ({0: "background", 7: "a: b"}, "a cat.", 3723.5, [1, 2])


def test_suppression_and_regions(spark):
    boxes = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (0, 3, 20.0, 20.0, 30.0, 30.0, 0.1)], "g int, id int, x0 double, y0 double, x1 double, y1 double, s double")
    assert {r.id for r in greedy.suppress_boxes(boxes, ["g"], ["x0", "y0", "x1", "y1"], "s", "id", 0.5).collect()} == {1, 3}
    cells = spark.createDataFrame([(0, v, u, (v, u) in {(0, 0), (3, 3), (3, 4), (4, 4)}) for v in range(5) for u in range(5)], "g int, v int, u int, on boolean")
    left = {(r.v, r.u) for r in greedy.small_regions(cells, ["g"], "on", 2).where("on").collect()}
    assert left == {(3, 3), (3, 4), (4, 4)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 40), (7, 7), (99, 99)], "a long, b long")
    got = {r.id: r.component for r in greedy.components(edges).collect()}
    assert got == {**{k: 0 for k in range(21)}, 40: 40, 50: 40, 99: 99}


def test_umeyama_matches_a_known_similarity(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(40, 3))
    R, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    R *= np.sign(np.linalg.det(R))
    q = 1.7 * p @ R.T + [1, 2, 3]
    df = spark.createDataFrame(pd.DataFrame(np.c_[p, q], columns=list("abcxyz"))).withColumn("k", F.lit(1))
    r = align.align_points(df, ["k"], ["a", "b", "c"], ["x", "y", "z"]).first()
    assert np.allclose([r[f"r{i}{j}"] for i in range(3) for j in range(3)], R.ravel(), atol=1e-6)
    assert np.allclose((r.t0, r.t1, r.t2, r.scale), (1, 2, 3, 1.7), atol=1e-6)
    few = align.align_points(df.limit(2), ["k"], ["a", "b", "c"], ["x", "y", "z"]).first()
    assert few.r00 == 1.0


def test_rigid_alignment_finds_the_offset(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(30):
        R, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        R *= np.sign(np.linalg.det(R))
        p = rng.normal(size=3)
        rows.append([1, *p, *R.ravel(), *(p + R @ [0.3, -0.2, 0.1] + [1, 0, 2])])
    names = ["k", "px", "py", "pz", *(f"m{k}" for k in range(9)), "x", "y", "z"]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=names))
    _, offset = align.align_rigid(df, ["k"], names[1:13], ["x", "y", "z"], 6)
    o = offset.first()
    assert np.allclose((o.o0, o.o1, o.o2), (0.3, -0.2, 0.1), atol=0.05)


def test_blocks_match_dense_algebra(spark):
    rng = np.random.default_rng(2)
    A = rng.normal(size=(4, 6))
    rows = [(i // 2, j // 3, i % 2, j % 3, float(A[i, j])) for i in range(4) for j in range(6)]
    a = spark.createDataFrame(rows, "i int, j int, r int, c int, x double")
    got = blocks.tmult(a, a).toPandas()
    M = np.zeros((6, 6))
    for t in got.itertuples():
        M[t.i * 3 + t.r, t.j * 3 + t.c] = t.x
    assert np.allclose(M, A.T @ A)
    used = blocks.ravel_mapping(a.where("i > 0"))
    assert [tuple(r) for r in used.collect()] == [(1, 0)]


def _graph():
    n, h, w = 5, 4, 5
    k = np.arange(n)
    poses = np.zeros((n, 7))
    poses[:, 0], poses[:, 1], poses[:, 2], poses[:, 6] = np.linspace(0, 0.08, n), [0, 0.01, -0.005, 0.015, 0.02], np.linspace(0, 0.025, n), 1
    v, u = np.mgrid[:h, :w]
    disps = 0.72 + 0.015 * u + 0.02 * v + 0.025 * k[:, None, None]
    i, j = np.array([1, 2, 3, 4, 0]), np.array([0, 0, 1, 2, 2])
    return solver.Graph(poses, disps, np.array([38.0, 38.0, 19.5, 15.5]), i, j, np.zeros((5, h, w, 2)), np.full((5, h, w, 2), 1.0))


def test_jacobians_match_differences():
    g = _graph()
    uv, _, Ji, Jj, Jz, Jf = solver.reproject(g)
    eps = 1e-6
    for c in range(6):
        xi = np.zeros(6)
        xi[c] = eps
        for k, J, ends in ((1, Jj, g.j), (1, Ji, g.i)):
            h = _graph()
            h.poses[k] = solver.pose_mul(solver.pose_exp(xi), h.poses[k])
            d = (solver.reproject(h, False)[0] - uv) / eps
            assert np.allclose(d[ends == k], J[ends == k][..., c], atol=1e-3)
    h = _graph()
    h.disps = h.disps + eps
    assert np.allclose((solver.reproject(h, False)[0] - uv) / eps, Jz, atol=1e-3)
    h = _graph()
    h.intrinsics = h.intrinsics + [eps, eps, 0, 0]
    assert np.allclose((solver.reproject(h, False)[0] - uv) / eps, Jf, atol=1e-3)


def test_adjustment_lowers_the_energy():
    g = _graph()
    g.target = solver.reproject(g, False)[0] + 0.2 * np.sin(np.arange(g.target.size)).reshape(g.target.shape)
    energy = solver.adjust(g, np.full(g.disps.shape, 0.1), iterations=4, damping=1e-4, ep=1e-4)
    assert energy[-1] < energy[0]
    still = _graph().poses[0]
    assert np.allclose(g.poses[0], still)


def test_robust_kernels(spark):
    r = spark.createDataFrame([(0.5,), (2.0,), (10.0,)], "r double")
    assert [x[0] for x in r.select(segments.robust_weight("huber", F.col("r"), 1.0)).collect()] == [1.0, 0.5, 0.1]
    assert [x[0] for x in r.select(segments.robust_weight("off", F.col("r"), 1.0)).collect()] == [1.0] * 3
    with pytest.raises(ValueError):
        segments.robust_weight("other", F.col("r"), 1.0)


def test_models_and_codecs(spark, tmp_path):
    with pytest.raises(ValueError):
        models.make("nothing-l")
    with pytest.raises(ValueError):
        models.make("intensity-l", "PANORAMA")
    image = np.random.default_rng(0).integers(0, 255, (6, 7, 3)).astype(np.uint8)
    assert (codecs.png_decode(codecs.png_encode(image)) == image).all()
    frames = spark.createDataFrame([("clip", 0, 2, 3, [1.0, 2.0, 3.0, 0.5, 0.25, 8.0]), ("clip", 1, 2, 3, [float("nan")] * 6)], "stream_id string, frame_idx long, height int, width int, depth array<float>")
    data = artifacts.depth_files(frames).first().content
    members = codecs.zip_members(bytes(data))
    (tmp_path / "depth").mkdir()
    (tmp_path / "depth" / "clip.zip").write_bytes(codecs.zip_build([*members, ("00002.exr", b"broken")]))
    back = {r.frame_idx: list(r.depth) for r in artifacts.read_depth(spark, str(tmp_path / "depth")).collect()}
    assert back[0] == [1.0, 2.0, 3.0, 0.5, 0.25, 8.0]
    assert np.isnan(back[2]).all() and len(back[2]) == 6


def test_poses_phrases_and_folders_round_trip(spark, tmp_path):
    pose = np.eye(4).ravel().tolist()
    frames = spark.createDataFrame([("clip", 3, pose, [1.0, 2.0, 3.0, 4.0]), ("clip", 5, None, None)], "stream_id string, frame_idx long, pose array<double>, intrinsics array<double>")
    for kind, build in (("pose", artifacts.pose_files), ("intr", artifacts.intrinsics_files)):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "clip.npz").write_bytes(bytes(build(frames).first().content))
    r = artifacts.read_poses(spark, str(tmp_path / "pose")).collect()
    assert [(x.stream_id, x.frame_idx, list(x.pose)) for x in r] == [("clip", 3, pose)]
    (tmp_path / "cam").mkdir()
    (tmp_path / "cam" / "clip_camera.txt").write_text("3: MEI\n")
    i = artifacts.read_intrinsics(spark, str(tmp_path / "intr"), str(tmp_path / "cam")).first()
    assert (i.camera_type, list(i.intrinsics)) == ("MEI", [1.0, 2.0, 3.0, 4.0])
    (tmp_path / "ph").mkdir()
    (tmp_path / "ph" / "clip.txt").write_text("0: background\n1: a: b\n")
    assert {(x.id, x.phrase) for x in artifacts.read_phrases(spark, str(tmp_path / "ph")).collect()} == {(0, "background"), (1, "a: b")}
    (tmp_path / "walk").mkdir()
    for name in ("frame_2.png", "frame_10.png", "note.txt"):
        (tmp_path / "walk" / name).write_bytes(b"x")
    got = artifacts.frame_folder(spark, str(tmp_path / "walk")).orderBy("frame_idx").collect()
    assert [x.path.rsplit("/")[-1] for x in got] == ["frame_10.png", "frame_2.png"]


def test_keyframes_streaming_equals_batch(spark, tmp_path):
    from streamloom.streaming import events as live

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "event_id", "value")
    e.orderBy("ts", "event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = live.keyframes(live.read_stream(spark, str(tmp_path / "in"), e.schema), 60.0)
    q = s.writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id for r in spark.table("kept").collect()}
    want = windows.keep_moved(e, ["user_id"], ["ts", "event_id"], "value", 60.0).where("keyframe")
    assert got == {r.event_id for r in want.collect()}


def test_places_without_one_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = streams.place(rows, ["k"], "at")
    assert got.where("k <> at").count() == 0 and got.count() == 1000
    assert streams.place(rows.where("false"), ["k"], "at").count() == 0


def test_map_points_and_warps(spark):
    from streamloom.operators import maps
    from streamloom.sources import colmap

    p = spark.createDataFrame([(1.0, 2.0, 3.0, 0.5, 1.0, 2.0)], "x double, y double, z double, r double, g double, b double")
    assert colmap.point_lines(p, ["x"]).first().line == "1 1.000000 2.000000 3.000000 127 255 255 0"
    still = {"rtx": 0.0, "rty": 0.0, "rtz": 0.0, "rqx": 0.0, "rqy": 0.0, "rqz": 0.0, "rqw": 1.0, **{f"{k}{n}": v for n in (1, 2) for k, v in (("fx", 4.0), ("fy", 4.0), ("cx", 2.0), ("cy", 2.0))}}
    cells = spark.createDataFrame([(0, v, u, float(v * 4 + u), 2.0) for v in range(4) for u in range(4)], "k int, v int, u int, value double, depth double")
    cells = cells.withColumns({n: F.lit(v) for n, v in still.items()})
    got = {(r.v, r.u): r.value for r in maps.reprojected(cells, 4, 4, ["k"]).where("weight > 1e-30").collect()}
    assert got == pytest.approx({(v, u): v * 4.0 + u for v in range(4) for u in range(4)})
    kept = maps.keep_consistent(spark.createDataFrame([(0, 1.0, 3, False), (0, 0.1, 3, False), (0, 1.0, 0, False), (0, 1.0, 3, True)], "kf int, disp double, n int, masked boolean"), F.col("n"), F.lit(5))
    assert kept.count() == 1


def test_long_streams_fold_in_linear_time(spark):
    """One stream of 100,000 rows with nulls: average and keyframes as a loop finds them."""
    n = 100_000
    values = [None if i % 7 == 3 else float((i * 7919) % 1000) for i in range(n)]
    rows = spark.createDataFrame(pd.DataFrame({"k": 1, "i": range(n), "x": pd.Series(values, dtype="Float64").astype(object).where(pd.notna(values), None)}), "k int, i long, x double")
    average = last = None
    kept = []
    for x in values:
        if x is not None:
            average = x if average is None else 0.9 * average + 0.1 * x
        keep = last is None or (x is not None and abs(x - last) >= 300.0)
        last = x if keep else last
        kept.append(keep)
    got = windows.ema(rows, ["k"], ["i"], "x", 0.9).collect()
    assert [(r.k, r.n) for r in got] == [(1, n)] and abs(got[0].ema - average) < 1e-6
    found = windows.keep_moved(rows, ["k"], ["i"], "x", 300.0).orderBy("i").collect()
    assert [r.keyframe for r in found] == kept and [r.x for r in found] == values


def test_folds_of_empty_and_null_streams(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, None), (2, 0, None), (2, 1, 5.0), (2, 2, 5.5), (2, 3, None)], "k int, i int, x double")
    assert {(r.k, r.n, r.ema) for r in windows.ema(rows, ["k"], ["i"], "x", 0.5).collect()} == {(1, 2, None), (2, 4, 5.25)}
    kept = {(r.k, r.i): r.keyframe for r in windows.keep_moved(rows, ["k"], ["i"], "x", 1.0).collect()}
    assert kept == {(1, 0): True, (1, 1): True, (2, 0): True, (2, 1): True, (2, 2): False, (2, 3): False}
    assert windows.ema(rows.limit(0), ["k"], ["i"], "x").count() == 0
    assert windows.keep_moved(rows.limit(0), ["k"], ["i"], "x", 1.0).count() == 0


def test_chain_of_fits_with_negative_scales(spark):
    """400 windows whose scales change their sign: each is brought back to the first one's values."""
    rng = np.random.default_rng(5)
    truth = rng.normal(size=400 * 4 + 8)
    rows, scales = [], []
    for w in range(400):
        s, t = (-1.0) ** (w // 3) * (0.5 + (w % 5) / 4), float(w % 4)
        scales.append((w, s, t))
        rows += [(w, int(i), float((truth[i] - t) / s)) for i in range(4 * w, 4 * w + 8)]
    f = spark.createDataFrame(rows, "w int, i int, x double").withColumn("k", F.lit(1))
    got = sorted((r.w, r.scale, r.shift) for r in maps.chained_windows(f, ["k"], "w", "i", "x", 4).collect())
    # The first window is the measure of all.
    _, s0, t0 = scales[0]
    assert np.allclose([g[1:] for g in got], [(s / s0, (t - t0) / s0) for _, s, t in scales], atol=1e-6)


def test_random_poses_are_normal_and_repeat(spark):
    rows = spark.range(20_000).select("id")
    x = rows.select("id", geo.random_normal(3, "id").alias("x"), geo.random_normal(4, "id").alias("y"))
    m = x.agg(F.avg("x"), F.stddev("x"), F.corr("x", "y"), F.skewness("x"), F.kurtosis("x")).first()
    assert np.allclose(m, (0, 1, 0, 0, 0), atol=0.08)
    assert x.repartition(7).exceptAll(x).count() == 0


def test_sizes_by_hand(spark):
    one = spark.range(1).select(F.lit(480).alias("h"), F.lit(642).alias("w"))
    k = tuple(map(F.lit, (100.0, 100.0, 321.0, 240.0)))
    h, w, (fx, fy, cx, cy) = images.process_size(F.col("h"), F.col("w"), k)
    # 504 / 642 of 480 is 376.8: 377 rows, of which 378 is the nearest multiple of 14.
    assert tuple(one.select(h, w, fx, cy).first()) == pytest.approx((378, 504, 100 * 504 / 642, 240 * 378 / 480))
    h, w, (fx, fy, cx, cy) = images.process_size(F.col("h"), F.col("w"), k, method="lower_bound_crop")
    # 504 rows, 674.1 columns: 674, cut to 672 by one on the left.
    assert tuple(one.select(h, w, fy, cx).first()) == pytest.approx((504, 672, 105.0, 321 * 674 / 642 - 1))
    assert tuple(one.select(*images.fit_margins(F.col("h"), F.col("w"), 32, "left")).first()) == (0, 30, 0, 0)
    assert tuple(one.select(*images.fit_margins(F.col("h"), F.col("w"), 32, crop=True)).first()) == (-1, -1, 0, 0)
    for bad in ("upper_resize", "upper_bound_pad"):
        with pytest.raises(ValueError):
            images.process_size(F.col("h"), F.col("w"), k, method=bad)


def test_colours_marks_and_nulls(spark):
    levels = spark.createDataFrame([(0,), (31,), (128,), (255,)], "l int")
    assert [r.c for r in levels.select(images.jet(F.col("l")).alias("c")).collect()] == [[0, 0, 128], [0, 0, 252], [130, 255, 126], [128, 0, 0]]
    phrases = F.create_map(F.lit(1), F.lit("sky"), F.lit(2), F.lit("tree"))
    ids = spark.createDataFrame([(1,), (2,), (None,)], "i int")
    assert [r.s for r in ids.select(images.sky(F.col("i"), phrases).alias("s")).collect()] == [True, False, False]
    assert [r.s for r in ids.select(images.sky(F.col("i"), F.lit(None).cast("map<int,string>")).alias("s")).collect()] == [False] * 3
    s = spark.createDataFrame([(0, 1, 0, 0, 4, 2), (0, 2, 3, 3, 3, 3), (0, 3, -2, 1, 1, 1)], "k int, n int, x0 int, y0 int, x1 int, y1 int")
    got = {(r.v, r.u): r.n for r in images.lines_raster(s, ["k"], "n", 4, 5).collect()}
    assert got == {(0, 0): 1, (1, 1): 3, (1, 2): 1, (2, 3): 1, (2, 4): 1, (3, 3): 2, (1, 0): 3}
    with pytest.raises(Exception, match="pose is missing"):
        ids.select(text.required(F.col("i"), "pose")).collect()


def test_antialiased_resize_keeps_constants_and_enlarges(spark):
    c = spark.createDataFrame([(0, v, u, 2.5) for v in range(5) for u in range(7)], "k int, v int, u int, value double")
    for size in ((2, 3), (9, 11), (5, 7)):
        got = images.resize_antialiased(c, ["k"], 5, 7, *size).collect()
        assert len(got) == size[0] * size[1] and all(abs(r.value - 2.5) < 1e-12 for r in got)


@pytest.mark.parametrize("shape", ["lattice", "cloud", "one place", "few"])
def test_nearest_equals_brute_force(spark, shape):
    """Ties, repeated points, several keys, keys without rows, null coordinates."""
    rng = np.random.default_rng(3)
    n = 4 if shape == "few" else 700
    x = {"lattice": rng.integers(0, 12, (n, 2)), "cloud": rng.normal(size=(n, 2)), "one place": np.ones((n, 2)), "few": rng.normal(size=(n, 2))}[shape].astype(float)
    p = pd.DataFrame({"k": np.arange(n) % 2, "id": rng.permutation(n), "a": x[:, 0], "b": x[:, 1]})
    q = spark.createDataFrame([(int(r.k), int(r.id), float(r.a), float(r.b)) for r in p.itertuples()] + [(0, 9000, None, 1.0), (7, 9001, 1.0, 1.0)], "k int, id long, a double, b double")
    r = q.where("k <> 7 and id % 3 <> 0")
    got = {(x.k, x["query"], x["rank"]): (x["row"], x.dist2) for x in joins.nearest(q, r, ["k"], ["a", "b"], 5, "id", "id").collect()}
    want = {}
    for s in p.itertuples():
        others = p[(p.k == s.k) & (p.id % 3 != 0)]
        d = (s.a - others.a) ** 2 + (s.b - others.b) ** 2
        for rank, (dist, i) in enumerate(sorted(zip(d, others.id))[:5], 1):
            want[s.k, s.id, rank] = (i, dist)
    assert got == want


def test_half_missing_image_is_filled_in_seconds(spark):
    """One frame of 384 x 512, half of it missing in one piece: all pairs would be ten thousand million."""
    import time

    cells = spark.range(384 * 512).select(F.lit(0).alias("k"), F.floor(F.col("id") / 512).cast("int").alias("v"), (F.col("id") % 512).cast("int").alias("u"))
    cells = cells.withColumn("value", F.when((F.col("u") < 200) | (F.col("v") % 7 == 0), F.col("v").cast("double")))
    began = time.monotonic()
    got = joins.infill_mean(cells, ["k"]).agg(F.count("value"), F.max(F.abs(F.col("value") - F.col("v")))).first()
    assert got[0] == 384 * 512 and got[1] < 8
    assert time.monotonic() - began < 120


def test_uncertainty_of_a_calibration(spark):
    """Noise of a known deviation moves the found cameras as far as the inverse normal matrix says."""
    rng = np.random.default_rng(2)
    u, v = (x.ravel().astype(float) for x in np.meshgrid(np.arange(20, 640, 40), np.arange(20, 480, 40)))
    roll, pitch, f, noise = 0.1, -0.15, 420.0, 0.01
    x, y = (u - 320) / f, (v - 240) / f
    g = np.array([-np.sin(roll) * np.cos(pitch), -np.cos(roll) * np.cos(pitch), np.sin(pitch)])
    a, b = -(g[0] - g[2] * x), -(g[1] - g[2] * y)
    n = np.hypot(a, b)
    fields = [a / n, b / n, np.arcsin((x * g[0] + y * g[1] + g[2]) / np.sqrt(x * x + y * y + 1))]
    rows = [(i, u.tolist(), v.tolist(), *((w + noise * rng.normal(size=len(u))).tolist() for w in fields)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, u array<double>, v array<double>, up_x array<double>, up_y array<double>, latitude array<double>")
    got = solver.calibrate(df, "k", (480, 640), uncertainty=True).toPandas()
    for name in ("roll", "pitch", "vfov"):
        # A field of view's deviation is given for half of the focal length's variance.
        said = got[f"{name}_sd"].mean() * noise * (2**0.5 if name == "vfov" else 1)
        assert 0.7 < got[name].std() / said < 1.4
    assert (got.gravity_sd >= got[["roll_sd", "pitch_sd"]].max(axis=1) - 1e-12).all()


def test_pose_log_inverts_exp():
    turns = np.random.default_rng(1).uniform(-1.8, 1.8, (50, 6))  # below half a turn
    xi = np.concatenate([turns, np.zeros((1, 6)), np.full((1, 6), 1e-7)])
    assert np.allclose(solver.pose_log(solver.pose_exp(xi)), xi, atol=1e-7)


def test_both_sides_reach_the_optimum_in_few_passes(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = solver.pose_exp(r.normal(size=(300, 6)) * 0.8)
    moved = lambda v: solver.pose_mul(solver.pose_mul(np.broadcast_to(solver.pose_exp(v[:6]), x.shape), x), np.broadcast_to(solver.pose_exp(v[6:]), x.shape))
    y = solver.pose_mul(moved(r.normal(size=12) * 0.3), solver.pose_exp(r.normal(size=(300, 6)) * 0.3))
    v, _ = solver.damped_least_squares(lambda v: solver.pose_log(solver.pose_mul(solver.pose_inv(moved(v)), y)).ravel() / np.sqrt(300), np.zeros(12), steps=60)
    passes, sums = [], solver._both_sides_sums
    monkeypatch.setattr(solver, "_both_sides_sums", lambda *a: passes.append(1) or sums(*a))
    left, right, error = solver.fit_both_sides(x, y)
    assert len(passes) <= 30  # numeric derivatives take 25 a step
    assert np.allclose(left, solver.pose_exp(v[:6]), atol=1e-5) and np.allclose(right, solver.pose_exp(v[6:]), atol=1e-5)
    assert np.isclose(error, (solver.pose_log(solver.pose_mul(solver.pose_inv(moved(v)), y)) ** 2).sum() / 300)
    monkeypatch.setattr(solver, "ROWS_AT_ONCE", 64)
    assert np.allclose(solver.fit_both_sides(x, y)[0], left, atol=1e-9)
    names = [f"{s}{n}" for s in "ab" for n in "px py pz qx qy qz qw".split()]
    rows = [("k", *a, *b) for a, b in zip(x.tolist(), y.tolist())] + [("k", None, *x[0, 1:].tolist(), *y[0].tolist()), ("none", None, *x[0, 1:].tolist(), *y[0].tolist())]
    got = solver.align_both_sides(spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in names)), ["k"], names[:7], names[7:]).collect()
    assert [g.k for g in got] == ["k"] and np.isclose(got[0].error, error) and np.allclose([got[0][f"r{i}"] for i in range(7)], right, atol=1e-9)
