"""Queries over frame streams: ranges, zips, folds, windows, joins by time, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as names
from ..operators import greedy, joins, segments, streams, windows
from .base import EV, frames, query, rounded


@query(f"WITH {EV} SELECT stream_id, raw_frame_idx, CAST((raw_frame_idx - 2) // 3 AS BIGINT) AS frame_idx, event_id FROM ev WHERE raw_frame_idx >= 2 AND raw_frame_idx < 40 AND (raw_frame_idx - 2) % 3 = 0")
def seek_range(read):
    return streams.seek(frames(read), 2, 40, 3).select("stream_id", "raw_frame_idx", "frame_idx", "event_id")


@query("SELECT user_id AS stream_id, count(*) AS n_frames, CAST(10.0 AS DOUBLE) AS fps, CAST(greatest(ceil((least(count(*), 40) - 2) / 3.0), 0) AS BIGINT) AS seek_frames FROM events GROUP BY 1")
def stream_meta(read):
    m = streams.stream_meta(frames(read).select("stream_id", "raw_frame_idx"), 30.0, step=3)
    return m.select("stream_id", "n_frames", "fps", streams.seek_length(F.col("n_frames"), 2, 40, 3).alias("seek_frames"))


@query(f"""WITH {EV}, o AS (SELECT o_custkey AS stream_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS raw_frame_idx, o_totalprice AS attribute FROM orders)
SELECT stream_id, raw_frame_idx, event_id, attribute FROM ev LEFT JOIN o USING (stream_id, raw_frame_idx)""")
def assign_attributes(read):
    o = read("orders").select(F.col("o_custkey").alias("stream_id"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("attribute"))
    o = streams.number(o, ["stream_id"], ["o_orderdate", "o_orderkey"]).select("stream_id", "raw_frame_idx", "attribute")
    return streams.assign_attributes(frames(read).select("stream_id", "raw_frame_idx", "event_id"), o, ["stream_id", "raw_frame_idx"])


@query("""SELECT conv_id, CAST(turn // 2 AS BIGINT) AS frame, max(CASE WHEN turn % 2 = 0 THEN role END) AS role_0, max(CASE WHEN turn % 2 = 1 THEN role END) AS role_1
FROM conversations GROUP BY 1, 2 HAVING count(DISTINCT turn % 2) = 2""")
def multiview_zip(read):
    c = read("conversations").select("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("frame"), (F.col("turn") % 2).cast("int").alias("view"), "role")
    return streams.multiview_zip(c, "view", "conv_id", "frame", ["role"], 2)


@query("""SELECT conv_id, min(n) AS shortest, max(n) AS longest FROM (SELECT conv_id, turn % 2 AS view, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1 HAVING min(n) <> max(n)""")
def unequal_views(read):
    return streams.unequal_views(read("conversations").withColumn("view", F.col("turn") % 2), "view", "conv_id")


@query("""SELECT event_id, round((value - min(value) OVER w) / CASE WHEN max(value) OVER w = min(value) OVER w THEN 1.0 ELSE max(value) OVER w - min(value) OVER w END, 6) AS normalised
FROM events WINDOW w AS (PARTITION BY user_id)""")
def multipass_minmax(read):
    return rounded(segments.zero_one(read("events").select("user_id", "event_id", "value"), ["user_id"], "value").select("event_id", "normalised"))


@query("SELECT user_id, event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1, 2")
def phrase_last_wins(read):
    return streams.last_wins(read("events"), ["user_id"], "event_type", "value", ["ts", "event_id"])


@query("SELECT p_partkey, lower(trim(p_name)) || CASE WHEN trim(lower(p_name)) LIKE '%.' THEN '' ELSE '.' END AS caption, 'out/mask/' || p_partkey || '.txt' AS path FROM part")
def captions_and_paths(read):
    return read("part").select("p_partkey", names.caption(F.col("p_name")).alias("caption"), names.artifact_path(F.lit("out"), F.col("p_partkey").cast("string"), "phrases").alias("path"))


@query("""SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS name, 'out/state/' || regexp_extract(url, '([^/]+)$', 1) || '_info.pkl' AS info FROM pages""")
def artifact_paths(read):
    p = read("pages").select("page_id", F.regexp_extract("url", "([^/]+)$", 1).alias("name"))
    return p.select("page_id", "name", names.artifact_path(F.lit("out"), F.col("name"), "info").alias("info"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def skip_existing(read):
    return streams.skip_existing(read("documents").select("doc_id"), read("labels"), "doc_id")


@query("""SELECT split_part(url, '/', 3) AS host, count(*) AS clips, min(page_id) AS first_page FROM pages WHERE starts_with(url, 'http') GROUP BY 1""")
def prefix_manifest(read):
    p = read("pages").where(F.col("url").startswith("http"))
    return p.groupBy(F.split("url", "/")[2].alias("host")).agg(F.count(F.lit(1)).alias("clips"), F.min("page_id").alias("first_page"))


@query("""SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS seconds, CAST(hour(ts) AS VARCHAR) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(second(ts) AS VARCHAR), 2, '0') AS shown FROM events""")
def clip_seconds(read):
    clock = F.date_format("ts", "HH:mm:ss")
    e = read("events").select("event_id", names.clock_seconds(clock).alias("seconds"))
    return e.select("event_id", "seconds", names.format_seconds(F.col("seconds")).alias("shown"))


@query("""SELECT n_nationkey, [n_nationkey, 2, 7] AS numbers FROM nation""")
def version_numbers(read):
    text = F.concat(F.col("n_nationkey").cast("string"), F.lit(".2.rc1.7+local.9"))
    return read("nation").select("n_nationkey", names.version_numbers(text).cast("array<int>").alias("numbers"))


@query("""SELECT n_nationkey, n_name || ': x' AS phrase FROM nation""")
def parse_phrases(read):
    lines = F.concat(F.lit("0: background\n"), (F.col("n_nationkey") + 1).cast("string"), F.lit(": "), F.col("n_name"), F.lit(": x\n"))
    m = read("nation").select("n_nationkey", names.parse_phrases(lines).alias("m"))
    return m.select("n_nationkey", F.element_at("m", (F.col("n_nationkey") + 1).cast("int")).alias("phrase"))


@query(f"""WITH {EV} SELECT stream_id, raw_frame_idx, round(coalesce(sum(abs(d)) OVER (PARTITION BY stream_id ORDER BY raw_frame_idx), 0), 4) AS length FROM
(SELECT stream_id, raw_frame_idx, coalesce(value - lag(value) OVER (PARTITION BY stream_id ORDER BY raw_frame_idx), 0) AS d FROM ev)""")
def traj_length(read):
    return rounded(windows.trajectory_length(frames(read), ["stream_id"], ["raw_frame_idx"], ["value"]).select("stream_id", "raw_frame_idx", "length"), 4)


@query(f"""WITH {EV}, k AS (SELECT stream_id, raw_frame_idx AS kf FROM ev WHERE raw_frame_idx % 7 = 0)
SELECT stream_id, raw_frame_idx, (SELECT max(kf) FROM k WHERE k.stream_id = ev.stream_id AND kf <= raw_frame_idx) AS backward_kf,
       (SELECT min(kf) FROM k WHERE k.stream_id = ev.stream_id AND kf > raw_frame_idx) AS forward_kf FROM ev""")
def asof_keyframes(read):
    f = frames(read).select("stream_id", "raw_frame_idx")
    k = f.where("raw_frame_idx % 7 = 0").select("stream_id", "raw_frame_idx", F.col("raw_frame_idx").alias("kf"))
    f = joins.asof(f, k, ["stream_id"], "raw_frame_idx", ["kf"], "backward")
    return joins.asof(f, k, ["stream_id"], "raw_frame_idx", ["kf"], "forward")


@query(f"""WITH {EV}, k AS (SELECT stream_id, raw_frame_idx AS kf, value FROM ev WHERE raw_frame_idx % 5 = 0)
SELECT e.stream_id, e.raw_frame_idx, round(a.value + CASE WHEN b.kf IS NULL THEN 0 ELSE (b.value - a.value) * (e.raw_frame_idx - a.kf) / 5.0 END, 4) AS interpolated
FROM ev e JOIN k a ON a.stream_id = e.stream_id AND a.kf = e.raw_frame_idx - e.raw_frame_idx % 5 LEFT JOIN k b ON b.stream_id = e.stream_id AND b.kf = a.kf + 5""")
def interpolate_keyframes(read):
    f = frames(read).select("stream_id", "raw_frame_idx", "value")
    k = f.where("raw_frame_idx % 5 = 0").select("stream_id", "raw_frame_idx", F.col("raw_frame_idx").alias("kf"), "value")
    left = f.select("stream_id", "raw_frame_idx")
    left = joins.asof(left, k, ["stream_id"], "raw_frame_idx", ["kf", "value"], "backward")
    left = joins.asof(left, k, ["stream_id"], "raw_frame_idx", ["kf", "value"], "forward")
    u = (F.col("raw_frame_idx") - F.col("backward_kf")) / (F.col("forward_kf") - F.col("backward_kf"))
    return rounded(left.select("stream_id", "raw_frame_idx", (F.col("backward_value") + F.coalesce((F.col("forward_value") - F.col("backward_value")) * u, F.lit(0.0))).alias("interpolated")), 4)


@query(f"""WITH {EV} SELECT a.stream_id, a.raw_frame_idx AS i, b.raw_frame_idx AS j FROM ev a JOIN ev b ON a.stream_id = b.stream_id AND abs(a.raw_frame_idx - b.raw_frame_idx) BETWEEN 2 AND 3""")
def band_edges(read):
    return joins.band_edges(frames(read).select("stream_id", "raw_frame_idx"), ["stream_id"], "raw_frame_idx", 3, 1)


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT stream_id, raw_frame_idx, value AS ema FROM ev WHERE raw_frame_idx = 0 UNION ALL
SELECT e.stream_id, e.raw_frame_idx, r.ema * 0.99 + e.value * (1 - 0.99) FROM r JOIN ev e ON e.stream_id = r.stream_id AND e.raw_frame_idx = r.raw_frame_idx + 1)
SELECT stream_id, CAST(max(raw_frame_idx) + 1 AS INTEGER) AS n, round(arg_max(ema, raw_frame_idx), 6) AS ema FROM r GROUP BY 1""")
def ema_099(read):
    return rounded(windows.ema(frames(read), ["stream_id"], ["raw_frame_idx"], "value", 0.99))


@query(f"""WITH {EV} SELECT stream_id, raw_frame_idx, round(coalesce(last_value(CASE WHEN value > 100 THEN value / 100 END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY raw_frame_idx ROWS UNBOUNDED PRECEDING), 1.0), 6) AS scale FROM ev""")
def carry_forward_scale(read):
    f = windows.carry_forward(frames(read), ["stream_id"], ["raw_frame_idx"], F.when(F.col("value") > 100, F.col("value") / 100), 1.0, "scale")
    return rounded(f.select("stream_id", "raw_frame_idx", "scale"))


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT stream_id, raw_frame_idx, value, value AS last, true AS keyframe FROM ev WHERE raw_frame_idx = 0 UNION ALL
SELECT e.stream_id, e.raw_frame_idx, e.value, CASE WHEN abs(e.value - r.last) >= 60 THEN e.value ELSE r.last END, abs(e.value - r.last) >= 60 FROM r JOIN ev e ON e.stream_id = r.stream_id AND e.raw_frame_idx = r.raw_frame_idx + 1)
SELECT stream_id, raw_frame_idx, value, keyframe FROM r""")
def motion_filter(read):
    return windows.keep_moved(frames(read), ["stream_id"], ["raw_frame_idx"], "value", 60.0)


@query(f"""WITH {EV} SELECT stream_id, CAST(raw_frame_idx // 16 AS BIGINT) AS batch, count(*) AS frames, round(sum(value), 4) AS total FROM ev GROUP BY 1, 2""")
def infill_chunks(read):
    return rounded(streams.batches(frames(read), "raw_frame_idx", 16).groupBy("stream_id", "batch").agg(F.count(F.lit(1)).alias("frames"), F.sum("value").alias("total")), 4)


@query(f"""WITH {EV}, w AS (SELECT stream_id, raw_frame_idx, value, raw_frame_idx // 7 AS own, raw_frame_idx % 7 AS p FROM ev)
SELECT stream_id, raw_frame_idx, round(CASE WHEN own > 0 AND p < 3 THEN (value + own) * (p + 1) / 4.0 + (value + own - 1) * (1 - (p + 1) / 4.0) ELSE value + own END, 6) AS blended,
       CASE WHEN own > 0 AND p < 3 THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS n_windows FROM w""")
def overlap_crossfade(read):
    f = frames(read).select("stream_id", "raw_frame_idx", "value")
    return rounded(windows.overlap_blend(f, ["stream_id"], "raw_frame_idx", F.col("value") + F.col("window_no"), 10, 3))


@query(f"""WITH {EV}, c AS (SELECT stream_id, raw_frame_idx // 10 AS kf, count(*) AS n FROM ev WHERE value > 50 GROUP BY 1, 2)
SELECT stream_id, CAST(kf AS BIGINT) AS kf, n, CAST(coalesce(sum(n) OVER (PARTITION BY stream_id ORDER BY kf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c""")
def packinfo_prefix(read):
    c = frames(read).where("value > 50").groupBy("stream_id", F.floor(F.col("raw_frame_idx") / 10).cast("long").alias("kf")).agg(F.count(F.lit(1)).alias("n"))
    return windows.exclusive_prefix(c, ["stream_id"], ["kf"], "n", "start")


@query(f"""WITH {EV} SELECT stream_id, raw_frame_idx, round(a + 0.5 * (a - b), 4) AS guess FROM
(SELECT stream_id, raw_frame_idx, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY raw_frame_idx))""")
def extrapolate_pose(read):
    return rounded(windows.extrapolated(frames(read), ["stream_id"], ["raw_frame_idx"], "value", "guess").select("stream_id", "raw_frame_idx", "guess"), 4)


@query(f"""WITH {EV}, t AS (SELECT stream_id, raw_frame_idx, value > 40 AS ok, lead(value > 40) OVER w AS nxt, lead(raw_frame_idx) OVER w AS next_at FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY raw_frame_idx))
SELECT stream_id, raw_frame_idx, next_at FROM t WHERE ok AND nxt""")
def track_segments(read):
    t = frames(read).withColumn("ok", F.col("value") > 40)
    return windows.track_segments(t, ["stream_id"], "raw_frame_idx", "ok").select("stream_id", "raw_frame_idx", "next_at")


@query(f"""WITH {EV}, t AS (SELECT *, CASE WHEN lag(value > 60) OVER w <> (value > 60) THEN 1 ELSE 0 END AS turn FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY raw_frame_idx)),
s AS (SELECT *, sum(turn) OVER (PARTITION BY stream_id ORDER BY raw_frame_idx) AS run FROM t)
SELECT stream_id, CAST(run AS BIGINT) AS run, any_value(value > 60) AS value, min(raw_frame_idx) AS first, count(*) AS length FROM s GROUP BY stream_id, run""")
def islands_of_motion(read):
    i = windows.islands(frames(read).withColumnRenamed("value", "x"), ["stream_id"], ["raw_frame_idx"], F.col("x") > 60)
    return i.select("stream_id", F.col("run").cast("long").alias("run"), "value", F.col("first").cast("long").alias("first"), "length")


@query(f"""WITH {EV} SELECT a.stream_id, a.raw_frame_idx, count(*) FILTER (WHERE abs(b.value - a.value) < 30) AS count FROM ev a LEFT JOIN ev b
ON a.stream_id = b.stream_id AND abs(a.raw_frame_idx - b.raw_frame_idx) BETWEEN 1 AND 3 GROUP BY 1, 2""")
def depth_filter_count(read):
    return windows.neighbours_agree(frames(read).select("stream_id", "raw_frame_idx", "value"), ["stream_id"], "raw_frame_idx", "value", 3, 30.0)


@query(f"""WITH {EV} SELECT stream_id, CASE WHEN raw_frame_idx > 5 THEN raw_frame_idx - 1 ELSE raw_frame_idx END AS raw_frame_idx, event_id FROM ev WHERE raw_frame_idx <> 5""")
def second_newest_removal(read):
    return streams.remove_and_renumber(frames(read).select("stream_id", "raw_frame_idx", "event_id"), "raw_frame_idx", 5)


@query("""SELECT user_id, phrase, round(total, 4) AS total FROM (SELECT user_id, p, string_agg(event_type, ' ' ORDER BY event_id) AS phrase, sum(value) AS total,
row_number() OVER (PARTITION BY user_id ORDER BY sum(value) DESC, p) AS k FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM events) WHERE event_type <> 'click' GROUP BY user_id, p) WHERE k = 1""")
def phrase_argmax(read):
    return rounded(greedy.phrase_argmax(read("events"), ["user_id"], "event_id", "event_type", "value", "click").select("user_id", "phrase", "total"), 4)


@query("""SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def optional_zip(read):
    return read("documents").select("doc_id", "n_chars").join(read("labels").select("doc_id", "quality"), "doc_id", "left")


@query("""SELECT event_type, list_sort([x FOR x IN [CASE WHEN max(value) > 300 THEN 'pose' END, CASE WHEN min(value) < 1 THEN 'mask' END] IF x IS NOT NULL]) AS present FROM events GROUP BY 1""")
def attribute_sets(read):
    g = read("events").groupBy("event_type").agg(F.when(F.max("value") > 300, F.lit(1)).alias("pose"), F.when(F.min("value") < 1, F.lit(1)).alias("mask"))
    return g.select("event_type", F.array_sort(streams.attributes(g)).alias("present"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_window(read):
    from ..streaming import events as live

    return rounded(live.tumbling(read("events"), "1 hour").select("start", "event_type", "n", "total"), 4)


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS turn FROM events)) GROUP BY user_id, s""")
def session_windows(read):
    from ..streaming import events as live

    return live.sessions(read("events"), "30 minutes").select("user_id", "start", "n")


@query("""SELECT date_trunc('hour', ts) + to_hours(h) AS start, count(*) AS n FROM events, (SELECT unnest([0, -1]) AS h) GROUP BY 1""")
def sliding_window(read):
    from ..streaming import events as live

    return live.sliding(read("events"), "2 hours", "1 hour").select("start", "n")
