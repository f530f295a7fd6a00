"""As-of, band, nearest-neighbour and box joins, and joins along edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], direction: str = "backward") -> DataFrame:
    """left with the values of the last right row at or before (backward) or the first strictly after (forward).

    A union and a running last/first: one shuffle by `by`, no pairs. Right rows of equal time count
    before left ones for backward; where several right rows share a time, use a unique one.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    tag = F.lit(0) if direction == "backward" else F.lit(1)
    found = F.struct(*values)
    l = left.select(*by, F.col(at).alias("_at"), F.lit(1 if direction == "backward" else 0).alias("_side"), F.struct(*left.columns).alias("_left"))  # noqa: E741
    r = right.select(*by, F.col(at).alias("_at"), tag.alias("_side"), found.alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True)
    if direction == "backward":
        w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w))
    else:
        # Left rows (0) come after the right rows (1) of their own time in this descending order's reverse, so equal times don't count.
        w = Window.partitionBy(*by).orderBy(F.col("_at").desc(), F.col("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w))
    both = both.where(F.col("_left").isNotNull())
    return both.select("_left.*", *(F.col("_hit")[v].alias(f"{direction}_{v}") for v in values))


def band_edges(nodes: DataFrame, by: list[str], at: str, radius: int, least: int = 0) -> DataFrame:
    """(i, j) of each group with least < |i - j| <= radius, by exploding the offsets: linear, not a theta join."""
    offsets = [d for d in range(-radius, radius + 1) if abs(d) > least]
    i = nodes.select(*by, F.col(at).alias("i"), F.explode(F.array(*map(F.lit, offsets))).alias("_d"))
    j = nodes.select(*by, F.col(at).alias("j"))
    return i.withColumn("j", F.col("i") + F.col("_d")).drop("_d").join(j, [*by, "j"]).select(*by, "i", "j")


def new_edges(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct edges that are not known."""
    return edges.select("i", "j").distinct().join(known.select("i", "j").distinct(), ["i", "j"], "left_anti")


def evict_oldest(edges: DataFrame, cap: int, age: str, order: str) -> DataFrame:
    """active: whether an edge is among the `cap` youngest (ties: the later inserted); the order of insertion is unique."""
    young = edges.orderBy(F.col(age), F.col(order).desc()).limit(cap).select(F.col(order).alias("_young"))
    # At most cap rows, so the broadcast is bounded by the parameter.
    return edges.join(F.broadcast(young), F.col(order) == F.col("_young"), "left").withColumn("active", F.col("_young").isNotNull()).drop("_young")


def expand_multiview(edges: DataFrame, n_views: int, cross: DataFrame | None = None, view_offset: int = 0) -> DataFrame:
    """Each edge for every view: (i, j, view_i, view_j); self edges take their view from cross (i, view, other)."""
    out = edges.select("i", "j", F.explode(F.sequence(F.lit(0), F.lit(n_views - 1))).alias("view_i"))
    out = out.withColumn("view_j", (F.col("view_i") + view_offset) % n_views)
    if cross is not None:
        c = cross.select(F.col("i").alias("_i"), F.col("view").alias("_v"), F.col("other").alias("_o"))
        out = out.join(c, (F.col("i") == F.col("_i")) & (F.col("view_i") == F.col("_v")), "left")
        out = out.withColumn("view_j", F.when((F.col("i") == F.col("j")) & F.col("_o").isNotNull(), F.col("_o")).otherwise(F.col("view_j"))).drop("_i", "_v", "_o")
    return out


def track_edges(nodes: DataFrame, at: str, length: int) -> DataFrame:
    """(i, i - m - 1) for m below length - 1, within bounds."""
    return nodes.select(F.col(at).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(length - 2))).alias("m")).withColumn("j", F.col("i") - F.col("m") - 1).where("j >= 0").select("i", "j")


def shared_keypoints(tracks: DataFrame, source: int, target: int) -> DataFrame:
    """Keypoints seen in both frames, with their places in each."""
    s = tracks.where(F.col("frame_idx") == source).select("view_idx", "kp_id", F.col("u").alias("u_s"), F.col("v").alias("v_s"))
    t = tracks.where(F.col("frame_idx") == target).select("view_idx", "kp_id", F.col("u").alias("u_t"), F.col("v").alias("v_t"))
    return s.join(t, ["view_idx", "kp_id"])


#: Points of a leaf of the tree that nearest() searches.
LEAF = 64


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    """Positions of points in leaves of LEAF at most, by halving the widest side again and again."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        part = x[at]
        widest = int(np.argmax(part.max(0) - part.min(0)))
        order = np.argpartition(part[:, widest], len(at) // 2)
        todo += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]
    return out


def _search(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, positions) of each query's k nearest points, ties to the smaller position; missing ones at infinity.

    A leaf of queries meets the leaves of points from the nearest box on, until the next box is further
    than the k-th point of each of its queries.
    """
    near, found = np.full((len(queries), k), np.inf), np.full((len(queries), k), len(points))
    leaves = _leaves(points)
    low, high = (np.array([f(points[at], 0) for at in leaves]) for f in (np.min, np.max))
    least = np.array([at.min() for at in leaves])
    for block in _leaves(queries):
        q = queries[block]
        gap = np.maximum(0.0, np.maximum(low - q.max(0), q.min(0) - high))
        gap = sum(g * g for g in gap.T)
        order = np.lexsort((least, gap))
        best, where = near[block], found[block]
        for at in range(0, len(order), 4):
            # A box at just the k-th distance may hold a tie, but only where its least position is smaller.
            far, last = best[:, -1].max(), where[:, -1].max()
            some = [j for j in order[at : at + 4] if gap[j] < far or (gap[j] == far and least[j] < last)]
            if not some:
                break
            rows = np.concatenate([leaves[j] for j in some])
            d = sum((a[:, None] - b[None]) ** 2 for a, b in zip(q.T, points[rows].T))
            d, w = np.concatenate([best, d], 1), np.concatenate([where, np.broadcast_to(rows, d.shape)], 1)
            first = np.lexsort((w, d), axis=1)[:, :k]
            best, where = np.take_along_axis(d, first, 1), np.take_along_axis(w, first, 1)
        near[block], found[block] = best, where
    return near, found


def nearest(queries: DataFrame, rows: DataFrame, key: list[str], dims: list[str], k: int, query_id: str, row_id: str) -> DataFrame:
    """The k nearest rows of each query of the same key: squared distance, ties to the smaller id.

    One task searches a key's points (a frame's, a view's: the caller bounds them) by a tree, without
    forming pairs. Points with a null or NaN coordinate take no part; fewer than k rows give fewer ranks.
    """

    def points(df: DataFrame, name: str) -> DataFrame:
        at = [F.col(d).cast("double").alias(f"_{i}") for i, d in enumerate(dims)]
        out = df.select(*key, F.col(name).alias("_id"), *at)
        for i in range(len(dims)):
            out = out.where(F.col(f"_{i}").isNotNull() & ~F.isnan(f"_{i}"))
        return out

    q, r = points(queries, query_id), points(rows, row_id)
    found = [*(q.schema[c] for c in key), T.StructField("query", q.schema["_id"].dataType), T.StructField("row", r.schema["_id"].dataType)]
    schema = T.StructType([*found, T.StructField("dist2", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    names = [f"_{i}" for i in range(len(dims))]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("_id")
        a, b = (np.column_stack([t.column(n).to_numpy() for n in names]) for t in (left, right))
        if not len(a) or not len(b):
            a = a[:0]
            near, at = np.empty((0, k)), np.empty((0, k), int)
        else:
            near, at = _search(a, b, k)
        hit, rank = np.nonzero(at < len(b))
        columns = [left.column(c).take(pa.array(hit)) for c in [*key, "_id"]]
        columns += [right.column("_id").take(pa.array(at[hit, rank])), pa.array(near[hit, rank]), pa.array((rank + 1).astype(np.int32))]
        return pa.table(columns, names=schema.names)

    return q.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(search, schema)


def infill_mean(cells: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """Missing cells (value is null) by the mean of their k nearest known cells of the same grid."""
    numbered = cells.withColumn("_id", F.col("v") * 65536 + F.col("u"))
    near = nearest(numbered.where("value is null"), numbered.where("value is not null"), key, ["v", "u"], k, "_id", "_id")
    known = numbered.where("value is not null").select(*key, F.col("_id").alias("row"), "value")
    fill = near.join(known, [*key, "row"]).groupBy(*key, F.col("query").alias("_id")).agg(F.avg("value").alias("_fill"))
    return numbered.join(fill, [*key, "_id"], "left").withColumn("value", F.coalesce("value", "_fill")).drop("_id", "_fill")


def iou(a: list[Column], b: list[Column], eps: float = 1e-6) -> tuple[Column, Column]:
    """(intersection over union, union) of boxes (x0, y0, x1, y1)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / (union + eps), union


def giou(a: list[Column], b: list[Column], eps: float = 1e-6) -> Column:
    i, union = iou(a, b, eps)
    area = F.greatest(F.greatest(a[2], b[2]) - F.least(a[0], b[0]), F.lit(0.0)) * F.greatest(F.greatest(a[3], b[3]) - F.least(a[1], b[1]), F.lit(0.0))
    return i - (area - union) / (area + eps)


def cxcywh_to_xyxy(cx, cy, w, h) -> list[Column]:
    return [cx - 0.5 * w, cy - 0.5 * h, cx + 0.5 * w, cy + 0.5 * h]


def xyxy_to_cxcywh(x0, y0, x1, y1) -> list[Column]:
    return [(x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0]


def xyxy_to_xywh(x0, y0, x1, y1) -> list[Column]:
    return [x0, y0, x1 - x0, y1 - y0]


def uncrop_box(box: list[Column], x: Column, y: Column) -> list[Column]:
    """A box (x0, y0, x1, y1) of a crop whose corner is (x, y), in the image."""
    return [box[0] + x, box[1] + y, box[2] + x, box[3] + y]


def uncrop_point(point: list[Column], x: Column, y: Column) -> list[Column]:
    return [point[0] + x, point[1] + y]


def near_crop_edge(box: list[Column], crop: list[float], image: list[float], atol: float = 20.0) -> Column:
    """Whether a box side is within atol of its crop's side, but not of the image's."""
    out = F.lit(False)
    for b, c, i in zip(box, crop, image):
        out = out | ((F.abs(b - c) <= atol) & ~(F.abs(b - i) <= atol))
    return out


def new_objects(pixels: DataFrame, key: list[str], track: str, seg: str, start_id: int, overlap: float = 0.8, area: int = 200, most: int = 255) -> DataFrame:
    """Segments that are new: enough area, mostly over untracked background; numbered from start_id in their order, up to `most`."""
    s = pixels.where(F.col(seg) != 0).groupBy(*key, seg).agg(F.count(F.lit(1)).alias("area"), F.avg((F.col(track) == 0).cast("double")).alias("free"))
    s = s.where((F.col("free") >= overlap) & (F.col("area") >= area))
    w = Window.partitionBy(*key).orderBy(seg) if key else Window.orderBy(seg)
    return s.withColumn("new_id", F.row_number().over(w) + start_id - 1).where(F.col("new_id") <= most)


def correlation(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Inner product of two feature arrays over a scale."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x) / scale


def frame_distance(flow: DataFrame, key: list[str], full: Column, still: Column, valid: Column, beta: float = 0.3, least_valid: float = 0.75, far: float = 1000.0) -> DataFrame:
    """beta * mean full flow + (1 - beta) * mean translation-only flow of an edge; `far` where too few pixels are valid."""
    v = valid.cast("double")
    mean = lambda c: F.sum(c * v) / F.greatest(F.sum(v), F.lit(1e-12))
    return flow.groupBy(*key).agg(F.when(F.avg(v) < least_valid, F.lit(far)).otherwise(beta * mean(full) + (1 - beta) * mean(still)).alias("distance"))
