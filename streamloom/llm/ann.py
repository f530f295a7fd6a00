"""Nearest neighbours by low-dimensional stable projections in a kd-tree, with a chi-square stopping test.

Vectors of length 1 are projected by a few Gaussian directions. For a neighbour at distance d the
squared projected distance over d squared follows a chi-square law, so once the projected distance of
what is still unseen exceeds what that law allows a neighbour at the k-th distance found so far (but
for a chosen probability), the search may stop. The upper levels of the kd-tree, fitted on a bounded
sample, deal all rows out to cells; each cell's rows have the lower levels. A query first searches its
own cell, which bounds its k-th distance, and then only the cells that the test does not rule out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Projected dimensions (even, for the closed form of the chi-square law).
DIRECTIONS = 8
#: Probability with which the test keeps a neighbour.
KEEP = 0.985
#: Rows of a cell that are aimed at, rows of a leaf, and rows that the upper levels are fitted on, with those of a cell at least.
CELL_ROWS, LEAF_ROWS, SAMPLE_ROWS, SAMPLE_LEAF = 4096, 256, 1 << 16, 16
#: Candidates of each query and cell beyond k that are scored again exactly: of those farther than this below the k-th all, of the others the smallest ids.
SPARE, TIE = 12, 1e-11


def chi_square_bound(p: float, m: int = DIRECTIONS) -> float:
    """The x below which a chi-square variable of m (even) degrees of freedom is with probability p."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng(1000 + dim).standard_normal((dim, DIRECTIONS))


def split_tree(points: np.ndarray, rows: int) -> tuple[np.ndarray, list]:
    """(leaf of each point, splits): a kd-tree cut at medians of the widest dimension; a split is (dim, value, left, right), a leaf its number."""
    leaf = np.zeros(len(points), np.int64)
    count = 0

    def cut(at: np.ndarray):
        nonlocal count
        if len(at) > rows:
            spread = points[at].max(0) - points[at].min(0)
            d = int(spread.argmax())
            value = float(np.median(points[at, d]))
            left = points[at, d] < value
            if left.any() and not left.all():
                return (d, value, cut(at[left]), cut(at[~left]))
        leaf[at] = count
        count += 1
        return count - 1

    splits = cut(np.arange(len(points)))
    return leaf, [splits, count]


def _assign(splits, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)

    def walk(node, at):
        if not isinstance(node, tuple):
            out[at] = node
            return
        d, value, left, right = node
        go = points[at, d] < value
        walk(left, at[go])
        walk(right, at[~go])

    walk(splits, np.arange(len(points)))
    return out


def _boxes(splits, count: int) -> np.ndarray:
    """Of each leaf: the lower and upper ends of its half-open box."""
    box = np.zeros((count, 2, DIRECTIONS))

    def walk(node, lo, hi):
        if not isinstance(node, tuple):
            box[node] = lo, hi
            return
        d, value, left, right = node
        h, low = hi.copy(), lo.copy()
        h[d] = low[d] = value
        walk(left, lo, h)
        walk(right, low, hi)

    walk(splits, np.full(DIRECTIONS, -np.inf), np.full(DIRECTIONS, np.inf))
    return box


def _box_distance(box: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of queries to boxes, in blocks of queries."""
    return np.stack([(np.maximum(np.maximum(box[:, 0] - x, x - box[:, 1]), 0) ** 2).sum(1) for x in q]) if len(q) else np.zeros((0, len(box)))


def search_cell(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, keep: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query number, row number) of the nearest found; bound: squared distances known to hold k rows."""
    unit = lambda a: a / np.sqrt((a * a).sum(1))[:, None]
    R = _directions(x.shape[1])
    ux, uq = unit(x), unit(q)
    px, pq = ux @ R, uq @ R
    leaf, (_, count) = split_tree(px, LEAF_ROWS)
    order = np.argsort(leaf, kind="stable")
    edges = np.searchsorted(leaf[order], np.arange(count + 1))
    lo, hi = np.full((count, DIRECTIONS), np.inf), np.full((count, DIRECTIONS), -np.inf)
    np.minimum.at(lo, leaf, px)
    np.maximum.at(hi, leaf, px)
    limit = chi_square_bound(keep)
    top = k + SPARE
    best_d, best_i = np.full((len(q), top), np.inf), np.full((len(q), top), -1)
    for a in range(0, len(q), 256):
        b = min(len(q), a + 256)
        away = _box_distance(np.stack([lo, hi], 1), pq[a:b])
        near = np.argsort(away, axis=1, kind="stable")
        live = np.arange(b - a)
        for r in range(count):
            at = near[live, r]
            worst = np.minimum(best_d[a + live, k - 1], bound[a + live])
            live_now = away[live, at] <= (worst + TIE) * limit + TIE
            live, at = live[live_now], at[live_now]
            if not len(live):
                break
            for one in np.unique(at):
                who = a + live[at == one]
                rows = order[edges[one] : edges[one + 1]]
                d = np.maximum(2 - 2 * (uq[who] @ ux[rows].T), 0)
                d[qid[who][:, None] == ids[rows][None, :]] = np.inf
                alld, alli = np.concatenate([best_d[who], d], 1), np.concatenate([best_i[who], np.broadcast_to(rows, d.shape)], 1)
                # Those nearer than the k-th by more than a rounding error, then those that tie with it by their ids.
                kth = np.partition(alld, k - 1, axis=1)[:, k - 1 : k]
                known = np.concatenate([ids, np.full(1, np.iinfo(np.int64).max)])[alli]
                place = np.where(alld < kth - TIE, 0, np.where(alld <= kth + TIE, 1, 2))
                sel = np.lexsort((np.where(place == 1, known, 0), place), axis=1)[:, :top]
                near_d, near_i = np.take_along_axis(alld, sel, 1), np.take_along_axis(alli, sel, 1)
                sel = np.argsort(near_d, axis=1, kind="stable")
                best_d[who], best_i[who] = np.take_along_axis(near_d, sel, 1), np.take_along_axis(near_i, sel, 1)
    found = np.isfinite(best_d)
    return np.repeat(np.arange(len(q)), top).reshape(len(q), top)[found], best_i[found]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", keep: float = KEEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found by cosine of each query row, but for its own.

    Nearest first, ties (scores equal to 12 decimals, beyond which they are rounding errors) to the smaller id; all candidates where there are fewer than k. Vectors that
    are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
    id; vectors of different lengths are never compared. Of equal vectors only the k + 1 smallest ids
    can be among the results, so no more of them are searched. Repeated rows of one id are one. An empty
    table gives an empty result; other columns are left out.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False)))
    dim = F.size("embedding").alias("dim")
    every = fine(vectors).withColumn("hash", F.xxhash64("embedding"))
    crowded = every.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("hash")
    rows = every.select("vec_id", "embedding", dim)
    if not (crowded := checkpointed(crowded)).isEmpty():
        few = every.join(crowded, "hash", "left_semi").withColumn("same", F.row_number().over(Window.partitionBy("hash", "embedding").orderBy("vec_id"))).where(F.col("same") <= k + 1)
        rows = every.join(crowded, "hash", "left_anti").select("vec_id", "embedding", dim).unionByName(few.select("vec_id", "embedding", dim))
    asked = fine(queries).select("vec_id", "embedding", dim)
    counts = {r[0]: r[1] for r in rows.groupBy("dim").count().collect()}
    trees = {}
    for d, n in counts.items():
        share = rows.where(F.col("dim") == d).orderBy(F.xxhash64("vec_id")).limit(min(n, SAMPLE_ROWS)).select("embedding").toArrow()
        x = _matrix(share.column(0))
        p = (x / np.sqrt((x * x).sum(1))[:, None]) @ _directions(d)
        _, (splits, count) = split_tree(p, max(SAMPLE_LEAF, CELL_ROWS * len(p) // max(n, 1)))
        trees[d] = (splits, _boxes(splits, count))
    shared = spark.sparkContext.broadcast(trees)
    limit = chi_square_bound(keep)

    def place(batches):
        for batch in batches:
            dims = np.array(batch.column(2))
            cell = np.zeros(len(dims), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _matrix(batch.column(1).take(pa.array(at)))
                cell[at] = _assign(shared.value[int(d)][0], (x / np.sqrt((x * x).sum(1))[:, None]) @ _directions(int(d))) if int(d) in shared.value else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "embedding", "dim", "cell"])

    def route(batches):
        for batch in batches:
            dims, home, bound = np.array(batch.column(2)), np.array(batch.column(3)), np.array(batch.column(4))
            for d in np.unique(dims):
                if int(d) not in shared.value:
                    continue
                at = np.flatnonzero(dims == d)
                part = batch.take(pa.array(at))
                x = _matrix(part.column(1))
                away = _box_distance(shared.value[int(d)][1], (x / np.sqrt((x * x).sum(1))[:, None]) @ _directions(int(d)))
                go = away <= (bound[at][:, None] + TIE) * limit + TIE
                go[np.arange(len(at)), home[at]] = False
                who, cell = np.nonzero(go)
                new = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([new.column(0), new.column(1), new.column(2), pa.array(cell.astype(np.int64)), new.column(4)], names=["vec_id", "embedding", "dim", "cell", "bound"])

    def within(cands: pa.Table, asks: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not cands.num_rows or not asks.num_rows:
            return out.empty_table()
        ids, x = np.array(cands.column("vec_id")), _matrix(cands.column("embedding"))
        qid, q = np.array(asks.column("vec_id")), _matrix(asks.column("embedding"))
        who, row = search_cell(ids, x, qid, q, np.array(asks.column("bound")), k, keep)
        a, b = q[who], x[row]
        score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        return pa.table([pa.array(qid[who]), pa.array(ids[row]), pa.array(score)], schema=out)

    shape = "vec_id long, embedding array<double>, dim int, cell long"
    placed = rows.mapInArrow(place, shape)
    # A cell of more rows than are aimed at (equal projections can't be cut) is dealt out in parts, each of which its queries search.
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / (4 * CELL_ROWS)).cast("int").alias("parts")).where("parts > 1").select(F.col("dim").alias("d"), F.col("cell").alias("c"), "parts")
    parts = F.broadcast(checkpointed(parts))  # a row for each large cell, of at most SAMPLE_ROWS / SAMPLE_LEAF
    of = lambda df: df.join(parts, (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")), "left").drop("d", "c").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = of(placed).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    ask = lambda df: of(df).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    homes = asked.mapInArrow(place, shape).withColumn("bound", F.lit(float("inf")))
    cells = dealt.groupBy("dim", "cell", "part")
    result = "query_id long, vec_id long, score double"
    first = cells.cogroup(ask(homes).groupBy("dim", "cell", "part")).applyInArrow(within, result)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "vec_id")
    ranked = lambda df: df.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    known = ranked(first)
    kth = known.where(F.col("rank") == k).select(F.col("query_id").alias("known_id"), (2 - 2 * F.col("score")).alias("kth"))
    more = homes.drop("bound").join(kth, F.col("vec_id") == F.col("known_id"), "left").select("vec_id", "embedding", "dim", "cell", F.greatest(F.coalesce("kth", F.lit(float("inf"))), F.lit(0.0)).alias("bound"))
    second = cells.cogroup(ask(more.mapInArrow(route, shape + ", bound double")).groupBy("dim", "cell", "part")).applyInArrow(within, result)
    return ranked(known.drop("rank").unionByName(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
