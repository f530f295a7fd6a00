"""Greedy selection: suppression, edge proposals, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import settled


def top_k(rows: DataFrame, key: list[str], score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def suppress_boxes(rows: DataFrame, key: list[str], box: list[str], score: str, tie: str, threshold: float) -> DataFrame:
    """Greedy non-maximum suppression within each key (an image): by falling score, a box is kept unless its IoU with a kept one is above the threshold.

    One image's boxes meet in one task; images are independent of each other.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([score, tie], ascending=[False, True])
        b = p[box].to_numpy(float)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        live, kept = np.ones(len(b), bool), []
        for i in range(len(b)):
            if not live[i]:
                continue
            kept.append(i)
            w = np.maximum(np.minimum(b[i, 2], b[:, 2]) - np.maximum(b[i, 0], b[:, 0]), 0)
            h = np.maximum(np.minimum(b[i, 3], b[:, 3]) - np.maximum(b[i, 1], b[:, 1]), 0)
            union = area[i] + area - w * h
            live &= ~(w * h > threshold * np.where(union > 0, union, 1))
        return p.iloc[kept]

    return rows.groupBy(*key).applyInPandas(run, rows.schema)


def propose_edges(distances: DataFrame, key: list[str], existing: DataFrame | None = None, radius: int = 2, nms: int = 2, threshold: float = 16.0, most: int = 48) -> DataFrame:
    """Edges (i, j) of each key's frame graph: neighbourhoods first, then by rising distance, each suppressing those near it.

    distances: key, i, j, d. Within `radius` (and one more) frames edges are forced in both directions.
    An edge at (i, j) rules out those within an L1 ball of radius max(min(|i - j| - 2, nms), 0). Pairs
    at `threshold` or beyond are not proposed; more than `most` edges end the search, before a pair of
    directions is added. Graphs of different keys are independent; one graph's pairs meet in one task.
    """
    kinds = dict(distances.dtypes)
    have = existing.select(*key, "i", "j", F.lit(None).cast("double").alias("d")) if existing is not None else None
    rows = distances.select(*key, "i", "j", F.col("d").cast("double").alias("d"))
    rows = rows.withColumn("_known", F.lit(False)) if have is None else rows.withColumn("_known", F.lit(False)).unionByName(have.withColumn("_known", F.lit(True)))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        gone: set[tuple[int, int]] = set()

        def suppress(i: int, j: int) -> None:
            r = max(min(abs(i - j) - 2, nms), 0)
            for a in range(-r, r + 1):
                for b in range(-(r - abs(a)), r - abs(a) + 1):
                    gone.add((i + a, j + b))

        for i, j in p.loc[p["_known"], ["i", "j"]].itertuples(index=False):
            suppress(i, j)
        p = p[~p["_known"]].sort_values(["d", "i", "j"])
        out = []
        for i, j in sorted(p.loc[((p["i"] - p["j"]) > 0) & ((p["i"] - p["j"]) <= radius + 1), ["i", "j"]].itertuples(index=False, name=None)):
            out += [(i, j), (j, i)]
            suppress(i, j)
        for i, j, d in p[["i", "j", "d"]].itertuples(index=False):
            if not d < threshold or len(out) > most:
                break
            if i - radius < j or (i, j) in gone:
                continue
            out += [(i, j), (j, i)]
            suppress(i, j)
        got = pd.DataFrame(out, columns=["i", "j"])
        for k in key:
            got[k] = p[k].iloc[0] if len(p) else None
        return got[[*key, "i", "j"]]

    return rows.groupBy(*key).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in key), f"i {kinds['i']}", f"j {kinds['j']}"]))


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id) of all ids in the undirected edges (a, b), by joins that halve the distances to the smallest.

    Ends when nothing changes; each round's table is written, so lineage stays short.
    """
    pairs = settled(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    lone = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = settled(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == state:
            roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            out = pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
            return out.unionByName(lone.join(out.select("id"), "id", "left_anti"))
        state = now


def small_regions(cells: DataFrame, key: list[str], on: str, least: int, mode: str = "islands") -> DataFrame:
    """Masks without 8-connected islands (or holes) below `least` cells; the largest island stays if all are small.

    One mask's cells meet in one task; masks are independent of each other.
    """
    if mode not in ("islands", "holes"):
        raise ValueError(mode)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        value = p[on].to_numpy(bool) if mode == "islands" else ~p[on].to_numpy(bool)
        at = {(v, u): i for i, (v, u) in enumerate(zip(p["v"], p["u"])) if value[i]}
        label, sizes = {}, []
        for start in at:
            if start in label:
                continue
            label[start] = len(sizes)
            stack, n = [start], 0
            while stack:
                v, u = stack.pop()
                n += 1
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        q = (v + a, u + b)
                        if q in at and q not in label:
                            label[q] = len(sizes)
                            stack.append(q)
            sizes.append(n)
        small = {k for k, n in enumerate(sizes) if n < least}
        if mode == "islands" and sizes and len(small) == len(sizes):
            small.discard(int(np.argmax(sizes)))
        flip = np.array([value[i] and label[(v, u)] in small for i, (v, u) in enumerate(zip(p["v"], p["u"]))], bool)
        p = p.copy()
        p[on] = np.where(flip, ~p[on].to_numpy(bool), p[on].to_numpy(bool))
        return p

    return cells.groupBy(*key).applyInPandas(run, cells.schema)


def phrase_argmax(tokens: DataFrame, key: list[str], at: str, token: str, score: str, stop: str = ".") -> DataFrame:
    """Of each key the phrase (tokens between stops) with the largest sum of scores; ties to the earlier."""
    w = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    t = tokens.withColumn("_phrase", F.coalesce(F.sum((F.col(token) == stop).cast("int")).over(w), F.lit(0))).where(F.col(token) != stop)
    each = t.groupBy(*key, "_phrase").agg(F.sum(score).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, token))), lambda s: s[token]), " ").alias("phrase"))
    return each.groupBy(*key).agg(F.max_by(F.struct("phrase", "total"), F.struct("total", -F.col("_phrase"))).alias("_b")).select(*key, "_b.phrase", "_b.total")
