"""Two-dimensional grids as rows (grid, v, u, value): neighbourhoods, resampling, splatting and run lengths.

A neighbourhood is an explode of each cell to the cells that see it and a group-by: one shuffle keyed by
(grid, v, u), with partial aggregation before it, whatever the number of grids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_grid(rows: DataFrame, key: list[str], array: str, width: int, value: Column | None = None) -> DataFrame:
    """Rows (key, v, u, value) of a flat row-major array."""
    out = rows.select(*key, F.posexplode(array).alias("_p", "_x"))
    return out.select(*key, F.floor(F.col("_p") / width).cast("int").alias("v"), (F.col("_p") % width).cast("int").alias("u"), (value if value is not None else F.col("_x").cast("double")).alias("value"))


def neighbourhood(cells: DataFrame, key: list[str], radius: int, height: int, width: int, aggs: list[Column], replicate: bool = False) -> DataFrame:
    """Aggregates of `value` over the (2 radius + 1)-square around each cell.

    Cells outside the grid don't count; with replicate the border's cells stand for them, as often.
    """
    offsets = F.sequence(F.lit(-radius), F.lit(radius))

    def targets(c: str, n: int) -> Column:
        seen = F.transform(offsets, lambda d: F.col(c) + d)
        if not replicate:
            return F.filter(seen, lambda t: (t >= 0) & (t < n))
        # A border cell also stands for the cells beyond it, as far as those are within reach of t.
        inner = F.filter(seen, lambda t: (t >= 0) & (t < n))
        low = F.when(F.col(c) == 0, F.flatten(F.transform(F.sequence(F.lit(1), F.lit(radius)), lambda k: F.filter(F.sequence(F.lit(0), F.lit(radius)), lambda t: (t <= radius - k) & (t < n))))).otherwise(F.array().cast("array<int>"))
        high = F.when(F.col(c) == n - 1, F.flatten(F.transform(F.sequence(F.lit(1), F.lit(radius)), lambda k: F.filter(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda t: F.lit(n - 1) - t), lambda t: (t >= n - 1 - radius + k) & (t >= 0))))).otherwise(F.array().cast("array<int>"))
        return F.concat(inner, low, high)

    spread = cells.withColumn("_v", F.explode(targets("v", height))).withColumn("_u", F.explode(targets("u", width)))
    return spread.groupBy(*key, F.col("_v").alias("v"), F.col("_u").alias("u")).agg(*aggs)


def dilate(cells, key, height, width, radius: int = 2, zero_padding: bool = False) -> DataFrame:
    """Maximum of the neighbourhood (replicated or zero borders)."""
    top = F.max("value") if not zero_padding else F.greatest(F.max("value"), F.lit(0.0))
    return neighbourhood(cells, key, radius, height, width, [top.alias("value")])


def erode(cells, key, height, width, radius: int = 2, zero_padding: bool = False) -> DataFrame:
    """Minimum of the neighbourhood; with zero padding cells near the border see a 0."""
    full = (2 * radius + 1) ** 2
    low = F.when(F.count("value") < full, F.least(F.min("value"), F.lit(0.0))).otherwise(F.min("value")) if zero_padding else F.min("value")
    return neighbourhood(cells, key, radius, height, width, [low.alias("value")])


def soft_dilate(cells, key, height, width, radius: int, beta: float) -> DataFrame:
    """log sum exp of beta * value over beta, with replicated borders."""
    agg = F.log(F.sum(F.exp(F.col("value") * beta))) / beta
    return neighbourhood(cells, key, radius, height, width, [agg.alias("value")], replicate=True)


def reliable_depth(cells, key, height, width, radius: int = 2, ratio: float = 0.1, eps: float = 1e-6) -> DataFrame:
    """reliable: (max - min) / (mean + eps) below the ratio and a positive centre; the mean counts cells outside as 0."""
    k2 = float((2 * radius + 1) ** 2)
    stats = neighbourhood(cells, key, radius, height, width, [F.max("value").alias("_hi"), F.min("value").alias("_lo"), (F.sum("value") / k2).alias("_mean")])
    out = cells.join(stats, [*key, "v", "u"])
    return out.select(*key, "v", "u", "value", (((F.col("_hi") - F.col("_lo")) / (F.col("_mean") + eps) < ratio) & (F.col("value") > 0)).alias("reliable"))


def local_maxima(cells, key, height, width, radius: int, rounds: int = 2) -> DataFrame:
    """keep: cells that are the largest of their neighbourhood, or become so once the cells around kept ones are set to 0."""
    cells = cells.withColumn("keep", F.lit(False))
    for r in range(rounds + 1):
        if r:
            near = neighbourhood(cells.withColumn("value", F.col("keep").cast("double")), key, radius, height, width, [(F.max("value") > 0).alias("_near")])
            cells = cells.join(near, [*key, "v", "u"]).withColumn("_x", F.when(F.col("_near"), 0.0).otherwise(F.col("value")))
        else:
            cells = cells.withColumn("_near", F.lit(False)).withColumn("_x", F.col("value"))
        top = neighbourhood(cells.select(*key, "v", "u", F.col("_x").alias("value")), key, radius, height, width, [F.max("value").alias("_top")])
        cells = cells.join(top, [*key, "v", "u"]).withColumn("keep", F.col("keep") | ((F.col("_x") == F.col("_top")) & ~F.col("_near"))).drop("_x", "_top", "_near")
    return cells


def resize_bilinear(cells, key, h: int, w: int, height: int, width: int) -> DataFrame:
    """Each target cell from at most four source cells (pixel centres aligned at half cells, edges clamped)."""

    def taps(n: int, m: int, c: str) -> Column:
        at = F.greatest((F.col(c) + 0.5) * (n / m) - 0.5, F.lit(0.0))
        lo = F.floor(at).cast("int")
        return F.array(F.struct(F.least(lo, F.lit(n - 1)).alias("i"), (1 - (at - lo)).alias("k")), F.struct(F.least(lo + 1, F.lit(n - 1)).alias("i"), (at - lo).alias("k")))

    grid = cells.sparkSession.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("tv"), (F.col("id") % width).cast("int").alias("tu"))
    grid = grid.withColumn("y", F.explode(taps(h, height, "tv"))).withColumn("x", F.explode(taps(w, width, "tu")))
    grid = grid.select("tv", "tu", F.col("y.i").alias("v"), F.col("x.i").alias("u"), (F.col("y.k") * F.col("x.k")).alias("k"))
    # The target grid is a constant of the call, at most 4 * height * width rows.
    return cells.join(F.broadcast(grid), ["v", "u"]).groupBy(*key, F.col("tv").alias("v"), F.col("tu").alias("u")).agg(F.sum(F.col("value") * F.col("k")).alias("value"))


def crop(cells, top: int, bottom: int, left: int, right: int, height: int, width: int) -> DataFrame:
    inside = F.col("v").between(top, height - bottom - 1) & F.col("u").between(left, width - right - 1)
    return cells.where(inside).withColumn("v", F.col("v") - top).withColumn("u", F.col("u") - left)


def uncrop(cells: DataFrame, key: list[str], x: int, y: int, height: int, width: int) -> DataFrame:
    """Masks of a crop whose corner is (x, y) as masks of the whole image, false around the crop."""
    image = cells.select(*key).distinct().withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    inside = cells.select(*key, (F.col("v") + y).alias("v"), (F.col("u") + x).alias("u"), F.col("value").alias("_inside"))
    return image.join(inside, [*key, "v", "u"], "left").select(*key, "v", "u", F.coalesce("_inside", F.lit(False)).alias("value"))


def block_pool(cells, key, factor: int, agg: Column) -> DataFrame:
    return cells.groupBy(*key, F.floor(F.col("v") / factor).cast("int").alias("v"), F.floor(F.col("u") / factor).cast("int").alias("u")).agg(agg.alias("value"))


def valid_min_pool(cells, key, factor: int = 2) -> DataFrame:
    """Least positive value of each block; 0 where there is none, or none up to 1000."""
    low = F.min(F.when(F.col("value") > 0, F.col("value")))
    return block_pool(cells, key, factor, F.when(low <= 1000, low).otherwise(0.0))


def splat(points: DataFrame, key: list[str], x: str, y: str, value: str, height: int, width: int, weight: Column | None = None) -> DataFrame:
    """Forward warp: each point's value on its four cells by bilinear weights, normalised; cells without weight are absent.

    Points lie at cell centres plus a half: the base cell is that of (x - 0.5, y - 0.5).
    """
    fx, fy = F.col(x) - 0.5, F.col(y) - 0.5
    x0, y0 = F.floor(fx), F.floor(fy)
    ax, ay = fx - x0, fy - y0
    w = weight if weight is not None else F.lit(1.0)
    corner = lambda dx, dy, k: F.struct((x0 + dx).cast("int").alias("u"), (y0 + dy).cast("int").alias("v"), (k * w).alias("k"))
    corners = F.array(corner(0, 0, (1 - ax) * (1 - ay)), corner(1, 0, ax * (1 - ay)), corner(0, 1, (1 - ax) * ay), corner(1, 1, ax * ay))
    out = points.select(*key, F.col(value).alias("_d"), F.explode(corners).alias("c")).where((F.col("c.u") >= 0) & (F.col("c.u") < width) & (F.col("c.v") >= 0) & (F.col("c.v") < height))
    sums = out.groupBy(*key, F.col("c.v").alias("v"), F.col("c.u").alias("u")).agg(F.sum(F.col("c.k") * F.col("_d")).alias("_s"), F.sum("c.k").alias("weight"))
    return sums.select(*key, "v", "u", F.when(F.col("weight") > 0, F.col("_s") / F.col("weight")).otherwise(0.0).alias("value"), "weight")


def rle_encode(cells: DataFrame, key: list[str], on: Column, height: int, width: int) -> DataFrame:
    """counts: run lengths of a mask in column-major order, beginning with a run of zeros (0 long if need be).

    Runs are found by one pass over each mask's sorted cells, gathered in an array (a mask's size bounds it).
    """
    place = F.col("u") * height + F.col("v")
    bits = cells.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), on.cast("int").alias("b")))), lambda x: x["b"]).alias("_b"))
    n = F.size("_b")
    turns = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.element_at("_b", i) != F.element_at("_b", i + 1))
    edges = F.concat(F.when(F.element_at("_b", 1) == 1, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))), turns, F.array(n))
    counts = F.transform(F.sequence(F.lit(1), F.size("_e") - 1), lambda i: F.element_at("_e", i + 1) - F.element_at("_e", i))
    return bits.withColumn("_e", edges).select(*key, counts.alias("counts"))


def rle_area(counts: Column) -> Column:
    return F.aggregate(F.filter(counts, lambda x, i: i % 2 == 1), F.lit(0), lambda a, x: a + x)


def rle_decode(rows: DataFrame, key: list[str], counts: str, height: int) -> DataFrame:
    """The cells (v, u) that are set."""
    runs = F.transform(F.sequence(F.lit(1), F.size(counts)), lambda i: F.struct((F.aggregate(F.slice(F.col(counts), 1, i), F.lit(0), lambda a, x: a + x) - F.element_at(counts, i)).alias("s"), F.element_at(counts, i).alias("n"), ((i - 1) % 2).alias("b")))
    on = F.flatten(F.transform(F.filter(runs, lambda r: (r["b"] == 1) & (r["n"] > 0)), lambda r: F.sequence(r["s"], r["s"] + r["n"] - 1)))
    out = rows.select(*key, F.explode(on).alias("_p"))
    return out.select(*key, (F.col("_p") % height).cast("int").alias("v"), F.floor(F.col("_p") / height).cast("int").alias("u"))


def mask_boxes(cells: DataFrame, key: list[str], on: Column) -> DataFrame:
    """x0, y0, x1, y1 of the set cells; zeros for an empty mask."""
    pick = lambda f, c: F.coalesce(f(F.when(on, F.col(c))), F.lit(0))
    return cells.groupBy(*key).agg(pick(F.min, "u").alias("x0"), pick(F.min, "v").alias("y0"), pick(F.max, "u").alias("x1"), pick(F.max, "v").alias("y1"))


def stability(cells: DataFrame, key: list[str], threshold: float, offset: float) -> DataFrame:
    above = lambda t: F.count_if(F.col("value") > t)
    return cells.groupBy(*key).agg((above(threshold + offset) / above(threshold - offset)).alias("stability"))


def mask_iou(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Of two tables of set cells: intersection over union, which is at least 1."""
    both = a.select(*key, "v", "u", F.lit(1).alias("l")).join(b.select(*key, "v", "u", F.lit(1).alias("r")), [*key, "v", "u"], "full")
    return both.groupBy(*key).agg((F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("iou"))

