"""Segment (scatter) aggregates, statistics and fits over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REDUCE = {"sum": (F.sum, 0.0), "add": (F.sum, 0.0), "mul": (F.product, 1.0), "mean": (F.avg, 0.0), "min": (F.min, 0.0), "max": (F.max, 0.0)}


def scatter(rows: DataFrame, index: str, value: str, reduce: str = "sum", size: int | None = None, position: str | None = None) -> DataFrame:
    """index, value of each segment; with size, all segments 0..size - 1, empty ones with the reduction's own value.

    min and max also give arg, the smallest position of the extreme value (None for an empty segment).
    """
    if reduce not in _REDUCE:
        raise ValueError(f"no reduction {reduce!r}")
    f, empty = _REDUCE[reduce]
    aggs = [f(F.col(value).cast("double")).alias("value")]
    if reduce in ("min", "max") and position:
        order = F.struct(F.col(value) if reduce == "min" else -F.col(value), F.col(position))
        aggs.append(F.min_by(position, order).alias("arg"))
    out = rows.groupBy(F.col(index).cast("long").alias("index")).agg(*aggs)
    if size is not None:
        every = rows.sparkSession.range(size).withColumnRenamed("id", "index")
        out = every.join(out, "index", "left").withColumn("value", F.coalesce("value", F.lit(empty)))
    return out


def lower_median(column: str) -> Column:
    """The lower of the two middle values."""
    return F.expr(f"percentile_disc(0.5) within group (order by {column})")


def quantile(column: str, q: float) -> Column:
    """With linear interpolation."""
    return F.percentile(column, q)


def abs_relative(output: Column, target: Column, valid: Column) -> Column:
    return F.avg(F.when(valid, F.abs(output - target) / target))


def rmse_log(output: Column, target: Column, valid: Column) -> Column:
    return F.sqrt(F.avg(F.when(valid, F.pow(F.log(output) - F.log(target), 2))))


def delta1(output: Column, target: Column, valid: Column, ratio: float = 1.25) -> Column:
    return F.avg(F.when(valid, (F.greatest(output / target, target / output) < ratio).cast("double")))


def scale_shift(rows: DataFrame, key: list[str], x: str, y: str, weight: Column | None = None, ridge: float = 0.0) -> DataFrame:
    """scale, shift of the least squares y = scale * x + shift of each group, from five sums; singular groups have nulls."""
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    s = rows.groupBy(*key).agg(F.sum(w * X * X).alias("a"), F.sum(w * X).alias("b"), F.sum(w).alias("c"), F.sum(w * X * Y).alias("d"), F.sum(w * Y).alias("e"))
    a, c = F.col("a") + ridge, F.col("c") + ridge
    det = a * c - F.col("b") * F.col("b")
    det = F.when(F.abs(det) > 1e-12 * F.abs(a * c), det)
    return s.select(*key, ((c * F.col("d") - F.col("b") * F.col("e")) / det).alias("scale"), ((a * F.col("e") - F.col("b") * F.col("d")) / det).alias("shift"))


def scale_only(x: Column, y: Column, eps: float = 1e-6) -> Column:
    return F.sum(x * y) / (F.sum(x * x) + eps)


def scale_scalar(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return F.sum(a * b) / F.greatest(F.sum(b * b), F.lit(eps))


def trimmed(rows: DataFrame, key: list[str], column: str, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """Rows strictly within two quantiles of their group."""
    q = rows.groupBy(*key).agg(F.percentile(column, F.array(F.lit(lo), F.lit(hi))).alias("_q"))
    return rows.join(q, key).where((F.col(column) > F.col("_q")[0]) & (F.col(column) < F.col("_q")[1])).drop("_q")


def zero_one(rows: DataFrame, key: list[str], column: str, name: str = "normalised") -> DataFrame:
    """(x - min) / (max - min) within each group; a constant group is 0."""
    m = rows.groupBy(*key).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return rows.join(m, key).withColumn(name, (F.col(column) - F.col("_lo")) / F.when(span == 0, 1.0).otherwise(span)).drop("_lo", "_hi")


def coverage(rows: DataFrame, key: list[str], patch: list[Column], hit: Column) -> DataFrame:
    """The share of a group's patches that hold any hit."""
    each = rows.groupBy(*key, *(p.alias(f"_p{i}") for i, p in enumerate(patch))).agg(F.max(hit.cast("int")).alias("_any"))
    return each.groupBy(*key).agg(F.avg("_any").alias("coverage"))


def huber_weight(r: Column, k: float) -> Column:
    return F.when(F.abs(r) <= k, 1.0).otherwise(k / F.abs(r))


def tukey_weight(r: Column, c: float) -> Column:
    x = F.greatest(1 - F.pow(r / c, 2), F.lit(0.0))
    return x * x


def tls_weight(r: Column, c: float, mu: float, mu_max: float = 1e6) -> Column:
    """Graduated truncated least squares: 1 inside, 0 outside, and a smooth fall between whose width mu narrows."""
    r2, c2 = r * r, c * c
    if mu >= mu_max:
        return F.when(r2 <= c2, 1.0).otherwise(0.0)
    lo, hi = mu / (mu + 1) * c2, (mu + 1) / mu * c2
    return F.when(r2 <= lo, 1.0).when(r2 >= hi, 0.0).otherwise(c * F.sqrt(F.lit(mu * (mu + 1.0))) / F.sqrt(r2) - mu)


def robust_weight(name: str | None, r: Column, threshold: float, mu: float = 1.0) -> Column:
    kinds = {"huber": huber_weight, "tukey": tukey_weight}
    if name is None or name.lower() in ("", "none", "null", "off"):
        return F.lit(1.0)
    if name.lower() in ("tls", "gnc_tls", "tls_gnc"):
        return tls_weight(r, threshold, mu)
    if name.lower() not in kinds:
        raise ValueError(f"no robust kernel {name!r}")
    return kinds[name.lower()](r, threshold)


def huber_loss(x: Column) -> Column:
    return F.when(x <= 1, x).otherwise(2 * F.sqrt(x) - 1)
