"""Sparse block matrices as rows (i, j, r, c, x) and vectors as rows (i, r, x): joins and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .streams import place


def coalesce(m: DataFrame) -> DataFrame:
    """Entries of the same place added up."""
    at = [c for c in m.columns if c != "x"]
    return m.groupBy(*at).agg(F.sum("x").alias("x"))


def add(a: DataFrame, b: DataFrame, sign: float = 1.0) -> DataFrame:
    return coalesce(a.unionByName(b.withColumn("x", F.col("x") * sign)))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("c").alias("r"), F.col("r").alias("c"), "x")


def symmetric(m: DataFrame) -> DataFrame:
    """An upper triangle of blocks with the lower one beside it."""
    return m.unionByName(transpose(m.where("i != j")))


def tmult(a: DataFrame, b: DataFrame) -> DataFrame:
    """aT b: a join on the shared row and a sum; hot rows are split by adaptive skew joins."""
    l = a.select("i", "r", F.col("j").alias("_i"), F.col("c").alias("_r"), F.col("x").alias("_x"))  # noqa: E741
    out = l.join(b, ["i", "r"])
    return out.groupBy(F.col("_i").alias("i"), "j", F.col("_r").alias("r"), "c").agg(F.sum(F.col("_x") * F.col("x")).alias("x"))


def tmult_vec(a: DataFrame, v: DataFrame) -> DataFrame:
    out = a.join(v.select("i", "r", F.col("x").alias("_x")), ["i", "r"])
    return out.groupBy(F.col("j").alias("i"), F.col("c").alias("r")).agg(F.sum(F.col("x") * F.col("_x")).alias("x"))


def mult(a: DataFrame, b: DataFrame) -> DataFrame:
    return tmult(transpose(a), b)


def mult_vec(a: DataFrame, v: DataFrame) -> DataFrame:
    return tmult_vec(transpose(a), v)


def scale_rows(m: DataFrame, w: DataFrame) -> DataFrame:
    """diag(w) m, for weights (i, r, x)."""
    return m.join(w.select("i", "r", F.col("x").alias("_w")), ["i", "r"]).withColumn("x", F.col("x") * F.col("_w")).drop("_w")


def without_columns(m: DataFrame, fixed: DataFrame) -> DataFrame:
    """Without the columns (j) that are held fixed."""
    return m.join(fixed.select("j").distinct(), "j", "left_anti")


def subset_rows(m: DataFrame, rows: DataFrame) -> DataFrame:
    return m.join(rows.select("i").distinct(), "i", "left_semi")


def damped(m: DataFrame, damping: Column | float, ep: float) -> DataFrame:
    """The diagonal times (1 + damping) plus ep (a number), or plus damping plus ep (a Column)."""
    on = (F.col("i") == F.col("j")) & (F.col("r") == F.col("c"))
    new = F.col("x") * (1 + damping) + ep if isinstance(damping, (int, float)) else F.col("x") + damping + ep
    return m.withColumn("x", F.when(on, new).otherwise(F.col("x")))


def diagonal_inverse(m: DataFrame) -> DataFrame:
    return m.withColumn("x", 1 / F.col("x"))


def ravel_mapping(v: DataFrame) -> DataFrame:
    """Used ids with dense places from 0."""
    return place(v.select("i").distinct(), ["i"], "at")


def ravel(m: DataFrame, rows: DataFrame, cols: DataFrame, height: int, width: int) -> DataFrame:
    """Scalar coordinates (row, col, x) of the entries."""
    out = m.join(rows.select("i", F.col("at").alias("_a")), "i").join(cols.select(F.col("i").alias("j"), F.col("at").alias("_b")), "j")
    return out.select((F.col("_a") * height + F.col("r")).alias("row"), (F.col("_b") * width + F.col("c")).alias("col"), "x")


def unravel(x: DataFrame, rows: DataFrame, height: int) -> DataFrame:
    out = x.select(F.floor(F.col("row") / height).alias("at"), (F.col("row") % height).cast("int").alias("r"), "x")
    return out.join(rows, "at").select("i", "r", "x")


def schur(pose: DataFrame, cross: DataFrame, diagonal: DataFrame, pose_rhs: DataFrame, diag_rhs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pose - E C^-1 ET, v - E C^-1 w) for a scalar-diagonal C: E (i pose, j depth), C and w by depth."""
    inv = diagonal.select(F.col("i").alias("j"), (1 / F.col("x")).alias("_c"))
    e = cross.join(inv, "j").withColumn("x", F.col("x") * F.col("_c")).drop("_c")
    s = add(pose, mult(e, transpose(cross)), -1.0)
    rhs = pose_rhs.unionByName(mult_vec(e, diag_rhs).withColumn("x", -F.col("x"))).groupBy("i", "r").agg(F.sum("x").alias("x"))
    return s, rhs
