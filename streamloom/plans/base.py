"""The catalogue of queries: each with the same query in DuckDB's SQL where SQL can express it.

Events play frame streams (a user is a stream), embeddings play 8 x 8 grids and feature vectors, line
items play edges and sparse blocks, parts and suppliers boxes and dimensions, conversations views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grids, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (read) -> DataFrame under its name; read(table) reads a table of the query's folder."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, minus zero as zero."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def frames(read) -> DataFrame:
    e = read("events").select(F.col("user_id").alias("stream_id"), "ts", "event_id", "event_type", "value")
    return streams.number(e, ["stream_id"], ["ts", "event_id"])


EV = """ev AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS raw_frame_idx,
        ts, event_id, event_type, value FROM events)"""

SIZE = 8


def cells(read, value: Column | None = None) -> DataFrame:
    return grids.explode_grid(read("embeddings"), ["vec_id"], "embedding", SIZE, value)


GRID = """g AS (SELECT vec_id, CAST((p - 1) // 8 AS INTEGER) AS v, CAST((p - 1) % 8 AS INTEGER) AS u, CAST(embedding[p] AS DOUBLE) AS x
       FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings))"""


def ordered(*by: str):
    return Window.orderBy(*by)
