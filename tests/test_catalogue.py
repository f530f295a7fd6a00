"""Every query of the library against its SQL on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from streamloom.plans import catalogue

from .compare import SMALL, duck, rows


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    if name not in catalogue.ORACLE_SQL:
        assert got.count() > 0
        return
    got, want = got.toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_rigid_alignment_uses_all_orders(spark, tmp_path):
    """Orders from 400 on alone: each flag's lever arm of 0.3 is found from them."""
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").where("l_orderkey >= 400")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["rigid_alignment"](spark, str(tmp_path)).collect()
    assert {r.l_returnflag for r in got} == {r[0] for r in lines.select("l_returnflag").distinct().collect()}
    assert all(abs(r.o0 - 0.3) < 1e-2 and abs(r.o1) < 1e-2 and abs(r.scale - 1) < 1e-2 for r in got)


def test_proximity_greedy_takes_whole_streams(spark, con):
    got = catalogue.QUERIES["proximity_greedy"](spark, SMALL).toPandas()
    sizes = dict(con.execute("SELECT user_id, count(*) FROM events GROUP BY 1").fetchall())
    assert max(sizes.values()) > 40
    assert {s: set(g.i) for s, g in got.groupby("stream_id")} == {s: set(range(n)) for s, n in sizes.items() if n > 1}


def test_both_sides_alignment_uses_all_lines(spark, tmp_path):
    """Lines that share an order and a number are different poses: no supplier loses any by them."""
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").withColumn("l_orderkey", F.lit(1).cast("long"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["both_sides_alignment"](spark, str(tmp_path)).collect()
    assert sorted(r.l_suppkey for r in got) == sorted(r[0] for r in lines.select("l_suppkey").distinct().collect())
    assert all((r.l0, r.l1, r.r2, r.lw, r.error) == (0.3, -0.1, 0.1, 1.0, 0.0) for r in got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
