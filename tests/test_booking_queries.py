"""Queries over bookings: no fold in Python, and their SQL's rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerlake.model import NUM
from ledgerlake.operators import booking, inventory

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "b7_interpolation",  # F2
    "b5_reduce_lifo",  # F4
    "b5_reduce_strict",  # F5
    "b8_inventory_after",  # F6
    "b9_inspect",  # F7
])
def test_booked_by_columns(spark, monkeypatch, name):
    monkeypatch.setattr(booking, "_folded", lambda *a: pytest.fail("folded"))
    got = __spark_entry__.queries()[name](spark, SF)
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_sums_beside_give_what_each_gives(spark):
    """plain aggregates and sums of positions in one grouping, with null keys, lots that cancel and groups without a position."""
    rows = "(null, 'A', 2, 1), (null, 'A', -2, 1), (null, 'A', 3, 2), ('x', null, null, null), ('y', 'B', 5, null), ('y', 'A', 5, null), ('y', 'B', 1, 3), ('z', 'A', 0, null)"
    cost = lambda n: F.when(F.col(n).isNotNull(), F.struct(F.col(n).cast(NUM).alias("number"), F.lit("USD").alias("currency"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("label")))
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(g, c, n, l)")
    df = df.select("g", "n", inventory.position(F.col("n").cast(NUM), F.col("c"), cost("l")).alias("p"), inventory.position(F.lit(1).cast(NUM), F.col("c"), cost("n")).alias("q"))
    got = inventory.sums_beside(df, ["g"], {"n": F.sum("n"), "k": F.count("*"), "top": F.max(F.struct("n"))}, {"p": "ps", "q": "qs"}).collect()
    key = lambda r: (r["g"] or "")
    for out, pos in (("ps", "p"), ("qs", "q")):
        want = inventory.sum_positions(df, ["g"], pos, out).collect()
        assert sorted(((r["g"], r[out]) for r in got), key=str) == sorted(((r["g"], r[out]) for r in want), key=str)
    want = df.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max(F.struct("n")).alias("top")).collect()
    assert [(r["g"], r["n"], r["k"], r["top"]) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(want, key=key)]
