"""Rounded columns whose exact values are ties of the last decimal."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from latticework.plans import registry
from latticework.plans.common import rounded

DATA = "/root/testdata/sf0.01"


def test_running_averages_equal_sql_in_every_digit(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    theirs = {r[:2]: r[2] for r in con.execute(registry.oracle_sql()["ema_series"]).fetchall()}
    ours = {(r.user_id, r.event_id): r.ema for r in registry.queries()["ema_series"](spark, DATA).collect()}
    assert ours == theirs and len(ours) > 1000


def test_ties_go_away_from_zero(spark):
    values = [0.125, -0.125, 0.375, -2.5, 1e300, float("inf"), 0.0]
    found = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", rounded(F.col("v"), 2).alias("v")).orderBy("k").collect()
    assert [r.v for r in found] == [0.13, -0.13, 0.38, -2.5, 1e300, float("inf"), 0.0]


def test_normalised_time_equals_sql_near_ties(spark, tmp_path):
    """Quotients next to a tie of the fourth decimal, where the last bit of a logarithm or the way of rounding shows."""
    near = [(1, 0.02, 75098.64), (1, 0.02, 80557.81), (31, 0.09, 87794.19), (8, 0.05, 84178.88), (49, 0.08, 44340.07), (7, 0.0, 12.5), (0, 0.05, 3.0), (3, None, 1.0)]
    rows = [(k, 1, float(n), x, a, "A", "O") for k, (n, a, x) in enumerate(near)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    theirs = dict(con.execute(registry.oracle_sql()["normalised_time"]).fetchall())
    ours = {r.run: r.t for r in registry.queries()["normalised_time"](spark, str(tmp_path)).collect()}
    assert ours == theirs and len(ours) == 7
