"""What a task or the driver holds must not grow with the tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from latticework.operators import energies as en
from latticework.operators import graph as g
from latticework.operators import levels as lv
from latticework.operators import multigrid as mg
from latticework.plans import registry
from latticework.sources import graphs as src

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """10,000 orders of four lines each."""
    path = str(tmp_path_factory.mktemp("orders"))
    lines = spark.range(40_000).select(F.floor(F.col("id") / 4).alias("l_orderkey"), ((F.col("id") * 7 + F.floor(F.col("id") / 4) % 3) % 50).alias("l_partkey"))
    lines.write.parquet(f"{path}/lineitem.parquet")
    return path


def test_tasks_of_the_part_graph_are_dealt_by_rows(spark, orders, monkeypatch):
    plain = {tuple(r) for r in src.part_edges(spark, orders).collect()}
    assert plain
    monkeypatch.setattr(src, "dealt", lambda spark, rows: rows // 2_000)
    found = src.part_edges(spark, orders)
    assert found.rdd.getNumPartitions() == 2 * 40_000 // 2_000
    assert {tuple(r) for r in found.collect()} == plain


def test_partitions_follow_the_rows(spark):
    assert [src.dealt(spark, n) for n in (0, 1, 50_000_000, 300_000_000)] == [1, 1, 100, 600]


def test_numbers_of_large_ids(spark):
    """Pairs of ids of a million and more, hashed as i * 7919 + j, are beyond 2^63 once multiplied."""
    p, ids = 2147483647, [5, 9_503_960_000, 1 << 40]

    def plain(i: int, c: int) -> float:
        z = (i * 1103515245 + (c + 1) * 620899117 + 7) % p
        z = (z * z + c + 1) % p
        return (z * z + i) % p / p

    found = spark.createDataFrame([(i,) for i in ids], "id long").select("id", g.uniform(F.col("id"), 3).alias("u")).collect()
    assert {r.id: r.u for r in found} == {i: plain(i, 3) for i in ids}


def test_samples_of_large_ids(spark):
    edges = spark.createDataFrame([(2_000_000, 2_000_000 + k, 1.0) for k in range(1, 7)], "i long, j long, w double")
    assert g.sampled_neighbours(edges, 4).count() == 7 * 4


def test_all_pairs_of_a_remainder_are_compared(spark):
    """Vectors of one remainder by 64, far apart in the table, are pairs: n (n - 1) / 2 for each."""
    n = {r.c: r["count"] for r in src.table(spark, DATA, "embeddings").groupBy((F.col("vec_id") % 64).alias("c")).count().collect()}
    for name in ("vec_cosine", "vec_affinity", "vec_l2"):
        found = registry.queries()[name](spark, DATA)
        assert found.where("(j - i) % 64 = 0 and i < j").count() == found.count() == sum(k * (k - 1) // 2 for k in n.values())


def test_vectors_over_nodes_are_never_broadcast(spark):
    """A node table's estimate says nothing on the many rows made of it."""
    x = lv.random_vectors(src.part_nodes(spark, DATA))
    e = src.part_edges(spark, DATA)
    assign = src.part_nodes(spark, DATA).select("id", (F.col("id") % 16).alias("cluster"))
    for made in (lv.times_columns(g.both_ways(e), lv.long(x)), lv.affinity_matrix(e, x), mg.column_energies(e, lv.long(x)), en.means(x, assign)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
