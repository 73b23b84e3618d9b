"""Greedy coarsening against its sequential scan, and text formats by round trip."""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators import levels as lv
from latticework.operators import spectra as sp
from latticework.operators import walks as wk
from latticework.sources import graphs as src


def scan(links, order):
    near, cluster = {k: set() for k in order}, {}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for u in order:
        if u not in cluster:
            for x in {u} | {x for x in near[u] if x not in cluster}:
                cluster[x] = u
    return cluster


def test_greedy_clusters_equal_the_scan(spark):
    rng = random.Random(1)
    links = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    order = rng.sample(range(42), 42)
    ranks = spark.createDataFrame([(k, n) for n, k in enumerate(order)], "id long, rank long")
    found = lv.greedy_clusters(spark.createDataFrame(links, "i long, j long"), ranks).collect()
    assert {r.id: r.cluster for r in found} == scan(links, order)


def test_eigenvalues_of_a_star(spark):
    assert np.allclose(sp.smallest(g.laplacian(src.star(spark, 10)), spark.range(10), 10).values, [0, *[1] * 8, 10])


def test_hierarchy_covers_all_nodes(spark):
    e, n = src.grid(spark, 6, 6), spark.range(37)
    levels = lv.hierarchy(e, n, 2)
    assert levels and levels[0][2].count() == 37
    x = levels[-1][2].select(F.col("cluster").alias("id")).distinct().select("id", F.lit(0).alias("c"), F.lit(1.0).alias("x"))
    assert lv.refined(x, levels).count() == 37


def test_formats(spark, tmp_path):
    (tmp_path / "a.graph").write_text("4 4\n2 3\n1 3\n1 2 4\n3\n")
    assert {(r.i, r.j) for r in src.read_chaco(spark, str(tmp_path / "a.graph")).collect()} == {(0, 1), (0, 2), (1, 2), (2, 3)}
    (tmp_path / "a.cc").write_text("1 1 2.5\n2 1 -1\n")
    assert sorted(map(tuple, src.read_compressed_column(spark, str(tmp_path / "a.cc")).collect())) == [(0, 0, 2.5), (1, 0, -1.0)]
    np.save(tmp_path / "x.npy", np.arange(6.0).reshape(3, 2))
    assert {r.id: r.x for r in src.read_npy(spark, str(tmp_path / "x.npy")).collect()} == {0: [0, 1], 1: [2, 3], 2: [4, 5]}
    src.write_dot(src.path(spark, 3, 0.5), str(tmp_path / "dot"))
    text = "".join(p.read_text() for p in Path(tmp_path / "dot").glob("*.txt")).splitlines()
    assert text[0] == "graph {" and text[-1] == "}" and len(text) == 4


def test_zero_vectors_have_no_cosine(spark):
    x = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], "id long, x array<double>")
    assert [(r.i, r.j, r.w) for r in lv.reweighted(src.path(spark, 3, 1.0), x, 0.1).collect()] == [(1, 2, 1.0)]


def test_cg_solve_meets_its_tolerance(spark):
    d = "/root/testdata/sf0.001"
    l = {(r.i, r.j): r.v for r in g.laplacian(src.part_edges(spark, d)).collect()}
    matrix = it.checkpointed(g.laplacian(src.part_edges(spark, d)))
    given = g.times_vector(matrix, src.part_nodes(spark, d).select("id", (F.col("id") % 7).cast("double").alias("x")))
    x = {r.id: r.x for r in it.conjugate_gradients(matrix, given, tolerance=1e-9).collect()}
    b, mx = defaultdict(float), defaultdict(float)
    for (i, j), v in l.items():
        b[i] += v * (j % 7)
        mx[i] += v * x[j]
    assert np.linalg.norm([mx[k] - b[k] for k in b]) <= 1e-8 * np.linalg.norm(list(b.values()))


def test_conjugate_gradients_raise_at_the_limit(spark):
    with pytest.raises(ArithmeticError):
        lv.effective_resistance(src.path(spark, 10, 1.0), 0, 9, 3)


def test_text_formats_with_headers_and_comments(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% comment\n3 3 2\n2 1 -1.5\n3 3 2\n")
    assert {tuple(r) for r in src.read_matrix_market(spark, str(tmp_path / "a.mtx")).collect()} == {(1, 0, -1.5), (0, 1, -1.5), (2, 2, 2.0)}
    (tmp_path / "b.mtx").write_text("2 3 3\n1 1\n1 2\n2 3\n")
    assert {tuple(r) for r in src.read_matrix_market(spark, str(tmp_path / "b.mtx")).collect()} == {(0, 0, 1.0), (0, 1, 1.0), (1, 2, 1.0)}
    (tmp_path / "c.json").write_text('{"nodes": [{"id": 0, "val": false, "test": true}, {"id": 1}], "links": [{"source": 1, "target": 0}, {"source": 0, "target": 0}]}')
    nodes, edges = src.read_node_link(spark, str(tmp_path / "c.json"))
    assert {r.id for r in nodes.collect()} == {0, 1} and [tuple(r) for r in edges.collect()] == [(0, 1, 1.0)]
    (tmp_path / "d.dimacs").write_text("c comment\np edge 3 2\ne 1 2\na 3 2 4.5\n")
    assert {tuple(r) for r in src.read_graph(spark, str(tmp_path / "d.dimacs")).collect()} == {(0, 1, 1.0), (1, 2, 4.5)}
    with pytest.raises(ValueError):
        src.read_graph(spark, "x.unknown")


def test_triangles_of_a_hub(spark):
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(1, 59)]
    found = g.triangles(spark.createDataFrame([(i, j, 1.0) for i, j in edges], "i long, j long, w double")).collect()
    assert sorted(tuple(sorted(r)) for r in found) == [(0, k, k + 1) for k in range(1, 59)]


def test_walks_follow_edges_with_their_weights(spark):
    from latticework.operators import iterative as it

    edges = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0), (1, 2, 1.0)], "i long, j long, w double")
    rows = wk.first_order(edges, spark.range(4), 300, 1).where("step = 1").collect()
    assert {r.node for r in rows if r.id == 3} == {3} and {r.node for r in rows if r.id == 0} == {1, 2}
    assert 0.65 < np.mean([r.node == 2 for r in rows if r.id == 0]) < 0.85


def test_running_numbers(spark):
    from latticework.operators import iterative as it

    found = it.numbered(spark.createDataFrame([(k * 7,) for k in range(500)], "id long")).collect()
    assert {r.id: r.number for r in found} == {k * 7: k for k in range(500)}


def test_late_events_count_within_the_watermark(spark, tmp_path):
    from latticework.streaming import edges as stream

    rows = [(1, "2024-01-01 10:00:00", 5, "a", 1.0), (2, "2024-01-03 10:00:00", 5, "a", 2.0), (3, "2024-01-01 12:00:00", 5, "a", 4.0), (4, None, 5, "b", 8.0)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    found = stream.after_all(spark, str(tmp_path / "events.parquet"), f"file://{tmp_path}/scratch").collect()
    assert sorted((str(r.day), r.n, r.w) for r in found) == [("2024-01-01 00:00:00", 2, 5.0), ("2024-01-03 00:00:00", 1, 2.0)]
