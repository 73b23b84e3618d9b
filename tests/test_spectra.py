"""Block Davidson against numpy, and its residuals over the tables against DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators import spectra as sp
from latticework.plans.graphs import WITH
from latticework.sources import graphs as src

DATA = "/root/testdata/sf0.001"


def dense(edges, n):
    w = np.zeros((n, n))
    for r in edges.collect():
        w[r.i, r.j] = w[r.j, r.i] = r.w
    return np.diag(w.sum(1)) - w


def test_grid_with_repeated_values_and_parts(spark):
    """Two grids and two lone nodes: four zeros; every other value twice."""
    grid = src.grid(spark, 6, 6)
    edges, nodes = it.checkpointed(src.union(grid, grid, 36, (0, 0, 0.0)).where("w > 0")), spark.range(74)
    zeros, found = sp.laplacian_spectrum(edges, nodes, 6)
    true = np.linalg.eigvalsh(dense(edges, 74))
    assert zeros == 4 and np.allclose(found.values, true[4:10], atol=1e-6) and (found.residuals < 1e-5).all()


def test_fewer_values_than_wanted(spark):
    edges = src.complete(spark, 5)
    zeros, found = sp.laplacian_spectrum(edges, spark.range(5), 6)
    assert zeros == 1 and np.allclose(found.values, [5] * 4)
    zeros, found = sp.laplacian_spectrum(edges.where("i < 0"), spark.range(3), 2)
    assert zeros == 3 and len(found.values) == 0


def test_two_triangles(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0)], "i long, j long, w double")
    assert np.allclose(sp.smallest(g.laplacian(edges), spark.range(6), 6).values, [0, 0, 3, 3, 3, 3], atol=1e-9)


def test_an_error_rather_than_rough_values(spark):
    with pytest.raises(ArithmeticError, match="restarts"):
        sp.smallest(g.laplacian(src.path(spark, 200, 1.0)), spark.range(200), 2, depth=2, restarts=2)


def test_report():
    assert sp.report(1, np.array([0.5, 2.0])) == {"components": 1, "fiedler": 0.5, "gap": 1.5, "first_gap": 0.5, "mixing": 2.0, "conductance_bound": 0.25}
    assert sp.report(2, np.array([0.5])) == {"components": 2, "fiedler": 0.0, "gap": 0.5, "first_gap": 0.0, "mixing": None, "conductance_bound": 0.0}


def test_residuals_over_the_tables_in_sql(spark, tmp_path):
    """DuckDB's own Laplacian of the tables times the vectors, less value times vector; and no smaller value is left out."""
    edges, nodes = it.checkpointed(src.part_edges(spark, DATA)), src.part_nodes(spark, DATA)
    zeros, found = sp.laplacian_spectrum(edges, nodes, 5)
    found.vectors.write.parquet(f"{tmp_path}/q.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    con.execute(f"CREATE TABLE q AS SELECT id, unnest(q) AS q, generate_subscripts(q, 1) AS k FROM '{tmp_path}/q.parquet/*.parquet'")
    con.execute(f"CREATE TABLE given AS SELECT unnest({[float(v) for v in found.values]}) AS value, unnest(range(1, {len(found.values) + 1})) AS k")
    worst, = con.execute(f"{WITH}, y AS (SELECT i AS id, k, sum(v * q.q) AS y FROM l JOIN q ON q.id = j GROUP BY 1, 2) SELECT max(abs(coalesce(y, 0) - value * q.q)) FROM q JOIN given USING (k) LEFT JOIN y USING (id, k)").fetchone()
    gram = con.execute("SELECT a.k, b.k, sum(a.q * b.q) FROM q a JOIN q b USING (id) GROUP BY 1, 2").fetchall()
    assert worst < 1e-5 and all(abs(v - (a == b)) < 1e-9 for a, b, v in gram)
    at = {r.id: k for k, r in enumerate(nodes.orderBy("id").collect())}
    l = np.zeros((len(at),) * 2)
    for r in g.laplacian(edges).collect():
        l[at[r.i], at[r.j]] += r.v
    true = np.linalg.eigvalsh(l)
    assert zeros == (true < 1e-8).sum() and np.allclose(found.values, true[zeros : zeros + 5], atol=1e-6)


def test_blocks_times_vectors(spark):
    """In many parts and with rows and columns that the other side lacks."""
    rng = np.random.default_rng(4)
    m = np.where(rng.random((60, 60)) < 0.2, rng.integers(-3, 4, (60, 60)), 0.0)
    m[:, 7], m[9] = 0.0, 0.0
    matrix = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v double")
    x = rng.random((60, 3))
    blocks, side = sp.packed(matrix, 20)
    got = sp.times_block(blocks, side, spark.createDataFrame([(k, x[k].tolist()) for k in range(60) if k % 11], "id long, x array<double>"), 3).collect()
    x[::11] = 0.0
    assert side > 4 and {r.id for r in got} == set(np.flatnonzero(m.any(1))) and all(np.allclose(r.w, m[r.id] @ x) for r in got)


def test_contracted_components(spark):
    edges = spark.range(400).select(F.col("id").alias("i"), F.explode(F.array(F.col("id") * 7 % 400, F.col("id") * 3 % 50 + 350)).alias("j")).where("i % 13 > 2 and i < j").withColumn("w", F.lit(1.0))
    edges = it.checkpointed(edges.unionAll(src.path(spark, 90, 1.0).select(F.col("i") * 3 + 1000, F.col("j") * 3 + 1000, "w")))
    nodes = spark.range(1400)
    assert it.contracted_components(edges, nodes).exceptAll(it.connected_components(edges, nodes)).count() == 0 and it.contracted_components(edges, nodes).count() == 1400


def test_few_products_on_uneven_degrees(spark):
    """The smallest values lie near the smallest degrees: the first vectors and the steps go by the diagonal."""
    edges, nodes = it.checkpointed(src.part_edges(spark, DATA, 1)), src.part_nodes(spark, DATA)
    zeros, found = sp.laplacian_spectrum(edges, nodes, 5)
    at = {r.id: k for k, r in enumerate(nodes.orderBy("id").collect())}
    l = np.zeros((len(at),) * 2)
    for r in g.laplacian(edges).collect():
        l[at[r.i], at[r.j]] += r.v
    true = np.linalg.eigvalsh(l)
    assert zeros == (true < 1e-8).sum() and np.allclose(found.values, true[zeros : zeros + 5], atol=1e-6)
    assert found.products <= 14, found.products


def test_tables_of_former_steps_do_not_stay(spark):
    """What lies in the shared folder must not grow with the number of steps."""
    shared = Path(it.shared_dir(spark).removeprefix("file://"))
    names = lambda: {p.name for p in shared.iterdir()}
    before = names()
    found = sp.smallest(g.laplacian(src.path(spark, 60, 1.0)), spark.range(60), 2)
    made = [n.split("-")[0] for n in names() - before]
    assert np.allclose(found.values, np.linalg.eigvalsh(dense(src.path(spark, 60, 1.0), 60))[:2], atol=1e-6)
    assert found.products > 3 and made.count("davidson") == 2 and made.count("residuals") == 1
