"""The multigrid set-up and solver against numpy, and what they did to the tables' graph against DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import amg
from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators import levels as lv
from latticework.plans.graphs import WITH
from latticework.sources import graphs as src

DATA = "/root/testdata/sf0.001"


def dense(edges, n):
    w = np.zeros((n, n))
    for r in edges.collect():
        w[r.i, r.j] = w[r.j, r.i] = r.w
    return w


def laplacian(w):
    return np.diag(w.sum(1)) - w


def values(x, n):
    out = np.zeros(n)
    for r in x.collect():
        out[r.id] = r.x
    return out


def given(spark, b):
    return it.checkpointed(spark.createDataFrame([(k, float(v)) for k, v in enumerate(b)], "id long, x double"))


def plain_stage(w, x, bins=10, ratio=2.5, guard=0.7 / 1.5):
    """The rule of a stage, node by node."""
    n, x = len(w), x.copy()
    z = (x @ x.T) ** 2 / np.outer((x * x).sum(1), (x * x).sum(1))
    best = np.where(w > 0, z, -1).max(1)
    low, high = best.min(), best.max()
    level = [bins - 1 - min(int((b - low) / ((high - low) / bins if high - low > 1e-15 else 1)), bins - 1) for b in best]
    order, cluster, seed, at, rounds = sorted(set(level)), {}, set(), 0, {}
    while n - len(cluster) > guard * n:
        picks = {}
        for i in (i for i in range(n) if i not in cluster and i not in seed and level[i] <= order[at]):
            near = np.flatnonzero(w[i])
            d, r, q = w[i].sum(), w[i] @ x, w[i] @ (x * x) / 2
            fit = [(-z[i, s], s) for s in near if s not in cluster and ((d / 2 * x[s] ** 2 - r * x[s] + q) / (q - r * r / (2 * d))).max() <= ratio]
            if fit:
                picks[i] = ((min(fit)[0], i), min(fit)[1])
        won = {i: s for i, (p, s) in picks.items() if (s not in picks or p <= picks[s][0]) and all(p <= o for o, t in picks.values() if t == i)}
        values_ = x.copy()
        for i, s in won.items():
            cluster[i], x[i] = s, values_[s]
            rounds[i] = max(rounds.values(), default=0)
            seed.add(s)
        if at + 1 < len(order):
            at += 1
        elif not won:
            break
    return {i: cluster.get(i, i) for i in range(n)}


def test_a_stage_equals_its_rule(spark):
    edges, nodes = it.checkpointed(src.grid(spark, 7, 6)), spark.range(42)
    x = it.checkpointed(lv.test_vectors(edges, nodes, 4))
    rows = np.zeros((42, 4))
    for r in x.collect():
        rows[r.id] = r.x
    found = {r.id: r.cluster for r in amg.assignment(amg.sweep_stage(amg.start_sweep(edges, nodes, x), 4)).collect()}
    assert found == plain_stage(dense(edges, 42), rows)
    assert all(found[c] == c for c in found.values())


def test_every_join_over_the_tables_keeps_its_energy_in_sql(spark, tmp_path):
    edges, nodes = it.checkpointed(src.part_edges(spark, DATA)), src.part_nodes(spark, DATA)
    x = it.checkpointed(lv.test_vectors(edges, nodes, 4))
    assign, alpha, beta, stage = amg.aggregate(edges, nodes, x, 4)
    assign.write.parquet(f"{tmp_path}/a.parquet")
    x.write.parquet(f"{tmp_path}/x.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    con.execute(f"CREATE TABLE g AS SELECT * FROM '{tmp_path}/a.parquet/*.parquet'; CREATE TABLE v AS SELECT * FROM '{tmp_path}/x.parquet/*.parquet'")
    joins, worst, moved, nodes_, clusters = con.execute(f"""{WITH}, t AS (SELECT id, unnest(x) AS x, generate_subscripts(x, 1) AS c FROM v),
    near AS (SELECT g.id, g.cluster AS s, own.c, a.v AS w, CASE WHEN h.round < g.round THEN far.x ELSE own.x END AS x FROM g JOIN a ON a.i = g.id JOIN g h ON h.id = a.j JOIN t own ON own.id = h.id JOIN t far ON far.id = h.cluster AND far.c = own.c WHERE g.round IS NOT NULL),
    sums AS (SELECT id, s, c, sum(w) AS d, sum(w * x) AS r, sum(w * x * x / 2) AS q FROM near GROUP BY 1, 2, 3),
    ratio AS (SELECT sums.id, (d / 2 * t.x ** 2 - r * t.x + q) / (q - r * r / (2 * d)) AS ratio FROM sums JOIN t ON t.id = s AND t.c = sums.c)
    SELECT count(DISTINCT id), max(ratio), (SELECT count(*) FROM g JOIN g h ON h.id = g.cluster WHERE h.cluster <> h.id), (SELECT count(*) FROM g), (SELECT count(DISTINCT cluster) FROM g) FROM ratio""").fetchone()
    assert worst <= 2.5 + 1e-6 and moved == 0 and joins == nodes_ - clusters > 0
    assert alpha == clusters / nodes_ <= 0.7 / 1.5 and beta == 1 - alpha and stage == 1


def test_stages_and_their_optimum(spark):
    """A path whose joins one stage can't finish has a second; hubs stay seeds."""
    edges, nodes = it.checkpointed(src.star(spark, 40)), spark.range(40)
    x = it.checkpointed(lv.test_vectors(edges, nodes, 3))
    assign, alpha, beta, stage = amg.aggregate(edges, nodes, x, 3, hubs=8.0)
    found = {r.id: r.cluster for r in assign.collect()}
    assert found[0] == 0 and alpha == len(set(found.values())) / 40
    assert beta == (1 + alpha if alpha > 0.7 / 1.5 else 1 - alpha) and stage in (1, 2)


def test_filter_rate(spark):
    edges, nodes = it.checkpointed(src.grid(spark, 5, 4)), spark.range(20)
    rate, slow = amg.filter_rate(edges, nodes, 2)
    w = dense(edges, 20) + 0.1 * np.eye(20)
    f = w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
    x = np.array([2 * r.u - 1 for r in nodes.select("id", g.uniform(F.col("id"), 42).alias("u")).orderBy("id").collect()])
    y1 = f @ f @ x
    y = f @ f @ y1
    assert np.allclose(values(slow, 20), y1) and np.isclose(rate, (y.std() / y1.std()) ** (1 / 6))


@pytest.fixture(scope="module")
def grid(spark):
    edges = it.checkpointed(src.grid(spark, 9, 8))
    return edges, amg.setup(edges, spark.range(73), elimination=True, direct=12)  # node 72 has no edges


def test_levels(spark, grid):
    """Counts, Galerkin products, Schur complements and kinds in turn."""
    edges, levels = grid
    assert [x.kind for x in levels][:3] == ["finest", "elimination", "aggregation"] and len(levels) > 3
    for fine, at in zip(levels, levels[1:]):
        w, own = dense(at.edges, 73), sorted(r.id for r in at.nodes.collect())
        assert (at.size, at.links) == (len(own), at.edges.count()) and at.size < fine.size
        if at.kind == "aggregation":
            p = np.zeros((73, 73))
            for r in at.assign.collect():
                p[r.id, r.cluster] = 1
            want = p.T @ laplacian(dense(fine.edges, 73)) @ p
            assert np.allclose(want, laplacian(w)) and fine.rate > 0.3 and at.alpha == at.size / fine.size
        else:
            whole, gone = laplacian(dense(fine.edges, 73)), [r.id for r in fine.nodes.collect() if r.id not in own]
            inverse = np.linalg.pinv(whole[np.ix_(gone, gone)])
            assert np.allclose(whole[np.ix_(own, own)] - whole[np.ix_(own, gone)] @ inverse @ whole[np.ix_(gone, own)], laplacian(w)[np.ix_(own, own)])
    nodes, links, work = amg.complexities(levels)
    assert nodes == sum(x.size for x in levels) / 73 and 1 < links < work


def test_visits():
    assert amg.visits(1, 1.5) == [0] and amg.visits(4, 1.0) == [0, 1, 2, 3, 2, 1, 0]
    assert Counter(amg.visits(4, 2.0))[3] == 4
    path = amg.visits(6, 1.5)
    down = Counter(b for a, b in zip(path, path[1:]) if b > a)
    assert path[0] == path[-1] == 0 and all(abs(a - b) == 1 for a, b in zip(path, path[1:])) and [down[k] for k in range(1, 6)] == [1, 2, 3, 5, 8]


def test_a_cycle_over_two_levels(spark):
    """Equal to its dense counterpart."""
    edges, nodes = it.checkpointed(src.grid(spark, 6, 6)), spark.range(36)
    levels = amg.setup(edges, nodes, elimination=False, direct=20)[:2]
    w, p = dense(edges, 36), np.zeros((36, 36))
    for r in levels[1].assign.collect():
        p[r.id, r.cluster] = 1
    l = laplacian(w)
    b = l @ np.sin(np.arange(36.0))
    jacobi = lambda x: x / 3 + 2 / 3 * (b + w @ x) / w.sum(1)
    x = jacobi(np.zeros(36))
    x = jacobi(jacobi(x + p @ np.linalg.pinv(p.T @ l @ p) @ p.T @ (b - l @ x)))
    assert np.allclose(values(amg.Solver(levels).cycle(given(spark, b)), 36), x, atol=1e-9)


def test_elimination_alone_solves_a_tree(spark):
    edges, nodes = it.checkpointed(src.path(spark, 40, 0.5)), spark.range(40)
    levels = amg.setup(edges, nodes, elimination=True, direct=3, most=2)
    assert [x.kind for x in levels] == ["finest", "elimination"] and len(levels[1].steps) > 1
    l = laplacian(dense(edges, 40))
    b = l @ np.cos(np.arange(40.0))
    assert np.allclose(l @ values(amg.Solver(levels).cycle(given(spark, b)), 40), b)


def test_solve_takes_few_steps(spark, grid):
    edges, levels = grid
    l = laplacian(dense(edges, 73))
    y = np.sin(np.arange(73.0) ** 2)
    b = l @ y
    x, history = amg.Solver(levels).solve(given(spark, b), 1e-9)
    assert np.allclose(l @ values(x, 73), b, atol=1e-7) and history[-1] <= 1e-9
    r = p = b.copy()
    plain = 0
    while np.linalg.norm(r) > 1e-9 * np.linalg.norm(b):
        q, before = l @ p, r @ r
        r = r - before / (p @ q) * q
        p, plain = r + r @ r / before * p, plain + 1
    assert len(history) < plain / 3


def test_nothing_to_solve(spark):
    none = spark.createDataFrame([], "i long, j long, w double")
    levels = amg.setup(none, spark.range(3), direct=1)
    x, history = amg.Solver(levels).solve(given(spark, np.zeros(3)))
    assert len(levels) == 1 and history == [] and not values(x, 3).any()
    with pytest.raises(ArithmeticError, match="after 1 steps"):
        edges = src.grid(spark, 4, 4)
        amg.Solver(amg.setup(edges, spark.range(16), elimination=False, direct=6), direct=0).solve(given(spark, laplacian(dense(edges, 16)) @ np.arange(16.0)), steps=1)


def test_the_registered_levels(spark):
    from latticework.plans import registry

    rows = registry.queries()["amg_setup"](spark, DATA).orderBy("level").collect()
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(DATA, name)}.parquet'")
    assert con.execute(f"{WITH} SELECT (SELECT count(*) FROM n), (SELECT count(*) FROM e)").fetchone() == (rows[0].nodes, rows[0].edges)
    assert all(a.nodes > b.nodes for a, b in zip(rows, rows[1:])) and all(r.alpha <= 0.7 / 1.5 for r in rows if r.kind == "aggregation")
