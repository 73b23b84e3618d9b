"""Training of the neighbourhood model: gradients against differences, steps against one process, losses and ranks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators import sage


@pytest.fixture(scope="module")
def two_rings(spark):
    """Two blocks of 30 nodes, each node with edges to the next three of its block; features tell the block with much noise."""
    ends = [(b * 30 + k, b * 30 + (k + t) % 30) for b in (0, 1) for k in range(30) for t in (1, 2, 3)]
    edges = spark.createDataFrame([(min(p), max(p), 1.0) for p in ends], "i long, j long, w double").distinct()
    rng = np.random.default_rng(5)
    x = spark.createDataFrame([(k, (rng.normal(size=6) + (1 if k < 30 else -1)).tolist()) for k in range(61)], "id long, x array<double>")
    return it.checkpointed(edges), it.checkpointed(x)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    w = sage.start(4, 3)
    u, v, o = (rng.normal(size=(n, 2 * 4 * 4)) for n in (5, 5, 7))
    found = sage.loss_and_gradient(w, u, v, o)
    at = 1
    for k in sage.NAMES:
        for place in np.ndindex(w[k].shape):
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][place] += 1e-6
            down[k][place] -= 1e-6
            slope = (sage.loss_and_gradient(up, u, v, o)[0] - sage.loss_and_gradient(down, u, v, o)[0]) / 2e-6
            assert abs(slope - found[at]) < 1e-5
            at += 1
    assert at == len(found)


def test_support_rows(two_rings):
    edges, x = two_rings
    rows = {r.id: np.array(r.s).reshape(-1, 2, 6) for r in sage.support(edges, x, 4, 25).collect()}
    features = {r.id: np.array(r.x) for r in x.collect()}
    near = {}
    for r in g.both_ways(edges).collect():
        near.setdefault(r.i, set()).add(r.j)
    mean = {}
    for r in g.sampled_neighbours(edges, 25).collect():
        mean.setdefault(r.id, []).append(features[r.neighbour])
    assert len(rows) == 61
    for k, s in rows.items():
        assert s.shape == (5, 2, 6) and np.allclose(s[0, 0], features[k])
        if k == 60:  # no neighbours: itself
            assert np.allclose(s, features[60])
            continue
        assert np.allclose(s[0, 1], np.mean(mean[k], axis=0))
        assert all(any(np.allclose(s[t, 0], features[j]) for j in near[k]) for t in range(1, 5))


def test_one_step_equals_one_process_whatever_the_partitions(two_rings):
    edges, x = two_rings
    rows = it.checkpointed(sage.support(edges, x, 4, 8))
    pairs = edges.select(F.col("i").alias("id"), F.col("j").alias("context"))
    s = {r.id: r.s for r in rows.collect()}
    drawn = sorted(r.id for r in sage.negatives(g.degrees(edges), 0, 5).collect())
    assert len(drawn) == 5
    ends = pairs.collect()
    w = sage.start(6, 4)
    plain = sage.loss_and_gradient(w, np.array([s[r.id] for r in ends]), np.array([s[r.context] for r in ends]), np.array([s[k] for k in drawn])) / len(ends)
    moved = sage.Adam().moved(w, plain[1:])
    for parts in (1, 5):
        found, losses = sage.train(pairs.repartition(parts), edges, rows, 6, 4, batches=1, passes=1, many=5)
        assert losses[0] == pytest.approx(plain[0])
        assert all(np.allclose(found[k], moved[k], atol=1e-6) for k in sage.NAMES)


def test_loss_falls_and_neighbours_rank_first(two_rings):
    edges, x = two_rings
    rows = it.checkpointed(sage.support(edges, x, 4, 8))
    pairs = edges.select(F.col("i").alias("id"), F.col("j").alias("context"))
    w, losses = sage.train(pairs, edges, rows, 6, 8, batches=2, passes=10, many=10, rate=0.02)
    s = {r.id: r.s for r in rows.collect()}
    ends, drawn = pairs.collect(), [r.id for r in sage.negatives(g.degrees(edges), 99, 10).collect()]
    on = [np.array([s[k] for k in ids]) for ids in ([r.id for r in ends], [r.context for r in ends], drawn)]
    untrained, trained = (sage.loss_and_gradient(t, *on)[0] / len(ends) for t in (sage.start(6, 8), w))
    assert len(losses) == 20 and trained < 0.9 * untrained
    others = rows.select("id").where("id % 3 = 0 and id <> 60")
    before, after = (sage.reciprocal_ranks(sage.embedded(rows, t), pairs, others).agg(F.avg("reciprocal")).first()[0] for t in (sage.start(6, 8), w))
    z = np.array([r.x for r in sage.embedded(rows, w).collect()])
    assert np.allclose(np.linalg.norm(z, axis=1), 1) and after > 0.2 and after >= before


def test_negatives_follow_degrees(spark):
    weights = spark.createDataFrame([(k, 256 if k < 20 else 1) for k in range(400)], "id long, degree long")  # 256^0.75 = 64
    hits = sum(r.id < 20 for step in range(20) for r in sage.negatives(weights, step, 10).collect())
    assert 125 < hits < 180  # 20 * 64 of 20 * 64 + 380 expected at the first draw: 0.77 of 200, less as the heavy ones go


def test_ranks_of_given_vectors(spark):
    z = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.9, 0.0]), (3, [0.5, 9.0]), (4, [-1.0, 0.0])], "id long, x array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 4)], "id long, context long")
    found = {r.context: (r["rank"], r.reciprocal) for r in sage.reciprocal_ranks(z, pairs, z.where("id >= 2").select("id")).collect()}
    assert found == {1: (2, 0.5), 4: (3, 1 / 3)}


def test_pairs_never_carry_support_rows(two_rings, monkeypatch):
    """Repeated pairs count each time, but neither they nor their nodes' rows grow what a step reads: support rows stay out of joins with pairs."""
    edges, x = two_rings
    rows = it.checkpointed(sage.support(edges, x, 4, 8))
    pairs = edges.select(F.col("i").alias("id"), F.col("j").alias("context"))
    pairs = it.checkpointed(pairs.unionAll(pairs.where("id % 2 = 0")).unionAll(pairs.select("context", "id")))
    seen = []
    real = sage.summed
    monkeypatch.setattr(sage, "summed", lambda df, shape, f: seen.append((df.count(), df.columns)) or real(df, shape, f))
    found, losses = sage.train(pairs, edges, rows, 6, 4, batches=1, passes=2, many=5)
    assert all(n <= 61 * 4 and "s" in columns and "v" not in columns for n, columns in seen) and len(seen) == 2  # a row for each node and task at most
    s, ends, w, adam = {r.id: r.s for r in rows.collect()}, pairs.collect(), sage.start(6, 4), sage.Adam()
    for step in range(2):
        drawn = [s[r.id] for r in sage.negatives(g.degrees(edges), step, 5).orderBy("id").collect()]
        plain = sage.loss_and_gradient(w, np.array([s[r.id] for r in ends]), np.array([s[r.context] for r in ends]), np.array(drawn)) / len(ends)
        assert losses[step] == pytest.approx(plain[0])
        w = adam.moved(w, plain[1:])
    assert all(np.allclose(found[k], w[k], atol=1e-6) for k in sage.NAMES)
