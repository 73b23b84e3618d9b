"""Multigrid parts and clustering against numpy on small graphs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators import levels as lv
from latticework.operators import multigrid as mg
from latticework.operators import relaxation as rx
from latticework.sources import graphs as src


def dense(edges, n):
    w = np.zeros((n, n))
    for r in edges.collect():
        w[r.i, r.j] = w[r.j, r.i] = r.w
    return w


def values(x, n):
    out = np.zeros(n)
    for r in x.collect():
        out[r.id] = r.x
    return out


def test_colouring_and_relaxation(spark):
    """Equal to one-by-one scans; a lone node, a repeated weight and a hub among them."""
    draw = random.Random(2)
    pairs = {(a, b) for a, b in (sorted(draw.sample(range(1, 30), 2)) for _ in range(70))} | {(0, k) for k in range(1, 25)}
    edges = it.checkpointed(spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a, b in sorted(pairs)], "i long, j long, w double"))
    w, nodes = dense(edges, 31), spark.range(31)
    rank = {r.id: (-r.u, r.id) for r in nodes.select("id", g.uniform(F.col("id"), 5).alias("u")).collect()}
    want: dict[int, int] = {}
    for i in sorted(range(31), key=rank.get):
        want[i] = min(set(range(31)) - {want[j] for j in np.flatnonzero(w[i]) if j in want})
    colours = rx.colouring(edges, nodes)
    assert {r.id: r.colour for r in colours.collect()} == want
    assert all(want[a] != want[b] for a, b in pairs)
    x, b = np.arange(31.0) % 7, np.ones(31)
    order = sorted(range(31), key=lambda i: (want[i], i))
    last = max(want.values())
    for i in order + sorted((i for i in order if want[i] < last), key=lambda i: (-want[i], i)):
        if w[i].any():
            x[i] = (b[i] + w[i] @ x) / w[i].sum()
    found = rx.gauss_seidel(edges, colours, nodes.select("id", (F.col("id") % 7).cast("double").alias("x")), nodes.select("id", F.lit(1.0).alias("x")), symmetric=True)
    assert np.allclose(values(found, 31), x)


def test_restricted_eigenspace(spark):
    edges = src.grid(spark, 5, 4)
    y = it.checkpointed(lv.random_vectors(spark.range(20), 3))
    rows = np.zeros((20, 3))
    for r in y.collect():
        rows[r.id] = r.x
    w = dense(edges, 20)
    q = np.linalg.qr(rows)[0]
    assert np.allclose(mg.restricted_eigenspace(g.laplacian(edges), y, 3), np.linalg.eigvalsh(q.T @ (np.diag(w.sum(1)) - w) @ q))


def test_kmeans_finds_parted_groups(spark):
    x = spark.range(90).select("id", F.array((F.col("id") % 3 * 100 + g.uniform(F.col("id"), 1)), g.uniform(F.col("id"), 2)).alias("x"))
    found = {r.id: r.cluster for r in mg.kmeans(x, 3).collect()}
    assert len({(k % 3, c) for k, c in found.items()}) == 3 == len(set(found.values()))
