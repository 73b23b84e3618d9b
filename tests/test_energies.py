"""Fits of coarse energies against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from latticework.operators import energies as en
from latticework.operators import iterative as it


@pytest.fixture(scope="module")
def graph(spark):
    """40 nodes in 8 clusters, hashed edges and vectors; node 40 and cluster 9 stand alone."""
    rng = np.random.default_rng(4)
    ends = {(int(min(p)), int(max(p))): float(rng.integers(1, 5)) for p in rng.integers(0, 40, (110, 2)) if p[0] != p[1]}
    x = rng.normal(size=(41, 5))
    cluster = [k % 8 for k in range(40)] + [9]
    e = spark.createDataFrame([(i, j, w) for (i, j), w in ends.items()], "i long, j long, w double")
    v = spark.createDataFrame([(k, x[k].tolist()) for k in range(41)], "id long, x array<double>")
    a = spark.createDataFrame(list(enumerate(cluster)), "id long, cluster long")
    return ends, x, np.array(cluster), *(it.checkpointed(t) for t in (e, v, a))


def coarse(ends, x, cluster):
    means = {c: x[cluster == c].mean(axis=0) for c in set(cluster.tolist())}
    w = {}
    for (i, j), v in ends.items():
        key = tuple(sorted((int(cluster[i]), int(cluster[j]))))
        if key[0] != key[1]:
            w[key] = w.get(key, 0) + v
    return w, {k: (means[k[0]] - means[k[1]]) ** 2 for k in w}


def test_nodal_factors(graph):
    ends, x, cluster, e, v, a = graph
    w, terms = coarse(ends, x, cluster)
    fine, below = np.zeros((10, 5)), np.zeros((10, 5))
    for (i, j), t in ends.items():
        for end in (i, j):
            fine[cluster[end]] += t * (x[i] - x[j]) ** 2 / 2
    for (i, j), t in w.items():
        for end in (i, j):
            below[end] += t * terms[i, j] / 2
    found = {(r.id, r.c): r.factor for r in en.adaptive(e, v, a).collect()}
    assert len(found) == 40 and all(found[k, c] == pytest.approx(fine[k, c] / below[k, c]) for k, c in found)
    factors = {r.id: r.factor for r in en.nodal_factors(e, v, a).collect()}
    assert all(factors[k] == pytest.approx(fine[k] @ below[k] / (below[k] @ below[k])) for k in range(8)) and set(factors) == set(range(8))
    fitted = {(r.i, r.j): r.w for r in en.nodal_edges(e, v, a).collect()}
    assert fitted == pytest.approx({(i, j): t * (factors[i] + factors[j]) / 2 for (i, j), t in w.items()})


def test_greedy_terms(graph):
    ends, x, cluster, e, v, a = graph
    w, terms = coarse(ends, x, cluster)
    plain = {}
    for (i, j), t in ends.items():
        b, near = (x[i] - x[j]) ** 2, {tuple(sorted((int(cluster[i]), int(cluster[j]))))} & w.keys()
        for c in {cluster[i], cluster[j]}:
            near |= set(sorted((k for k in w if c in k), key=lambda k: (-w[k], k))[:4])
        rest, one = min((b @ b - (terms[k] @ b) ** 2 / (terms[k] @ terms[k]), k) for k in near)
        best = rest, {one: terms[one] @ b / (terms[one] @ terms[one])}
        for other in near - {one}:
            m = np.array([terms[one], terms[other]]).T
            q = np.linalg.lstsq(m, b, rcond=None)[0]
            left = ((b - m @ q) ** 2).sum()
            if (q > 0).all() and left < best[0] - 1e-12:
                best = left, {one: q[0], other: q[1]}
        plain |= {(i, j, *k): q for k, q in best[1].items()}
    found = {(r.i, r.j, r.lo, r.hi): r.q for r in en.greedy_terms(e, v, a).collect()}
    assert found == pytest.approx(plain) and len({k[:2] for k in found}) == len(ends)
    sums = {k: sum(ends[key[:2]] * q for key, q in plain.items() if key[2:] == k) for k in {key[2:] for key in plain}}
    assert {(r.i, r.j): r.w for r in en.greedy_edges(e, v, a).collect()} == pytest.approx(sums)


def test_fits_come_nearer_than_plain_coarse_energies(graph):
    ends, x, cluster, e, v, a = graph
    w, terms = coarse(ends, x, cluster)
    fine = sum(t * (x[i] - x[j]) ** 2 for (i, j), t in ends.items())
    energy = lambda weights: sum(t * terms[k] for k, t in weights.items())
    off = lambda weights: np.abs(energy(weights) / fine - 1).max()
    for found in (en.nodal_edges(e, v, a), en.greedy_edges(e, v, a)):
        assert off({(r.i, r.j): r.w for r in found.collect()}) < off(w)


def test_singletons_are_fitted_exactly_and_empty_graphs_give_nothing(spark, graph):
    *_, e, v, a = graph
    single = a.selectExpr("id", "id as cluster")
    found = {(r.i, r.j): r.w for r in en.greedy_edges(e, v, single).collect()}
    assert found == pytest.approx({(r.i, r.j): r.w for r in e.collect()})
    none = e.where("i < 0")
    assert en.greedy_terms(none, v, a).count() == 0 and en.adaptive(none, v, a).count() == 0
