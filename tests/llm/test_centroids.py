"""Clustering by n-simplex bounds against plain arithmetic in whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=16, rounds=3, dimensions=64, scale=64):
    x = [(i, [math.floor(scale * float(np.float32(v))) for v in e]) for i, e in rows if e is not None and len(e) == dimensions and all(v is not None and math.isfinite(v) for v in e)]
    seeds = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centres = [list(v) for _, v in seeds]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        to = [near(v)[1] for _, v in x]
        centres = [[sum(col) // len(own) for col in zip(*own)] if (own := [v for (_, v), t in zip(x, to) if t == n]) else c for n, c in enumerate(centres)]
    return sorted(((i, *near(v)[::-1]) for i, v in x), key=repr), centres


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 id", "2 x", "3 apex", "4 cluster", "5 distance")
    out, centres = ce.clustered(df, **kw)
    return sorted(((r.id, r.cluster, r.distance) for r in out.collect()), key=repr), centres.tolist(), out


def vectors(n, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(20, 64)) * 3
    return [(k, (middle[k % 20] + spread * draw.normal(size=64)).tolist()) for k in range(n)]


def test_equals_plain_arithmetic(spark):
    rows = vectors(400, 1) + [(None, vectors(1, 9)[0][1]), (7, vectors(1, 8)[0][1]), (7, vectors(1, 8)[0][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [math.nan] + [1.0] * 63), (905, [math.inf] + [0.0] * 63), (906, [0.0] * 64), (907, [-0.001] * 64)]
    got, centres, out = found(spark, rows)
    want, at = plain(rows)
    assert got == want and centres == at


def test_bounds_rule_centroids_out(spark):
    rows = vectors(400, 1, spread=0.2)
    got, centres, out = found(spark, rows)
    assert (got, centres) == plain(rows)
    compared = [r.compared for r in out.collect()]
    assert min(compared) == 1 and sum(compared) < 8 * len(compared)


def test_ties_and_equal_vectors(spark):
    rows = [(k, [float(k % 3)] * 64) for k in range(100)]
    got, centres, _ = found(spark, rows)
    assert (got, centres) == plain(rows)
    same = [(k, [1.5] * 64) for k in range(30)]
    got, centres, _ = found(spark, same)
    assert (got, centres) == plain(same)


def test_few_and_no_vectors(spark):
    rows = vectors(5, 3)
    got, centres, _ = found(spark, rows)
    assert (got, centres) == plain(rows) and len(centres) == 5
    assert found(spark, [])[:2] == ([], []) and found(spark, [(1, None)])[:2] == ([], [])


def test_numbers_past_the_range_are_an_error(spark):
    with pytest.raises(Exception, match="component beyond"):
        found(spark, [(1, [1e12] * 64)])


def test_large_numbers(spark):
    rows = [(k, (np.array(v) * 1e5).tolist()) for k, v in vectors(60, 4)]
    got, centres, _ = found(spark, rows)
    assert (got, centres) == plain(rows)


def test_the_query_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = ce.op13_centroid_clustering(spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not out.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-300, 300), min_size=5, max_size=5), min_size=1, max_size=12), st.lists(st.lists(st.integers(-300, 300), min_size=5, max_size=5), min_size=1, max_size=20))
def test_bounds_hold(pivots, rows):
    """The true squared distance lies between the bounds, whatever the pivots: repeated, collinear, or one alone."""
    p, x = np.array(pivots, np.int64), np.array(rows, np.int64)
    simplex = ce.Simplex(p)
    a = simplex.apexes(simplex.distances(x))
    low, high = ce.bounds(a, a)
    true = ((x[:, None] - x[None]) ** 2).sum(2)
    assert (low <= true).all() and (true <= high).all()
