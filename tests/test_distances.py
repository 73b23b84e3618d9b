"""Hops, diameters and connectivity against plain searches."""

from __future__ import annotations

import random
from collections import deque

import pytest

from latticework.operators import distances as ds
from latticework.operators import iterative as it
from latticework.sources import graphs as src


def plain(pairs, source):
    near: dict[int, set] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, todo = {source: 0}, deque([source])
    while todo:
        k = todo.popleft()
        for j in near.get(k, ()):
            if j not in out:
                out[j] = out[k] + 1
                todo.append(j)
    return out


def of(spark, pairs):
    return it.checkpointed(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "i long, j long, w double"))


def test_hops(spark):
    draw = random.Random(4)
    pairs = sorted({tuple(sorted(draw.sample(range(60), 2))) for _ in range(70)} | {(0, k) for k in range(1, 12)})
    found = {(r.source, r.id): r.hops for r in ds.hops(of(spark, pairs), spark.createDataFrame([(0,), (7,), (59,), (99,), (7,)], "id long")).collect()}
    assert found == {(s, k): d for s in (0, 7, 59, 99) for k, d in plain(pairs, s).items()}


@pytest.mark.parametrize("kind", ["path", "random", "star"])
def test_diameter_and_radius(spark, kind):
    if kind == "random":
        draw = random.Random(8)
        pairs = sorted({tuple(sorted((k, draw.randrange(max(1, k - 12), k) if k > 1 else 0))) for k in range(1, 70)} | {tuple(sorted(draw.sample(range(20), 2))) for _ in range(10)})
    else:
        pairs = [(k, k + 1) for k in range(25)] if kind == "path" else [(0, k) for k in range(1, 30)]
    size = max(b for _, b in pairs) + 1
    e = [max(plain(pairs, k).values()) for k in range(size)]
    assert ds.eccentricity_bounds(of(spark, pairs), spark.range(size), batch=4) == (max(e), min(e))


def test_report_of_parts(spark):
    edges = src.union(src.complete(spark, 4), src.path(spark, 4, 1.0), 4, (0, 1, 0.0)).where("w > 0")
    found = ds.report(edges, spark.range(9))
    assert found == {"nodes": 9, "edges": 9, "components": 3, "is_connected": False, "largest": 4, "share": 4 / 9, "diameter": 1, "radius": 1, "clustering": 4 / 9, "density": 18 / 72}


def test_report_of_nothing(spark):
    found = ds.report(spark.createDataFrame([], "i long, j long, w double"), spark.range(0))
    assert found == {"nodes": 0, "edges": 0, "components": 0, "is_connected": False, "largest": 0, "share": 0.0, "diameter": 0, "radius": 0, "clustering": 0.0, "density": 0.0}
