"""Catalogues of files, tolerant readers and runs that skip what is finished."""

from __future__ import annotations

import pytest

from latticework.sources import catalogue as cat
from latticework.sources import graphs as src


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.dimacs").write_text("c note\np edge 3 2\ne 1 2\ne 2 3 4.5\ne 3 2 4.5\ne 2 2\n")
    (tmp_path / "a" / "two.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% 1 2 -9\n\n 3 3 2 \n2 1 -1.5\n\n  3\t1 -2\nbroken line\n3\n")
    (tmp_path / "b.cc").write_text("1 2 -1\n2 1 -1\n1 1 1\nx\n1\n")
    (tmp_path / "empty.dimacs").write_text("c no edges\n")
    (tmp_path / "none.dimacs").write_text("")  # left out
    (tmp_path / "other.txt").write_text("e 1 2\n")
    return f"file://{tmp_path}", tmp_path


def test_catalogue_and_reading(spark, files):
    root, _ = files
    found = cat.catalogue(spark, root)
    assert {(r.key, r["format"], r.name) for r in found.collect()} == {("a/one.dimacs", "dimacs", "one.dimacs"), ("a/two.mtx", "mtx", "two.mtx"), ("b.cc", "cc", "b.cc"), ("empty.dimacs", "dimacs", "empty.dimacs")}
    edges = sorted(map(tuple, cat.read_all(found).collect()))
    assert edges == [("a/one.dimacs", 0, 1, 1.0), ("a/one.dimacs", 1, 2, 4.5), ("a/two.mtx", 0, 1, 1.5), ("a/two.mtx", 0, 2, 2.0), ("b.cc", 0, 1, 1.0)]
    assert cat.read_all(found.where("key = 'none'")).count() == 0
    assert {r.key for r in cat.with_edges_between(cat.read_all(found), 2, 9).collect()} == {"a/one.dimacs", "a/two.mtx"}


@pytest.mark.parametrize("kind, mirrored", [("general", None), ("symmetric", 1.0), ("skew-symmetric", -1.0)])
def test_matrix_banners(spark, tmp_path, kind, mirrored):
    (tmp_path / "m.mtx").write_text(f"%%MatrixMarket matrix coordinate real {kind}\n%\n2 2 2\n2 1 3\n2 2\n")
    found = sorted(map(tuple, src.read_matrix_market(spark, f"file://{tmp_path}/m.mtx").collect()))
    assert found == sorted([(1, 0, 3.0), (1, 1, 1.0)] + ([(0, 1, 3.0 * mirrored)] if mirrored else []))


def test_a_second_run_does_only_new_files(spark, files, tmp_path_factory):
    root, folder = files
    results, seen = f"file://{tmp_path_factory.mktemp('runs')}/results", []

    def job(edges):
        seen.append({r.key for r in edges.select("key").distinct().collect()})
        return cat.statistics(edges)

    assert cat.run(cat.catalogue(spark, root), results, job, at_once=2, label="first") == 4
    assert seen == [{"a/one.dimacs", "a/two.mtx"}, {"b.cc"}]
    (folder / "c.dimacs").write_text("e 5 6 2\n")
    seen.clear()
    assert cat.run(cat.catalogue(spark, root), results, job, label="second") == 1 and seen == [{"c.dimacs"}]
    assert cat.run(cat.catalogue(spark, root), results, job, label="third") == 0 and len(seen) == 1
    rows = {r.key: (r.nodes, r.edges, r.weight, r.run) for r in cat.finished(spark, results).collect()}
    assert rows == {"a/one.dimacs": (3, 2, 5.5, "first"), "a/two.mtx": (3, 2, 3.5, "first"), "b.cc": (2, 1, 1.0, "first"), "empty.dimacs": (None, None, None, "first"), "c.dimacs": (2, 1, 2.0, "second")}


def test_a_run_cut_short_goes_on(spark, files, tmp_path_factory):
    root, _ = files
    results, calls = f"file://{tmp_path_factory.mktemp('cut')}/results", []

    def fails_late(edges):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return cat.statistics(edges)

    with pytest.raises(RuntimeError):
        cat.run(cat.catalogue(spark, root), results, fails_late, at_once=2)
    assert cat.run(cat.catalogue(spark, root), results, cat.statistics, at_once=2) == 2
    assert cat.finished(spark, results).count() == 4


def test_broken_results(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,2,0.5\n1,3,FAILED\n2,1, Timeout \n2,2,\n3\nx,1,2.0\n4,1,1.2.3\n5,1,NaN\n")
    found = [tuple(r) for r in cat.read_results(spark, f"file://{tmp_path}/r.csv", "k long, line int", "seconds").orderBy("k", "line").collect()]
    assert found == [(None, 1, None, "broken"), (1, 2, 0.5, "ok"), (1, 3, None, "failed"), (2, 1, None, "timeout"), (2, 2, None, "missing"), (3, None, None, "broken"), (4, 1, None, "broken"), (5, 1, None, "broken")]
