"""Measures of all pairs against SQL, with a cluster of several blocks and odd vectors."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from latticework.operators import pairs
from latticework.plans import registry
from latticework.sources.graphs import table

DATA = "/root/testdata/sf0.001"
NAMES = ("vec_cosine", "vec_affinity", "vec_l2")


def found(df):
    rows = df.collect()
    out = {(r.i, r.j): r.v for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", NAMES)
def test_every_digit_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    theirs = {r[:2]: r[2] for r in con.execute(registry.oracle_sql()[name]).fetchall()}
    assert found(registry.queries()[name](spark, DATA)) == theirs and len(theirs) > 1000


def test_zero_vectors_as_in_sql(spark, tmp_path):
    """A cosine or affinity with a zero vector is no number in SQL."""
    rows = [(0, [0.0, 0.0], 1), (64, [0.0, 0.0], 1), (128, [3.0, 4.0], 1), (192, [4.0, -3.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in NAMES:
        theirs = {r[:2]: r[2] for r in con.execute(registry.oracle_sql()[name]).fetchall()}
        ours = found(registry.queries()[name](spark, str(tmp_path)))
        assert ours.keys() == theirs.keys() and len(ours) == 6
        assert all(np.isnan(ours[k]) if np.isnan(theirs[k]) else ours[k] == theirs[k] for k in theirs)


def test_blocks_of_a_cluster_lose_no_pair(spark):
    """A task compares blocks of bounded size, whatever a cluster's size: each pair comes once."""
    x = table(spark, DATA, "embeddings").selectExpr("vec_id AS id", "CASE WHEN vec_id = 5 THEN NULL WHEN vec_id = 6 THEN slice(embedding, 1, 3) ELSE embedding END AS x", "0L AS cluster").where("id < 90")
    n = x.count()
    whole, parted = (found(pairs.all_pairs(x, pairs.l2, 6, block)) for block in (1000, 20))
    assert whole == parted and len(whole) == n * (n - 1) // 2 and all(i < j for i, j in whole)
    assert {k for k, v in whole.items() if v is None} == {k for k in whole if 5 in k or 6 in k}
