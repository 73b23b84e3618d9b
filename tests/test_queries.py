"""Each query of the graph engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from latticework.plans import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'").fetchall()
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    ours, theirs = ordered(registry.queries()[name](spark, DATA).toPandas()), ordered(db.execute(SQL[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, check_exact=False, rtol=0, atol=1.5e-6)
    assert len(ours)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count()
