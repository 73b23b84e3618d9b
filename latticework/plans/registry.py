"""All registered queries of the graph engine, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticework.plans import analytics, features, formats, graphs, levels, measures, multigrid, samples

FLAGSHIP = "galerkin"
_ALL = {**graphs.QUERIES, **features.QUERIES, **levels.QUERIES, **analytics.QUERIES, **measures.QUERIES, **samples.QUERIES, **formats.QUERIES, **multigrid.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
