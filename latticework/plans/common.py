"""Registration of queries, and roundings that make engines comparable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Queries(dict):
    """name -> (query, DuckDB SQL or None)."""

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self[name] = (f, sql)
            return f

        return keep


def r6(c: str | Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(c: Column, digits: int) -> Column:
    """``digits`` decimals by the nearest whole number of the scaled double, ties away from zero, as DuckDB rounds; Spark's ``round`` goes by the shortest decimal text."""
    scaled = F.abs(c) * float(10**digits)
    whole = F.rint(scaled)
    return F.signum(c) * (whole + F.when(scaled - whole == 0.5, 1.0).otherwise(0.0)) / float(10**digits)


def same(c: Column, digits: int) -> Column:
    """``digits`` decimals, halves up by floor: a rule that does not depend on an engine's rounding of ties."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5).cast("double") / scale
