"""Measures of all pairs of vectors within groups, block by block."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  #: vectors of a block, about: a call compares two blocks and returns up to BLOCK**2 rows
TILE = 64  #: vectors that are compared with a block at a time, so that sums stay in a core's cache

Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, summed component by component as SQL does."""
    out, part = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(a.T, np.ascontiguousarray(b.T)):
        out += np.multiply(x[:, None], y, out=part)
    return out


def squares(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for x in a.T:
        out += x * x
    return out


def abs_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Absolute cosines; NaN where a vector is zero, as in SQL."""
    return np.abs(dots(a, b) / np.sqrt(squares(a)[:, None] * squares(b)))


def affinity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(x.y)^2 / (|x|^2 |y|^2); NaN where a vector is zero, as in SQL."""
    p = dots(a, b)
    return p * p / (squares(a)[:, None] * squares(b))


def l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, part = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(a.T, np.ascontiguousarray(b.T)):
        np.subtract(x[:, None], y, out=part)
        out += np.multiply(part, part, out=part)
    return np.sqrt(out)


def rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """Decimals of values from 0 on, ties upwards, by the scaled double as DuckDB rounds."""
    scaled = v * 10.0**digits
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)) / 10.0**digits


def _by_length(t: pa.Table) -> list[tuple[int | None, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of each length, ids ascending; vectors that are null or hold null come last without one."""
    column = t.column("x").combine_chunks()
    ids = t.column("id").to_numpy()
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    if values.null_count:
        owner = np.repeat(np.arange(len(size)), np.maximum(size, 0))
        size[owner[values.is_null().to_numpy(zero_copy_only=False)]] = -1
    out = []
    for n in sorted(set(size.tolist()), reverse=True):
        at = np.flatnonzero(size == n)
        at = at[np.argsort(ids[at], kind="stable")]
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n) if n >= 0 else np.zeros((len(at), 0))
        out.append((n if n >= 0 else None, ids[at], x))
    return out


def all_pairs(rows: DataFrame, measure: Measure, digits: int, block: int = BLOCK) -> DataFrame:
    """(i, j, v): ``measure`` of all pairs i < j of ``rows(id, x, cluster)`` in one cluster, to ``digits`` decimals; null where a vector is null, holds null or they differ in length.

    Each cluster is dealt into blocks by id, and each two blocks, or one with itself, meet in a call of their own: what a task holds doesn't grow with the table, while the pairs, and with them the
    calls, grow with the square of a cluster.
    """
    largest = rows.groupBy("cluster").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, math.ceil(largest / block))

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        one = key[1].as_py() == key[2].as_py()
        first = _by_length(t if one else t.filter(pc.equal(t.column("part"), key[1])))
        second = first if one else _by_length(t.filter(pc.equal(t.column("part"), key[2])))
        found: list[tuple[np.ndarray, ...]] = []
        for n, a, x in first:
            for m, b, y in second:
                for at in range(0, len(a), TILE):
                    i, j = np.broadcast_arrays(a[at : at + TILE, None], b[None, :])
                    if n is not None and n == m:
                        with np.errstate(divide="ignore", invalid="ignore"):
                            v, none = rounded(measure(x[at : at + TILE], y), digits), 0
                    else:
                        v, none = np.zeros(i.shape), i.size
                    if one:
                        keep = i < j
                        i, j, v, none = i[keep], j[keep], v[keep], none and np.count_nonzero(keep)
                    found.append((np.minimum(i, j).ravel(), np.maximum(i, j).ravel(), v.ravel(), np.ones(none, bool) if none else np.zeros(v.size, bool)))
        i, j, v, none = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        return pa.table([pa.array(i), pa.array(j), pa.array(v, mask=none if none.any() else None)], ["i", "j", "v"])

    dealt = rows.where("id is not null and cluster is not null").select("id", "x", "cluster", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    to = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    to = to.select("id", "x", "part", "cluster", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    keys = ("cluster", "low", "high")
    calls = min(64 * parts * (parts + 1) // 2, 20_000)
    return to.repartition(calls, *keys).groupBy(*keys).applyInArrow(compare, "i long, j long, v double")
