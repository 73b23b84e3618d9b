"""Smallest eigenvalues of large symmetric matrices by block Davidson: vectors are tables, only projected matrices reach the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it

ROWS = "id long, q array<double>"


def _rows(column: pa.Array) -> np.ndarray:
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)[:, None]
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    if not x.shape[1]:
        return pa.array([[]] * len(x), pa.list_(pa.float64()))
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(x).ravel()))


def mapped(rows: DataFrame, f: Callable[..., np.ndarray]) -> DataFrame:
    """(id, q): each row's new vector by ``f`` of its vectors, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(f(*(_rows(b.column(k)) for k in range(1, b.num_columns))))], ["id", "q"])

    return rows.mapInArrow(run, ROWS)


def summed(rows: DataFrame, shape: tuple[int, int], f: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all rows of a small matrix: ``f`` of each batch's vectors, a row for each entry and task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += f(*(_rows(b.column(k)) for k in range(1, b.num_columns)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros(shape)
    for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # the matrix's entries
        out.flat[r["at"]] = r.v
    return out


def packed(matrix: DataFrame, entries: int = 250_000) -> tuple[DataFrame, int]:
    """Blocks (part, rows, i, j, v): the matrix in blocks of about ``entries`` entries, a row of arrays by ascending i for each, and the number of parts; ``part`` goes by the column's hash, ``rows`` by the row's.

    Checkpointed by ``part``, so that products move vectors and leave the matrix where it is. The number of entries in a part grows with the root of their number.
    """
    side = math.ceil(math.sqrt(max(matrix.count(), 1) / entries))
    cores = matrix.sparkSession.sparkContext.defaultParallelism
    side = max(side, min(cores, side * side))  # a part for each core, but for small matrices

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        i, j, v = (t.column(c).to_numpy() for c in "ijv")
        order = np.argsort(i, kind="stable")
        arrays = [pa.array([x[order]]) for x in (i, j, v)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *arrays], ["part", "rows", "i", "j", "v"])

    at = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    blocks = matrix.select(at("j").alias("part"), at("i").alias("rows"), "i", "j", "v").groupBy("part", "rows").applyInArrow(pack, "part int, rows int, i array<long>, j array<long>, v array<double>")
    return it.checkpointed(blocks.repartition(side, "part").sortWithinPartitions("part")), side


def times_block(blocks: DataFrame, side: int, x: DataFrame, width: int) -> DataFrame:
    """(id, w): the product of ``packed`` blocks with (id, x array of ``width``); rows without entries are left out. Each part meets its vectors alone; its sums, one for each row it has, are added by rows."""

    def multiply(m: pa.Table, x: pa.Table) -> pa.Table:
        out = []
        if x.num_rows and m.num_rows:
            ids, values = x.column("id").to_numpy(), _rows(x.column("x").combine_chunks())
            order = np.argsort(ids)
            ids, values = ids[order], values[order]
            for k in range(m.num_rows):
                i, j, v = (m.column(c)[k].values.to_numpy() for c in "ijv")
                place = np.minimum(np.searchsorted(ids, j), len(ids) - 1)
                starts = np.flatnonzero(np.diff(i, prepend=i[0] - 1))
                out.append((m.column("rows")[k].as_py(), i[starts], np.add.reduceat(np.where(ids[place] == j, v, 0.0)[:, None] * values[place], starts).ravel()))
        return pa.Table.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.list_(pa.int64())), pa.array([r[2] for r in out], pa.list_(pa.float64()))], ["rows", "i", "w"])

    def add(t: pa.Table) -> pa.Table:
        i, w = t.column("i").combine_chunks().flatten().to_numpy(), t.column("w").combine_chunks().flatten().to_numpy().reshape(-1, width)
        order = np.argsort(i, kind="stable")
        starts = np.flatnonzero(np.diff(i[order], prepend=i[order[0]] - 1))
        return pa.Table.from_arrays([pa.array(i[order][starts]), _lists(np.add.reduceat(w[order], starts))], ["id", "w"])

    x = x.select(F.pmod(F.xxhash64("id"), F.lit(side)).cast("int").alias("part"), "id", "x")
    sums = blocks.groupBy("part").cogroup(x.groupBy("part")).applyInArrow(multiply, "rows int, i array<long>, w array<double>")
    return sums.groupBy("rows").applyInArrow(add, "id long, w array<double>")


def changed(rows: DataFrame, kept: list[str], given: list[str], made: list[str], f: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """Columns ``kept`` and the vectors ``made`` by ``f`` of the columns ``given``, batch by batch."""
    k = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *map(_lists, f(*map(_rows, b.columns[k:])))], [*kept, *made])

    types = dict(rows.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in kept] + [f"{c} array<double>" for c in made])
    return rows.select(*kept, *(F.col(c).alias(f"given_{c}") for c in given)).mapInArrow(run, schema)


def _orthonormal(rows: DataFrame, width: int, floor: float = 1e-6) -> tuple[DataFrame, int]:
    """(id, q) with orthonormal columns that span the ``width`` columns of (id, q), twice by their inner products; dependent ones go."""
    for _ in range(2):
        e, v = np.linalg.eigh(summed(rows, (width, width), lambda q: q.T @ q))
        keep = e > max(floor * floor * e.max(initial=0.0), 0.0)
        turn = v[:, keep] / np.sqrt(e[keep])
        rows, width = it.stored(mapped(rows, lambda q, turn=turn: q @ turn), "basis"), int(keep.sum())
        if not width:
            break
    return rows, width


def _without_means(rows: DataFrame, column: str, width: int, few: bool) -> DataFrame:
    """Rows with a vector (group, ..., ``column``) less its group's mean; ``few``: the means of all groups go to each task."""
    mean = rows.groupBy("group").agg(F.array(*(F.avg(F.col(column)[c]) for c in range(width))).alias("mean"))
    return rows.join(F.broadcast(mean) if few else mean, "group").withColumn(column, F.zip_with(column, "mean", lambda a, b: a - b)).drop("mean")


class Spectrum:
    """Ascending eigenvalues, the 2-norms of their residuals, (id, q array with an entry for each) and how often the matrix was applied."""

    def __init__(self, values: np.ndarray, residuals: np.ndarray, vectors: DataFrame, products: int):
        self.values, self.residuals, self.vectors, self.products = values, residuals, vectors, products


def smallest(matrix: DataFrame, nodes: DataFrame, wanted: int = 5, groups: DataFrame | None = None, extra: int = 3, depth: int = 60, restarts: int = 10, tolerance: float = 1e-7, held: int = 6) -> Spectrum:
    """The ``wanted`` smallest eigenvalues of a symmetric matrix (i, j, v) over ``nodes`` (id); repeated ones as often as they occur, up to the block's width.

    ``groups`` (id, group): vectors that are constant on each group are left out, for matrices whose null space they span. Block Davidson: the first ``wanted + extra`` vectors are random, larger where
    the diagonal is small; each step takes the best vectors' residuals, divided by the distance of the diagonal from the value, made orthogonal to all before, twice, and multiplied by the matrix. The matrix
    projected on them all gives values and residuals; it ends where the latter are ``tolerance`` times the largest value or less, or nothing is left. Of more than ``held`` blocks the best two and the step
    before are kept. An error after ``depth`` times ``restarts`` products. Fewer values come where the space has no more. Only vectors are moved; projections are sums over a stored table.
    """
    matrix = it.stored(matrix.select("i", "j", "v").where("v <> 0"), "matrix")
    blocks, side = packed(matrix)
    width = wanted + extra
    diagonal = matrix.where("i = j").groupBy(F.col("i").alias("id")).agg(F.sum("v").alias("d"))
    base = nodes.select("id").join(diagonal, "id", "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    base = base.join(groups.select("id", "group"), "id") if groups is not None else base.withColumn("group", F.lit(0).cast("long"))
    low, middle, few = base.agg(F.min(F.when(F.col("d") != 0, F.abs("d"))), F.avg(F.abs("d")), F.count_distinct("group") <= 20_000).first()
    weight = F.when(F.col("d") == 0, 1.0).otherwise(F.greatest(F.pow(F.lit(low or 1.0) / F.abs("d"), 16), F.lit(1e-4)))
    state = base.withColumn("q", F.array(*(weight * (2 * g.uniform(F.col("id"), c) - 1) for c in range(width))))
    state = it.stored(_without_means(state, "q", width, few) if groups is not None else state, "basis")
    basis, width = _orthonormal(state.select("id", "q"), width)
    if not width:
        return Spectrum(np.zeros(0), np.zeros(0), basis, 0)
    keys, floor = ["id", "group", "d"], 0.05 * (middle or 0.0) or 1.0
    next_state, next_rows = it.turns(matrix.sparkSession, "davidson", 2), it.turns(matrix.sparkSession, "residuals", 1)  # a state is read until the next is written
    product = lambda x, n: times_block(blocks, side, x, n)
    none = lambda n: F.array(*[F.lit(0.0)] * n)
    state = next_state(state.select(*keys).join(basis, "id").join(product(basis.select("id", F.col("q").alias("x")), width), "id", "left").select(*keys, "q", F.coalesce("w", none(width)).alias("p")))
    size, block, products, before = width, width, 1, None
    t = gram = np.zeros((0, 0))
    last = width
    while True:
        both = summed(state.select("id", "q", "p"), (2 * size, last), lambda q, p, last=last: np.vstack([q.T @ p[:, -last:], p.T @ p[:, -last:]]))
        t, gram = (np.block([[m, new[: size - last]], [new[: size - last].T, new[size - last :]]]) for m, new in ((t, both[:size]), (gram, both[size:])))
        values, turn = np.linalg.eigh((t + t.T) / 2)
        n, lead, top = min(wanted, size), min(block, size), np.abs(values).max()
        u = turn[:, :lead]
        left = np.sqrt(np.maximum(np.einsum("ak,ab,bk->k", u, gram, u) - values[:lead] ** 2, 0.0))  # to about 1e-8 of the largest value
        fine = bool((left[:n] <= tolerance * top).all())
        exact = fine and np.sqrt(np.diag(summed(state.select("id", "q", "p"), (n, n), lambda q, p, u=u[:, :n], e=values[:n]: (lambda r: r.T @ r)(p @ u - (q @ u) * e))))
        if fine and (exact <= tolerance * top).all():
            break
        if products >= depth * restarts:
            raise ArithmeticError(f"residuals up to {left[:n].max():.1e} after {depth} times {restarts} restarts, above {tolerance:.1e} times {top:.3g}")
        keep = np.eye(size)
        if size + lead > held * block:
            keep = np.linalg.qr(np.hstack([turn[:, : 2 * block], before] if before is not None else [turn[:, : 2 * block]]))[0]
        head, e = keep.T @ u, values[:lead]

        def step(q: np.ndarray, p: np.ndarray, d: np.ndarray, u=u, e=e, keep=keep) -> tuple[np.ndarray, ...]:
            away = d - e
            away = np.where(np.abs(away) < floor, np.where(away < 0, -floor, floor), away)
            return q @ keep, p @ keep, (p @ u - (q @ u) * e) / away

        rows = changed(state, keys, ["q", "p", "d"], ["q", "p", "x"], step)
        rows = next_rows(_without_means(rows, "x", lead, few) if groups is not None else rows)
        t, gram, size = keep.T @ t @ keep, keep.T @ gram @ keep, keep.shape[1]
        h = summed(rows.select("id", "q", "x"), (size + lead, lead), lambda q, x: np.vstack([q.T @ x, x.T @ x]))
        norm = np.sqrt(np.diag(h[size:]))
        use = np.flatnonzero(norm > 1e-12)
        h = h[:size, use] / norm[use]
        once = lambda q, x, h=h, use=use, norm=norm: x[:, use] / norm[use] - q @ h
        again = summed(rows.select("id", "q", "x"), (size + len(use), len(use)), lambda q, x, once=once: (lambda r: np.vstack([q.T @ r, r.T @ r]))(once(q, x)))
        e2, v2 = np.linalg.eigh(again[size:] - again[:size].T @ again[:size]) if len(use) else (np.zeros(0), np.zeros((0, 0)))
        good = e2 > max(1e-6 * e2.max(initial=0.0), 1e-20)
        last = int(good.sum())
        if not last:  # nothing is left outside the space
            state = rows
            values, turn = np.linalg.eigh((t + t.T) / 2)
            exact = np.sqrt(np.diag(summed(state.select("id", "q", "p"), (n, n), lambda q, p, u=turn[:, :n], e=values[:n]: (lambda r: r.T @ r)(p @ u - (q @ u) * e))))
            if not (exact <= tolerance * top).all():
                raise ArithmeticError(f"residuals of {exact.max():.1e} and no direction left, above {tolerance:.1e} times {top:.3g}")
            break
        rows = changed(rows, keys, ["q", "p", "x"], ["q", "p", "x"], lambda q, p, x, once=once, h2=again[:size], out=v2[:, good] / np.sqrt(e2[good]): (q, p, (once(q, x) - q @ h2) @ out))
        w = product(rows.select("id", "x"), last)
        state = next_state(rows.join(w, "id", "left").select(*keys, F.concat("q", "x").alias("q"), F.concat("p", F.coalesce("w", none(last))).alias("p")))
        before = np.vstack([head, np.zeros((last, lead))])
        size, products = size + last, products + 1
    x = it.stored(mapped(state.select("id", "q"), lambda q, turn=turn[:, :n]: q @ turn), "basis")
    return Spectrum(values[:n], exact, x, products)


def laplacian_spectrum(edges: DataFrame, nodes: DataFrame, wanted: int = 5, **how) -> tuple[int, Spectrum]:
    """How many eigenvalues of the Laplacian are zero (one for each component), and the ``wanted`` smallest of the others."""
    edges = it.stored(edges.select("i", "j", "w"), "edges")
    groups = it.checkpointed(it.contracted_components(edges, nodes).select("id", F.col("component").alias("group")))
    return groups.select("group").distinct().count(), smallest(g.laplacian(edges), nodes, wanted, groups, **how)


def report(zeros: int, rest: np.ndarray) -> dict[str, float | int | None]:
    """components, fiedler (the second eigenvalue), both gaps, mixing time and conductance bound, from the number of zeros and the first two other eigenvalues."""
    e = ([0.0] * zeros + [float(v) for v in rest])[:3]
    fiedler = e[1] if len(e) > 1 else None
    return {
        "components": zeros, "fiedler": fiedler, "gap": e[2] - e[1] if len(e) > 2 else None, "first_gap": e[1] - e[0] if len(e) > 1 else None,
        "mixing": 1 / fiedler if fiedler else None, "conductance_bound": fiedler / 2 if fiedler is not None else None,
    }
