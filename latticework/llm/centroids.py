"""Centroid clustering with n-simplex projection: cached distances to a few pivots give each vector an apex, whose bounds rule out centroids before exact distances.

With pivots p0..pm as a simplex, an object at distances d0..dm has its foot in the pivots' hyperplane and a height above it. The Euclidean distance of two
such points with heights on the same side is at most, and with heights on opposite sides at least, the distance of the objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import table, written
from latticework.llm.vectors import as_doubles, matrix

LARGEST = 2.0**27  #: of a component's whole number: squared distances of up to 256 of them stay below 2^63
SLACK = 1e-9  #: of the squared distances that a bound is made of, for what rounding can take


class Simplex:
    """The pivots' own simplex, from their pairwise distances alone."""

    def __init__(self, pivots: np.ndarray):
        """pivots: whole numbers. Pivots that (nearly) lie in the hyperplane of those before them are left out."""
        square = lambda a, b: float(((a - b) ** 2).sum())
        at, rows = [0] if len(pivots) else [], []
        scale = max((square(pivots[0], p) for p in pivots), default=0.0)
        for k in range(1, len(pivots)):
            base = square(pivots[0], pivots[k])
            row: list[float] = []
            for i, other in enumerate(at[1:]):
                inner = (square(pivots[0], pivots[other]) + base - square(pivots[other], pivots[k])) / 2
                row.append((inner - float(np.dot(row, rows[i][: len(row)]))) / rows[i][i])
            rest = base - float(np.dot(row, row))
            if rest > 1e-6 * scale:
                at.append(k)
                rows.append([*row, rest**0.5])
        self.pivots = pivots[at]
        self.base = np.zeros((len(rows), len(rows)))
        for k, row in enumerate(rows):
            self.base[k, : len(row)] = row
        self.from_first = np.array([square(pivots[0], pivots[k]) for k in at[1:]])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of each row to the pivots."""
        return np.stack([((x - p) ** 2).sum(1) for p in self.pivots], 1).astype(float)

    def apexes(self, d: np.ndarray) -> np.ndarray:
        """A row (foot, height, d0) for each row of squared distances."""
        inner = (d[:, :1] + self.from_first - d[:, 1:]) / 2
        foot = np.empty_like(inner)
        for k in range(inner.shape[1]):
            foot[:, k] = (inner[:, k] - foot[:, :k] @ self.base[k, :k]) / self.base[k, k]
        height = np.sqrt(np.maximum(0, d[:, 0] - (foot * foot).sum(1)))
        return np.column_stack([foot, height, d[:, 0]])


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distances that the apexes ``a`` (rows) and ``b`` (columns) leave, with slack for rounding."""
    flat = sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(a.shape[1] - 2)) if a.shape[1] > 2 else np.zeros((len(a), len(b)))
    up, across = a[:, None, -2], b[None, :, -2]
    slack = SLACK * (1 + a[:, None, -1] + b[None, :, -1])
    return flat + (up - across) ** 2 - slack, flat + (up + across) ** 2 + slack


def nearest(x: np.ndarray, apexes: np.ndarray, centres: np.ndarray, centre_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest centre (ties: the smaller number), its squared distance in whole numbers, and how many distances were taken for it."""
    low, high = bounds(apexes, centre_apexes)
    left = low <= high.min(1, keepdims=True)
    best = np.full(len(x), np.iinfo(np.int64).max)
    to = np.zeros(len(x), np.int32)
    for c in range(len(centres)):
        rows = np.flatnonzero(left[:, c])
        d = ((x[rows] - centres[c]) ** 2).sum(1)
        closer = d < best[rows]
        best[rows[closer]], to[rows[closer]] = d[closer], c
    return to, best, left.sum(1)


def _whole(batch: pa.RecordBatch, column: int, dimensions: int, kind) -> np.ndarray:
    return matrix(batch.column(column)).astype(kind) if batch.num_rows else np.empty((0, dimensions), kind)


def whole_numbers(vectors: DataFrame, dimensions: int, scale: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x array<long>) with x = floor(scale * component) of the vectors with ``dimensions`` components, none null or non-finite.

    An error where a number is beyond ``LARGEST``, as squared distances could be past 64 bits.
    """
    e = F.col(vector)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    fits = vectors.where(e.isNotNull() & (F.size(e) == dimensions) & F.coalesce(F.forall(e, fine), F.lit(False)))
    scaled = F.transform(as_doubles(vector), lambda v: v * scale)
    held = F.when(F.forall(scaled, lambda v: F.abs(v) <= LARGEST), scaled).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST / scale:.0f}")).cast("array<double>"))
    return fits.select(F.col(id_).cast("long").alias("id"), F.transform(held, lambda v: F.floor(v).cast("long")).alias("x"))


def seeds(rows: DataFrame, k: int, salt: int = 1) -> np.ndarray:
    """The ``k`` vectors (all, if fewer) with the smallest SHA-256 of "salt:id", ties by their components; null ids come last."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    top = rows.select(key.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in top], np.int64)


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, pivots: int = 16, id_: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, compared) of each kept vector after ``rounds`` of moving ``k`` centroids, and the centroids (rows of whole numbers).

    The vectors' apexes over the first centroids as pivots are computed once and stored; each round is one pass that needs only them and the centroids
    (``k`` rows, sent along). A task keeps one sum a centroid; the sums of all tasks are added by Spark as decimals, so means are floors of exact quotients. Empty
    clusters keep their centroid. Null ids and repeated rows are vectors like others. No kept vector: no rows, no centroids.
    """
    rows = written(whole_numbers(vectors, dimensions, scale, id_, vector), "whole")
    centres = seeds(rows, k)
    if not len(centres):
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("compared")), centres
    simplex = Simplex(centres[:pivots])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apexes = simplex.apexes(simplex.distances(_whole(b, 1, dimensions, np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(apexes.ravel()), apexes.shape[1]).cast(pa.list_(pa.float64()))], ["id", "x", "apex"])

    cached = written(rows.mapInArrow(project, "id long, x array<long>, apex array<double>"), "apexes")
    width = len(simplex.pivots) + 1

    def assign(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        at = simplex.apexes(simplex.distances(centres))
        for b in batches:
            if b.num_rows:
                x = _whole(b, 1, dimensions, np.int64)
                yield b, x, *nearest(x, _whole(b, 2, width, float), centres, at)

    def moved(centres: np.ndarray) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), dimensions), object)
            for _, x, to, _, _ in assign(batches, centres):
                for c in np.unique(to).tolist():
                    n[c] += (to == c).sum()
                    total[c] += x[to == c].sum(0)  # a batch's sum fits into 64 bits, the task's has no bound
            full = np.flatnonzero(n)
            if len(full):
                values = pa.array([Decimal(int(v)) for c in full for v in total[c]], pa.decimal128(38))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, dimensions).astype(np.int32)), pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(full))), pa.array(np.repeat(n[full], dimensions)), values], ["cluster", "at", "n", "total"])

        out = centres.copy()
        per = cached.mapInArrow(sums, "cluster int, at int, n long, total decimal(38,0)").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in per.collect():  # centroids times dimensions
            out[r.cluster, r["at"]] = int(r.total) // r.n
        return out

    for _ in range(rounds):
        centres = moved(centres)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, to, d, compared in assign(batches, centres):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(to), pa.array(d), pa.array(compared.astype(np.int32))], ["id", "cluster", "distance", "compared"])

    return cached.mapInArrow(last, "id long, cluster int, distance long, compared int"), centres


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of all 64-dimensional ``embeddings`` after three rounds: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    found, centres = clustered(table(spark, sf_dir, "embeddings"))
    rows = written(found, "clusters")
    names = spark.createDataFrame([(k, ",".join(map(str, c.tolist()))) for k, c in enumerate(centres)], "cluster int, components string")
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per = per.join(names, "cluster").crossJoin(F.broadcast(rows.agg(F.sum("distance").alias("inertia"))))  # inertia: one row
    per = per.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(per), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # per: a row for each centroid


def _sql(rounds: int = 3) -> str:
    near = "SELECT x.r, x.vec_id, x.x, c.cluster, c.c, (x.xx - 2 * list_inner_product(x.x, c.c) + list_inner_product(c.c, c.c))::BIGINT AS distance FROM x, c{} c"
    text = """WITH f AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS (SELECT row_number() OVER () AS r, vec_id, x, list_inner_product(x, x) AS xx FROM (SELECT vec_id, list_transform(v, lambda y: floor(64 * y)) AS x FROM f)),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1)::INT AS cluster, x AS c FROM x QUALIFY cluster < 16)"""
    for k in range(rounds):
        text += f""",
a{k} AS ({near.format(k)} QUALIFY row_number() OVER (PARTITION BY x.r ORDER BY distance, c.cluster) = 1),
u{k} AS (SELECT cluster, unnest(x)::BIGINT AS v, generate_subscripts(x, 1) AS pos FROM a{k}), s{k} AS (SELECT cluster, pos, sum(v) AS s, count(*) AS n FROM u{k} GROUP BY 1, 2),
m{k} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS c FROM s{k} GROUP BY 1), c{k + 1} AS (SELECT cluster, coalesce(m.c, p.c) AS c FROM c{k} p LEFT JOIN m{k} m USING (cluster))"""
    return f"""{text},
z AS ({near.format(rounds)} QUALIFY row_number() OVER (PARTITION BY x.r ORDER BY distance, c.cluster) = 1)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda y: y::BIGINT), ',')) AS centroid_sha256 FROM z"""


OP13_SQL = _sql()
