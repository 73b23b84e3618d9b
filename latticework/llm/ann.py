"""Nearest neighbours by shifted Hilbert curves over projected vectors, with an exact completion over the curve's blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.llm.common import table, written
from latticework.llm.vectors import as_doubles, cosines, matrix, usable

AXES, BITS = 8, 7  #: of the curves: 56-bit keys
AT_ONCE = 4096  #: queries that are sent to all tasks together: a fixed size


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of integer cells along the Hilbert curve (Skilling's transposition, for all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(v: np.ndarray, curves: int, seed: int = 5) -> np.ndarray:
    """Hilbert keys of unit vectors, a column for each curve: each has its own random projection and shift."""
    rng, d = np.random.default_rng([seed, v.shape[1]]), v.shape[1]
    out = np.empty((len(v), curves), np.int64)
    for c in range(curves):
        axes = np.linalg.qr(rng.normal(size=(d, min(AXES, d))))[0]
        shift = rng.uniform(-0.5, 0.5, axes.shape[1]) / np.sqrt(d)
        low = np.clip(((v @ axes) * np.sqrt(d) / 6 + shift + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
        out[:, c] = hilbert(low.astype(np.int64), BITS)
    return out


def best(queries: np.ndarray, ids: np.ndarray, v: np.ndarray, own: np.ndarray, k: int, over: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """The ``k`` nearest rows of ``v`` to each query, as (query's place, id, cosine); ties go to the smaller id, ``own`` ids are left out.

    ``over``: cosines below these needn't be reported. Products in blocks choose the candidates, ties and near ties
    included; those are scored again one by one, so that equal vectors get equal scores.
    """
    qn = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    s = qn @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    s[own[:, None] == ids[None, :]] = -np.inf
    kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
    least = kth if over is None else np.maximum(kth, over)
    q, r = np.nonzero(s >= (least - 1e-9)[:, None])
    exact = cosines(queries[q], v[r])
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    keep = nth < k
    return list(zip(q[keep].tolist(), ids[r[keep]].tolist(), exact[keep].tolist()))


def top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query's found rows, each row once. A query has a bounded number of rows from each task."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 5, curves: int = 4, reach: int = 64, block: int = 1024) -> DataFrame:
    """For each row that ``is_query`` (a column) picks, the ``k`` other rows of largest cosine: query_id, rank, vec_id, score.

    vectors: vec_id, embedding; further columns are ignored. Vectors that are null, zero or hold null or non-finite components take no
    part; vectors of different lengths have no cosine and are searched apart. Ties go to the smaller vec_id; rows that share a vec_id
    are not each other's neighbours. Fewer than ``k`` other rows: all of them. An empty table gives an empty result.

    Every row is laid along ``curves`` Hilbert orderings of random projections with random shifts, range-partitioned by key. Within
    ``reach`` places on each, candidates are ranked: this gives each query a bound, the k-th cosine so far. As vectors without cluster structure
    have neighbours that no ordering of few dimensions brings near, the window then widens along the first ordering: blocks of
    it, whose centre and angle allow a cosine above a query's bound, are ranked as well; the others are passed over. So no neighbour is lost.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max(block, 2 * reach)))
    rows = usable(vectors).select(F.col("vec_id").cast("long"), as_doubles().alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("d", F.size("v"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(3).to_numpy()
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                v = matrix(part.column(1))
                keys = curve_keys(v / np.linalg.norm(v, axis=1, keepdims=True), curves)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * curves, pa.int32()), pa.array(keys.ravel()))], ["vec_id", "v", "asks", "d", "keys"])

    index = written(rows.mapInArrow(keyed, "vec_id long, v array<double>, asks boolean, d int, keys array<long>"), "hilbert-index")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of a batch with vectors of one length."""
        for b in batches:
            sizes = b.column(b.schema.get_field_index("d")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    yield b.slice(s, e - s)

    out = "query_id long, vec_id long, score double"
    names = ["query_id", "vec_id", "score"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            ids, v, asks, curve = b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False), b.column(4).to_numpy()
            for at in np.flatnonzero(asks):
                s, e = max(0, at - reach), at + reach + 1
                same = np.flatnonzero(curve[s:e] == curve[at]) + s
                found = best(v[at : at + 1], ids[same], v[same], ids[at : at + 1], k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([int(ids[at])] * len(found)), pa.array([x[1] for x in found]), pa.array([x[2] for x in found])], names)

    laid = index.select("vec_id", "v", "asks", "d", F.posexplode("keys").alias("curve", "key"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = laid.repartitionByRange(parts, "d", "curve", "key", "vec_id").sortWithinPartitions("d", "curve", "key", "vec_id").drop("key")
    first = written(top(ordered.mapInArrow(near, out), k), "hilbert-near")

    queries = index.where("asks").select("vec_id", "v", "d").join(first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score"), "vec_id", "left")
    queries = queries.distinct().withColumn("part", F.monotonically_increasing_id())
    queries = written(queries, "hilbert-queries")
    groups = max(1, -(-queries.count() // AT_ONCE))
    # blocks of the first ordering; the same partitioning is swept for each group of queries
    swept = written(index.select("vec_id", "v", "d", F.col("keys")[0].alias("key")).repartitionByRange(parts, "d", "key", "vec_id").sortWithinPartitions("d", "key", "vec_id").drop("key"), "hilbert-blocks")
    found = [first.select(*names)]
    for g in range(groups):
        sent = [(r.vec_id, r.v, -2.0 if r.score is None else r.score, r.d) for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toLocalIterator()]
        held = spark.sparkContext.broadcast({d: (np.array([x[0] for x in sent if x[3] == d]), np.array([x[1] for x in sent if x[3] == d]), np.array([x[2] for x in sent if x[3] == d])) for d in {x[3] for x in sent}})

        def widen(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bounds = {d: over.copy() for d, (_, _, over) in held.value.items()}
            kept: dict[int, dict[int, list[tuple[float, int]]]] = {}
            for b in blocks(batches):
                d = b.column(2)[0].as_py()
                if d not in held.value:
                    continue
                q_ids, q, _ = held.value[d]
                ids, v = b.column(0).to_numpy(), matrix(b.column(1))
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                centre = unit.mean(0)
                centre /= max(np.linalg.norm(centre), 1e-300)
                angle = np.arccos(np.clip((unit @ centre).min(), -1, 1))
                apart = np.arccos(np.clip(q @ centre / np.linalg.norm(q, axis=1), -1, 1))
                on = np.flatnonzero(np.cos(np.maximum(0, apart - angle)) >= bounds[d] - 1e-9)
                if not len(on):
                    continue
                for at, i, s in best(q[on], ids, v, q_ids[on], k, bounds[d][on]):
                    own = kept.setdefault(int(on[at]), {}).setdefault(d, [])
                    own.append((-s, i))
                    if len(own) > 4 * k:
                        own[:] = sorted(own)[:k]
                        bounds[d][on[at]] = max(bounds[d][on[at]], -own[-1][0])
            lines = [(int(held.value[d][0][at]), i, -s) for at, by in kept.items() for d, own in by.items() for s, i in sorted(own)[:k]]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines)], names)

        found.append(swept.mapInArrow(widen, out))
    everything = found[0]
    for x in found[1:]:
        everything = everything.unionByName(x)
    return top(everything, k)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of all ``embeddings`` for each vec_id divisible by 50: (query_id, rank, vec_id, score)."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs) WHERE rank <= 5
"""
