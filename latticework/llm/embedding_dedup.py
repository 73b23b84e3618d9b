"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import components, table, written
from latticework.llm.vectors import as_doubles, cosines, matrix, usable

SIDE = 1024  #: rows on each side of a compared block
SIGNS = 256  #: signs of random projections by which pairs of a bucket are sifted
AT_ONCE = 1 << 20  #: pairs that a task sifts at once


def shape(n: int) -> tuple[int, int]:
    """(tables, hashes joined in a table's key) for ``n`` vectors: longer keys for more of them, so that a bucket of unlike vectors stays
    small, and more tables, so that pairs at the least cosine keep meeting."""
    return (8, 2) if n < 1 << 18 else (20, 3) if n < 1 << 25 else (48, 4)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def bucket_keys(v: np.ndarray, tables: int = 8, hashes: int = 2, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(primary, probes) keys: one and ``1 + hashes`` for each table. A hash is the nearest signed axis after three random
    sign flips and Hadamard transforms; probes also take each hash's second nearest axis."""
    size = 1 << max(1, (v.shape[1] - 1).bit_length())
    rng = np.random.default_rng([seed, size])
    x = np.zeros((len(v), size))
    x[:, : v.shape[1]] = v / np.linalg.norm(v, axis=1, keepdims=True)
    primary = np.empty((len(v), tables), np.int64)
    probes = np.empty((len(v), tables, 1 + hashes), np.int64)
    for t in range(tables):
        firsts, seconds = [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            y = np.concatenate([y, -y], axis=1)
            two = np.argpartition(y, -2, axis=1)[:, -2:]
            values = np.take_along_axis(y, two, 1)
            flip = values[:, 0] > values[:, 1]
            firsts.append(np.where(flip, two[:, 0], two[:, 1]))
            seconds.append(np.where(flip, two[:, 1], two[:, 0]))
        for k in range(-1, hashes):
            key = np.full(len(v), t + tables * v.shape[1], np.int64)  # vectors of other lengths keep apart
            for h in range(hashes):
                key = key * (2 * size) + (seconds[h] if h == k else firsts[h])
            probes[:, t, k + 1] = key
        primary[:, t] = probes[:, t, 0]
    return primary, probes


def signs(v: np.ndarray, seed: int = 4) -> np.ndarray:
    """``SIGNS`` bits of each row as 64-bit words: the signs of random projections."""
    d = v.shape[1]
    return np.packbits(v @ np.random.default_rng([seed, d]).normal(size=(d, SIGNS)) > 0, axis=1).view(np.int64)


def most_signs(least: float) -> int:
    """Signs in which vectors of cosine ``least`` differ, and nine standard deviations more: fewer than one pair in 10**15 differs in more."""
    p = np.arccos(np.clip(least, -1, 1)) / np.pi
    return int(SIGNS * p + 9 * np.sqrt(SIGNS * p * (1 - p)) + 1)


def sifted(rows: DataFrame, least: float) -> DataFrame:
    """Of ``rows`` (id, s0, s1, ..., key, at_p, at_m, member) those that have a partner on the other side of their block whose signs are near enough. Only
    for these are vectors fetched, so unlike vectors that meet by chance move a few bytes a bucket."""
    words, limit = SIGNS // 64, most_signs(least)
    names = ["id", "key", "at_p", "at_m", "member"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(part: dict[str, np.ndarray], stops: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole blocks, ending at ``stops``; in each, probing rows come before members."""
            n = int(stops[-1])
            starts = np.r_[0, stops[:-1]]
            members = np.add.reduceat(part["member"][:n].astype(np.int64), starts)
            block = np.repeat(np.arange(len(stops)), stops - starts)
            probing = np.flatnonzero(~part["member"][:n])
            many = members[block[probing]]
            probing, many = probing[many > 0], many[many > 0]
            found = np.zeros(n, bool)
            upto = np.cumsum(many)
            at = 0
            while at < len(probing):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
                p, m = probing[at:to], many[at:to]
                left = np.repeat(p, m)
                right = np.repeat((stops - members)[block[p]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                near = part["id"][left] != part["id"][right]
                apart = np.zeros(len(left), np.int64)
                for w in range(words):
                    apart += np.bitwise_count((part[f"s{w}"][left] ^ part[f"s{w}"][right]).view(np.uint64))  # of signed numbers it would count the magnitude
                near &= apart <= limit
                found[left[near]] = True
                found[right[near]] = True
                at = to
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(part[c][:n][found]) for c in names], names)

        held: dict[str, np.ndarray] | None = None
        for b in batches:
            new = {c: b.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(b.schema.names)}
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            cuts = np.flatnonzero((held["key"][1:] != held["key"][:-1]) | (held["at_p"][1:] != held["at_p"][:-1]) | (held["at_m"][1:] != held["at_m"][:-1])) + 1
            if len(cuts):
                yield from settle(held, cuts)
                held = {c: x[cuts[-1] :] for c, x in held.items()}
        if held is not None and len(held["id"]):
            yield from settle(held, np.array([len(held["id"])]))

    columns = ["id", *(f"s{w}" for w in range(words)), "key", "at_p", "at_m", "member"]
    parted = rows.select(*columns).repartition("key", "at_p", "at_m").sortWithinPartitions("key", "at_p", "at_m", "member")
    return parted.mapInArrow(run, "id long, key long, at_p int, at_m int, member boolean")


def linked_blocks(rows: DataFrame, least: float, tables: int) -> DataFrame:
    """For each block of a bucket, (id, other, links): how many copies of others are linked to ``id`` and found here first, or with links 0 an edge.

    A pair can meet in several buckets; it counts where it meets first in the order of tables, and of who probed whom.
    An edge joins ``id`` to the least row of its connected part of the block: at most one for each row.
    """

    def compare(p: dict, m: dict) -> tuple[np.ndarray, np.ndarray]:
        pv, mv = matrix(p["v"]), matrix(m["v"])
        if pv.shape[1] != mv.shape[1]:
            return np.zeros(0, int), np.zeros(0, int)
        near = (pv / np.linalg.norm(pv, axis=1, keepdims=True)) @ (mv / np.linalg.norm(mv, axis=1, keepdims=True)).T >= least - 1e-9
        i, j = np.nonzero(near & (p["id"][:, None] != m["id"][None, :]))
        exact = cosines(pv[i], mv[j]) >= least
        return i[exact], j[exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(block: pa.Table) -> Iterator[pa.RecordBatch]:
            member = block.column("member").to_numpy(zero_copy_only=False)
            side = []
            for pick in (~member, member):
                part = block.filter(pa.array(pick)).combine_chunks()
                side.append({"id": part.column("id").to_numpy(), "n": part.column("n").to_numpy(), **{c: part.column(c).combine_chunks() for c in ("v", "primary", "probes")}})
            p, m = side
            if not len(p["id"]) or not len(m["id"]):
                return
            i, j = compare(p, m)
            if not len(i):
                return
            here = int(block.column("table")[0].as_py())
            pp, pq, mp, mq = (matrix(s[c]) for s in (p, m) for c in ("primary", "probes"))
            asked = (pq.reshape(len(pq), tables, -1)[i] == mp[j][:, :, None]).any(2)
            asks = (mq.reshape(len(mq), tables, -1)[j] == pp[i][:, :, None]).any(2)
            p_first = p["id"][i] < m["id"][j]  # of the two ways in one table, that of the smaller id's probing comes first
            met = np.where(p_first[:, None, None], np.stack([asked, asks], 2), np.stack([asks, asked], 2)).reshape(len(i), -1)
            new = met.argmax(1) == 2 * here + np.where(p_first, 0, 1)
            i, j = i[new], j[new]
            if not len(i):
                return
            ids = np.concatenate([p["id"][i], m["id"][j]])
            n = np.concatenate([m["n"][j], p["n"][i]])
            own, back = np.unique(ids, return_inverse=True)
            a, b = back[: len(i)], back[len(i) :]
            label = np.arange(len(own))
            while True:  # least label of each connected part
                low = label.copy()
                np.minimum.at(low, a, label[b])
                np.minimum.at(low, b, label[a])
                low = low[low]
                if (low == label).all():
                    break
                label = low
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own[label]), pa.array(np.bincount(back, n).astype(np.int64))], ["id", "other", "links"])

        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            keys = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in ("key", "at_p", "at_m")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    if held and last != tuple(keys[s]):
                        yield from settle(pa.Table.from_batches(held))
                        held = []
                    last = tuple(keys[s])
                    held.append(b.slice(s, e - s))
        if held:
            yield from settle(pa.Table.from_batches(held))

    parted = rows.repartition("key", "at_p", "at_m").sortWithinPartitions("key", "at_p", "at_m")
    return parted.mapInArrow(run, "id long, other long, links long")


def near_duplicates(vectors: DataFrame, least: float = 0.95, of_shape: tuple[int, int] | None = None) -> DataFrame:
    """Links vectors with cosine ``least`` or more: vec_id, n_links, component_id, kept, one row for each row of ``vectors``.

    vectors: vec_id, embedding; further columns are ignored. Null and zero vectors and those with null or non-finite components link with
    nothing and are their own component. Equal vectors become one row before hashing and count as linked to each other; vectors of
    different lengths don't link. Rows must not share a vec_id unless they are repeats. An empty table gives an empty result.

    Each distinct vector stands in one bucket of each table and probes ``1 + hashes``; keys grow with the number of vectors (``shape``). In
    blocks of about ``SIDE`` by ``SIDE`` rows of a bucket, pairs are first sifted by signs; rows left with a partner get their vectors and
    are compared exactly. Counts and one edge for each row leave a block, never its pairs.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = usable(all_rows)
    distinct = written(fine.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "polytope-distinct")
    tables, hashes = of_shape or shape(distinct.count())
    words = [f"s{w}" for w in range(SIGNS // 64)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(3).to_numpy()
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                v = matrix(part.column(2))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1) * k[0].size, pa.int32()), pa.array(k.ravel())) for k in bucket_keys(v, tables, hashes)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists, *(pa.array(w) for w in signs(v).T.copy())], ["id", "n", "v", "primary", "probes", *words])

    marked = distinct.select("id", "n", as_doubles().alias("v"), F.size("embedding").alias("d"))
    marked = written(marked.mapInArrow(hashed, "id long, n long, v array<double>, primary array<long>, probes array<long>, " + ", ".join(f"{w} long" for w in words)), "polytope")
    names = written(fine.join(distinct, "embedding").select("vec_id", "id", "n"), "polytope-ids")
    placed = marked.select("id", *words, F.explode("primary").alias("key"), F.lit(True).alias("member")).unionAll(marked.select("id", *words, F.explode("probes").alias("key"), F.lit(False).alias("member")))
    sizes = placed.groupBy("key").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("p")).where("m > 0 and p > 1")
    sizes = written(sizes.select("key", F.ceil(F.col("m") / SIDE).cast("int").alias("m"), F.ceil(F.col("p") / SIDE).cast("int").alias("p")), "polytope-buckets")
    # a member stands in one column of blocks and in all rows, a probing row the other way round
    own = F.pmod(F.xxhash64("id"), F.when(F.col("member"), F.col("m")).otherwise(F.col("p"))).cast("int")
    dealt = placed.join(sizes, "key").withColumn("own", own).withColumn("all", F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("p")).otherwise(F.col("m")) - 1)))
    dealt = dealt.withColumns({"at_p": F.when(F.col("member"), F.col("all")).otherwise(F.col("own")), "at_m": F.when(F.col("member"), F.col("own")).otherwise(F.col("all"))})
    near = written(sifted(dealt, least), "polytope-sifted")
    table_of = F.floor(F.array_position("primary", F.col("key")) - 1)
    probe_of = F.floor((F.array_position("probes", F.col("key")) - 1) / (1 + hashes))
    pairs = near.join(marked.drop(*words), "id").withColumn("table", F.when(F.col("member"), table_of).otherwise(probe_of).cast("int"))
    links = written(linked_blocks(pairs, least, tables), "polytope-links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(links.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")), "polytope-cc").withColumnRenamed("id", "node")
    per = marked.select("id").join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    named = names.join(written(per, "polytope-named"), "id").select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), F.col("root").alias("component_id"))
    alone = all_rows.join(names.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more between all ``embeddings``: (vec_id, n_links, component_id, kept)."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least m ON m.a = e.vec_id
"""
