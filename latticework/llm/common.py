"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: everything between ASCII white space.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='latticework-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a merge join, never broadcast: neither the size of its files, compressed or made into more rows by a task's function, nor that of its shuffle tells what it takes in the driver."""
    return df.hint("merge")


def clear(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each of ``names``; upper and lower case count as equal."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """``rows`` with the other columns of ``groups``, which has one row for each of some keys and in ``size`` how many of all ``total`` rows have it; null for the rest.

    Keys with a thousandth of the rows or more, a thousand keys at most, are broadcast. Their rows then go to the join with the others by ``spread``, a
    column that tells rows apart, so that no hot key lands in one task.
    """
    facts = [c for c in groups.columns if c != key]
    renamed = groups.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in facts))
    is_hot = F.col(f"_{size}") * 1000 >= F.lit(total)
    hot = renamed.where(is_hot).select(F.col("_key").alias("_hot"), F.struct(*(f"_{c}" for c in facts)).alias("_facts"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    met = met.withColumn("_to", F.when(F.col("_hot").isNull(), F.xxhash64(key)).otherwise(spread)).withColumn("_cold", F.when(F.col("_hot").isNull(), F.col(key)))
    cold = renamed.where(~is_hot).withColumn("_at", F.xxhash64("_key"))
    met = met.join(cold, (F.col("_to") == F.col("_at")) & (F.col("_cold") == F.col("_key")), "left")
    return met.select(*rows.columns, *(F.coalesce(f"_facts._{c}", f"_{c}").alias(c) for c in facts))


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts can be long: fewer of them in each Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_in_use: list = [None]


def only(cache) -> None:
    """``cache`` is in use from now on. A task's Python process runs tasks of later stages too, so it drops the one that it used before."""
    if _in_use[0] is not cache:
        if _in_use[0] is not None:
            _in_use[0].clear()
        _in_use[0] = cache


class WordHash(dict):
    """word -> 64-bit hash, remembered for up to ``most`` words until another cache is in use."""

    def __init__(self, seed: int = 0, most: int = 100_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        only(self)
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Rolling:
    """Hashes of every run of ``k`` consecutive items, polynomial modulo 2**64 over strong item hashes."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(self.size, self.base, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(self.size, self.inverse, np.uint64)]), dtype=np.uint64)

    def prefix(self, items: np.ndarray) -> np.ndarray:
        self._grow(len(items) + 1)
        out = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * self.up[: len(items)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, k: int) -> np.ndarray:
        return mixed((prefix[k:] - prefix[:-k]) * self.down[: len(prefix) - k])


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of ``h`` over the word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    done = 1
    while 2 * done <= w:
        a, done = np.minimum(a[:-done], a[done:]), 2 * done
    return np.minimum(a[: len(a) - (w - done)], a[w - done :]) if w > done else a


def stars(edges: DataFrame) -> bool:
    """Has each node of ``edges(a, b)``, a > b and no two alike, either one edge to a smaller node, or none? Then the smaller ones are the components' roots."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, label: str, salts: int = 8) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: returns (id, root), root the smallest id of the component.

    Alternates large-star and small-star steps; each step's edges are written to the shared folder, and a
    node's edges are dealt over ``salts`` tasks, so that no hub lands in one; its least neighbour goes to those tasks that have some, so a node of one edge is one row. Ends when all edges form stars, which one aggregation
    tells: no further step has to confirm it. Loops and repeats do no harm; no edges give no rows.
    """
    pair = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        salted = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        here = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))  # up to ``salts`` rows a node
        least = here.select("u", "salt", F.least(F.min("m").over(Window.partitionBy("u")), F.col("u")).alias("m"))
        out = salted.join(merged(least), ["u", "salt"]).where("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out if large else out.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    now = written(pair(edges), label)
    while not stars(now):
        now = written(pair(step(pair(step(now, True)), False)), label)
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
