"""Iterative graph operators: each round is a join and an aggregation, its result written to the shared folder or checkpointed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from itertools import cycle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from latticework.operators.graph import both_ways, degrees, times_vector


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a single process where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='latticework-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of the shared folder. Unlike a checkpoint, it doesn't hand on constraints that grow from round to round."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def turns(spark: SparkSession, label: str, paths: int) -> Callable[[DataFrame], DataFrame]:
    """As ``stored``, for the tables of successive steps: they go to ``paths`` paths in turn, each in the place of the one that many steps before, so that what lies there doesn't grow with the steps. A step's
    shuffles go when it is written; by themselves they stay until the driver's JVM happens to collect what names them."""
    at, cleanup = cycle([scratch(spark, label) for _ in range(paths)]), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def write(df: DataFrame) -> DataFrame:
        path, before = next(at), spark.conf.get(cleanup, "false")
        spark.conf.set(cleanup, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            spark.conf.set(cleanup, before)
        return spark.read.schema(df.schema).parquet(path)

    return write


def numbered(ids: DataFrame) -> DataFrame:
    """(id, number): running numbers of distinct ids in their order, by ranges: a count for each range, then places within it."""
    parts = checkpointed(ids.repartitionByRange("id").select("id", F.spark_partition_id().alias("part")))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return parts.withColumn("place", place).join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("place")).alias("number"))


def connected_components(edges: DataFrame, nodes: DataFrame, salts: int = 8) -> DataFrame:
    """(id, component), component the smallest node id.

    Only edges are iterated: a large-star step, then a small-star step, both over (node, smaller node) pairs, until they don't change. The
    least neighbour of a node goes to ``salts`` tasks, so that a hub's edges don't land in one. Nodes without edges are their own component.
    """
    pair = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(e: DataFrame, large: bool) -> DataFrame:
        ends = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        ends = ends.unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else ends
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        each = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        moved = ends.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(each, ["u", "salt"]).where("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return pair(moved if large else moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))

    now, before = checkpointed(pair(edges.select(F.col("i").alias("a"), F.col("j").alias("b")))), None
    while True:
        now = checkpointed(star(star(now, True), False))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    return nodes.join(now.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def contracted_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) as by ``connected_components``, for graphs of many more edges than nodes: the components of each node's least neighbour, an edge a node, then those of the
    edges between them, so that all edges are read twice instead of in each round."""
    forest = edges.select("i", "j").unionAll(edges.select("j", "i")).groupBy("i").agg(F.min("j").alias("j"))
    own = stored(connected_components(forest, nodes), "forest")
    i, j = own.select(F.col("id").alias("i"), F.col("component").alias("a")), own.select(F.col("id").alias("j"), F.col("component").alias("b"))
    between = edges.join(i, "i").join(j, "j").where("a <> b").select(F.col("a").alias("i"), F.col("b").alias("j")).distinct()
    to = connected_components(stored(between, "between"), own.select(F.col("component").alias("id")).distinct()).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return own.join(to, "component").select("id", F.col("to").alias("component"))


def independent_set(edges: DataFrame, nodes: DataFrame, most: int = 4) -> DataFrame:
    """Nodes of degree ``most`` or less, scanned by ascending id and taken unless a neighbour is: in rounds, those whose smaller
    open neighbours are all decided. The result equals the scan's."""
    d = degrees(edges).select("id", "degree")
    open_ = checkpointed(nodes.select("id").join(d, "id", "left").where(F.coalesce("degree", F.lit(0)) <= most).select("id"))
    a = both_ways(edges).select("i", "j")
    a = checkpointed(a.join(open_.withColumnRenamed("id", "i"), "i", "left_semi").join(open_.withColumnRenamed("id", "j"), "j", "left_semi"))
    taken = None
    while open_.limit(1).count():
        live = a.join(open_.withColumnRenamed("id", "i"), "i", "left_semi").join(open_.withColumnRenamed("id", "j"), "j", "left_semi")
        new = checkpointed(open_.join(live.where("j < i").select(F.col("i").alias("id")).distinct(), "id", "left_anti"))
        out = new.unionAll(a.join(new.withColumnRenamed("id", "i"), "i", "left_semi").select(F.col("j").alias("id")))
        open_ = checkpointed(open_.join(out, "id", "left_anti"))
        taken = new if taken is None else checkpointed(taken.unionAll(new))
    return taken if taken is not None else open_


def conjugate_gradients(matrix: DataFrame, b: DataFrame, steps: int = 2000, tolerance: float = 1e-10) -> DataFrame:
    """(id, x) with matrix x = b for a symmetric positive semi-definite matrix and b in its range.

    Ends when the residual is ``tolerance`` times that of x = 0 or less; an error where ``steps`` don't reach it.
    """
    dot = lambda df: df.agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0.0
    state = checkpointed(b.select("id", F.lit(0.0).alias("x"), F.col("x").alias("r"), F.col("x").alias("p")))
    rr = first = dot(state.select(F.col("r").alias("p"), F.col("r").alias("q")))
    done = 0
    while rr > tolerance * tolerance * first:
        if done == steps:
            raise ArithmeticError(f"relative residual {(rr / first) ** 0.5:.1e} after {steps} steps, above {tolerance:.1e}")
        done += 1
        q = times_vector(matrix, state.select("id", F.col("p").alias("x"))).withColumnRenamed("x", "q")
        state = checkpointed(state.join(q, "id", "left").withColumn("q", F.coalesce("q", F.lit(0.0))))
        alpha = rr / dot(state)
        state = state.select("id", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
        after = dot(state.select(F.col("r").alias("p"), F.col("r").alias("q")))
        state = state.withColumn("p", F.col("r") + after / rr * F.col("p"))
        rr = after
    return state.select("id", "x")


def embed(walks: DataFrame, size: int = 128, window: int = 10, passes: int = 5, seed: int = 1, partitions: int = 4) -> DataFrame:
    """(id, vector) by skip-gram over walks (path), ``passes`` times; each of ``partitions`` trains on its walks and vectors are averaged after each pass."""
    from pyspark.ml.feature import Word2Vec

    paths = walks.select(F.transform("path", lambda n: n.cast("string")).alias("path"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, maxIter=passes, numPartitions=partitions, seed=seed, inputCol="path", outputCol="v").fit(paths)
    return model.getVectors().select(F.col("word").cast("long").alias("id"), "vector")
