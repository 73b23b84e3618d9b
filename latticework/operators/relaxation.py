"""Graph colouring in rounds and Gauss-Seidel relaxation by its colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it


def colouring(edges: DataFrame, nodes: DataFrame, rank: Column | None = None) -> DataFrame:
    """(id, colour): each node, in the order of ``rank`` (by default hashed numbers, then ids), has the smallest colour that no neighbour before it has.

    In rounds: nodes all of whose neighbours before them have colours, local maxima among the rest, get theirs together. That equals the one-by-one scan; with
    hashed ranks the rounds grow like the longest falling path, some multiple of the number of colours at most. A hub's neighbours meet in sets of colours, combined before the
    shuffle. Nodes without edges have colour 0.
    """
    rank = F.struct((-g.uniform(F.col("id"), 5)).alias("u"), F.col("id")) if rank is None else rank
    ranks = it.stored(nodes.select("id", rank.alias("rank")), "ranks")
    ends = g.both_ways(edges).select("i", "j").join(ranks.select(F.col("id").alias("i"), F.col("rank").alias("ri")), "i").join(ranks.select(F.col("id").alias("j"), F.col("rank").alias("rj")), "j")
    before = it.stored(ends.where("rj < ri").select("i", "j"), "before")
    state = it.stored(ranks.select("id", F.lit(None).cast("int").alias("colour")), "coloured")
    while state.where("colour is null").limit(1).count():
        open_ = state.where("colour is null").select(F.col("id").alias("i"))
        near = before.join(open_, "i", "left_semi").join(state.withColumnRenamed("id", "j"), "j")
        near = near.groupBy(F.col("i").alias("id")).agg(F.bool_or(F.col("colour").isNull()).alias("waiting"), F.collect_set("colour").alias("used"))
        used = F.coalesce("used", F.array().cast("array<int>"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), used))
        new = F.when(~F.coalesce("waiting", F.lit(False)), free)
        state = it.stored(state.join(near, "id", "left").select("id", F.coalesce("colour", new).alias("colour")), "coloured")
    return state


def gauss_seidel(edges: DataFrame, colours: DataFrame, x: DataFrame, b: DataFrame, sweeps: int = 1, symmetric: bool = False) -> DataFrame:
    """(id, x) after sweeps of Gauss-Seidel on L x = b in the order of (colour, id): nodes of one colour share no edge, so they move together.

    ``colours`` (id, colour) must be a colouring of ``edges``, or the result is another. ``symmetric``: each sweep goes back through the colours. Each colour
    joins only its own rows of the matrix, stored by colour. Nodes without edges stay as they are.
    """
    rows = g.both_ways(edges).join(colours.select(F.col("id").alias("i"), "colour"), "i")
    path = it.scratch(x.sparkSession, "by-colour")
    rows.write.partitionBy("colour").parquet(path)
    rows = x.sparkSession.read.parquet(path)
    order = [r.colour for r in rows.select("colour").distinct().orderBy("colour").collect()]  # as many as colours
    fixed = b.select("id", F.col("x").alias("b"))
    x = it.stored(x.select("id", "x"), "relaxed")
    for colour in (order + (order[-2::-1] if symmetric else [])) * sweeps:
        own = rows.where(F.col("colour") == colour)
        near = own.join(x.select(F.col("id").alias("j"), "x"), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("v") * F.col("x")).alias("wx"), F.sum("v").alias("weight"))
        new = near.join(fixed, "id").select("id", ((F.col("b") + F.col("wx")) / F.col("weight")).alias("new"))
        x = it.stored(x.join(new, "id", "left").select("id", F.coalesce("new", "x").alias("x")), "relaxed")
    return x
