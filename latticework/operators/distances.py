"""Distances in hops: searches from several sources at once, diameters by bounds, and a report on how a graph hangs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it


def hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, hops) of all nodes that ``sources`` (id) reach, themselves included: one table for all searches, a round for each hop.

    A round joins the last round's nodes with their edges and leaves out what has been met: only new pairs go on, and no node's neighbours are gathered in a row.
    """
    a = it.stored(g.both_ways(edges).select("i", "j"), "hops-edges")
    front = it.stored(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops")).distinct(), "hops")
    parts, n = [front], 0
    while front.limit(1).count():
        n += 1
        new = front.select("source", F.col("id").alias("i")).join(a, "i").select("source", F.col("j").alias("id")).distinct()
        # in an undirected graph, a neighbour of the last round's nodes has been met in that round, in the one before or never
        for part in parts[-2:]:
            new = new.join(part.select("source", "id"), ["source", "id"], "left_anti")
        front = it.stored(new.select("source", "id", F.lit(n).alias("hops")), "hops")
        parts.append(front)
    out = parts[0]
    for part in parts[1:-1]:
        out = out.unionByName(part)
    return out


def eccentricity_bounds(edges: DataFrame, nodes: DataFrame, batch: int = 64, most: int = 1000) -> tuple[int, int]:
    """(diameter, radius) in hops of a connected graph over ``nodes`` (id), both exact.

    Each search from s bounds every node's eccentricity: at least its distance to s and that of s less it, at most their sum. The next ``batch`` searches start at nodes of the largest upper and
    of the smallest lower bounds; it ends when no node can be farther than the farthest or closer than the closest found. Most graphs need few searches; an error after ``most`` batches.
    """
    state = nodes.select("id").join(g.degrees(edges).select("id", "degree"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(0).alias("low"), F.lit(2**30).alias("high"))
    state = it.stored(state, "bounds")
    for _ in range(most):
        open_ = state.where("low < high")
        far = open_.orderBy(F.desc("high"), F.desc("degree"), "id").limit(batch // 2).select("id")
        near = open_.orderBy("low", F.desc("degree"), "id").limit(batch - batch // 2).select("id")
        sources = it.stored(far.union(near).distinct(), "sources")  # ``batch`` rows at most
        found = hops(edges, sources)
        own = found.groupBy("source").agg(F.max("hops").alias("e"))
        each = found.join(F.broadcast(own), "source")  # own: ``batch`` rows at most
        new = each.groupBy("id").agg(F.max(F.greatest("hops", F.col("e") - F.col("hops"))).alias("l"), F.min(F.col("e") + F.col("hops")).alias("h"), F.max(F.when(F.col("id") == F.col("source"), F.col("e"))).alias("e"))
        exact = F.col("e").isNotNull()
        state = state.join(new, "id", "left")
        state = it.stored(state.select("id", "degree", F.when(exact, F.col("e")).otherwise(F.greatest("low", "l")).alias("low"), F.when(exact, F.col("e")).otherwise(F.least("high", "h")).alias("high")), "bounds")
        low, high, least, least_high = state.agg(F.max("low"), F.max("high"), F.min("low"), F.min("high")).first()
        if low == high and least == least_high:
            return int(low or 0), int(least or 0)
    raise ArithmeticError(f"no exact diameter after {most} batches of searches")


def report(edges: DataFrame, nodes: DataFrame) -> dict[str, float | int | bool]:
    """Nodes, edges, components, is_connected, size and share of the largest component (ties: the smaller id), its diameter and radius, mean clustering coefficient and density.

    Nodes without edges have a clustering coefficient of 0. No nodes: zeros, and not connected. The second smallest eigenvalue is a matter of ``spectra``.
    """
    edges, nodes = it.stored(edges, "report-edges"), it.stored(nodes.select("id"), "report-nodes")
    n, m = nodes.count(), edges.count()
    own = it.stored(it.connected_components(edges, nodes), "report-components")
    sizes = it.stored(own.groupBy("component").agg(F.count("*").alias("size")), "report-sizes")
    largest = sizes.orderBy(F.desc("size"), "component").first()
    diameter = radius = 0
    if largest is not None and largest["size"] > 1:
        inside = it.stored(own.where(F.col("component") == largest.component).select("id"), "report-largest")
        diameter, radius = eccentricity_bounds(edges.join(inside.withColumnRenamed("id", "i"), "i", "left_semi"), inside)
    parts, clustering = sizes.count(), g.clustering_coefficients(edges).agg(F.sum("coefficient")).first()[0] or 0.0
    size = largest["size"] if largest is not None else 0
    return {
        "nodes": n, "edges": m, "components": parts, "is_connected": parts == 1, "largest": size, "share": size / n if n else 0.0, "diameter": diameter, "radius": radius,
        "clustering": clustering / n if n else 0.0, "density": 2 * m / (n * (n - 1)) if n > 1 else 0.0,
    }
