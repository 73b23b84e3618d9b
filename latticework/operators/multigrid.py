"""Corrections of coarse energies, restricted eigenspaces and clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators import levels as lv


def column_energies(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(c, energy): sum of w (x_i - x_j)^2 of each column of (id, c, x)."""
    both = edges.join(x.select(F.col("id").alias("i"), "c", F.col("x").alias("xi")).hint("merge"), "i").join(x.select(F.col("id").alias("j"), "c", F.col("x").alias("xj")).hint("merge"), ["j", "c"])
    return both.groupBy("c").agg(F.sum(F.col("w") * (F.col("xi") - F.col("xj")) ** 2).alias("energy"))


def energy_factor(edges: DataFrame, assign: DataFrame, x: DataFrame) -> DataFrame:
    """One row (factor): the mean, over columns of (id, c, x), of the energy of cluster means on the coarse graph by that of x."""
    coarse = x.join(assign.hint("merge"), "id").groupBy(F.col("cluster").alias("id"), "c").agg(F.avg("x").alias("x"))
    fine = column_energies(edges, x).join(column_energies(lv.coarse_edges(edges, assign), coarse).withColumnRenamed("energy", "below"), "c")
    return fine.where("energy > 0").agg(F.avg(F.col("below") / F.col("energy")).alias("factor"))


def coarse_rhs(b: DataFrame, assign: DataFrame, factor: float = 4 / 3) -> DataFrame:
    """(id, x): right-hand side of the clusters, times a flat correction of energy."""
    return b.join(assign, "id").groupBy(F.col("cluster").alias("id")).agg((F.sum("x") * factor).alias("x"))


def scaled(matrix: DataFrame, factor: float) -> DataFrame:
    """A coarse matrix with a constant correction of energy."""
    return matrix.select("i", "j", (F.col("v") * factor).alias("v"))


def restricted_eigenspace(matrix: DataFrame, y: DataFrame, columns: int) -> np.ndarray:
    """Ascending eigenvalues of a symmetric matrix restricted to the span of the ``columns`` of (id, x array).

    Both products with the columns are summed in the cluster; only their entries, ``columns`` squared, reach the driver. Dependent columns are an error.
    """
    my = lv.times_columns(matrix, lv.long(y)).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("m"))
    both = y.join(my, "id", "left")
    pairs = [(p, q) for p in range(columns) for q in range(columns)]
    row = both.agg(*(F.sum(F.col("x")[p] * F.col("x")[q]) for p, q in pairs), *(F.sum(F.col("x")[p] * F.coalesce(F.col("m")[q], F.lit(0.0))) for p, q in pairs)).first()
    gram, inner = (np.array(row[k * columns**2 : (k + 1) * columns**2]).reshape(columns, columns) for k in (0, 1))
    half = np.linalg.inv(np.linalg.cholesky(gram))
    return np.linalg.eigvalsh(half @ ((inner + inner.T) / 2) @ half.T)


def kmeans(x: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(id, cluster) of k-means over (id, x array)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = it.checkpointed(x.select("id", array_to_vector("x").alias("features")))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))
