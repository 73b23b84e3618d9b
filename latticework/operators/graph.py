"""Graphs and sparse matrices as tables: edges(i, j, w) with i < j, matrices(i, j, v), assignments(id, cluster), vectors(id, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def both_ways(edges: DataFrame) -> DataFrame:
    """Symmetric adjacency matrix of undirected edges."""
    return edges.select("i", "j", F.col("w").alias("v")).unionAll(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v")))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, weight) of nodes with edges."""
    return both_ways(edges).groupBy(F.col("i").alias("id")).agg(F.count("*").alias("degree"), F.sum("v").alias("weight"))


def laplacian(edges: DataFrame) -> DataFrame:
    """D - A, without zero rows."""
    a = both_ways(edges)
    return a.groupBy("i").agg(F.sum("v").alias("v")).select("i", F.col("i").alias("j"), "v").unionAll(a.select("i", "j", (-F.col("v")).alias("v")))


def adjacency(matrix: DataFrame) -> DataFrame:
    """Edges of a Laplacian: negative entries above the diagonal."""
    return matrix.where("i < j and v < 0").select("i", "j", (-F.col("v")).alias("w"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def elementwise_max(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.max("v").alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse matrix product: an equi-join on the inner index and a sum that is combined before the shuffle."""
    return a.alias("a").join(b.alias("b"), F.col("a.j") == F.col("b.i")).groupBy(F.col("a.i").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))


def times_vector(a: DataFrame, x: DataFrame) -> DataFrame:
    """(id, x) of the product; rows without entries are left out."""
    return a.join(x.select(F.col("id").alias("j"), "x"), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def galerkin(matrix: DataFrame, assign: DataFrame) -> DataFrame:
    """P' A P for a node-to-cluster assignment."""
    rows = assign.select(F.col("id").alias("i"), F.col("cluster").alias("ci"))
    columns = assign.select(F.col("id").alias("j"), F.col("cluster").alias("cj"))
    return matrix.join(rows, "i").join(columns, "j").groupBy(F.col("ci").alias("i"), F.col("cj").alias("j")).agg(F.sum("v").alias("v"))


def compose(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Assignment of fine nodes to the clusters of their clusters."""
    return fine.join(coarse.select(F.col("id").alias("cluster"), F.col("cluster").alias("to")), "cluster").select("id", F.col("to").alias("cluster"))


def normalised_laplacian(edges: DataFrame) -> DataFrame:
    """(d + 1e-12)^-1/2 (D - A) (d + 1e-12)^-1/2."""
    scale = degrees(edges).select("id", (1 / F.sqrt(F.col("weight") + 1e-12)).alias("s"))
    return scaled(laplacian(edges), scale)


def scaled(matrix: DataFrame, scale: DataFrame) -> DataFrame:
    left, right = scale.select(F.col("id").alias("i"), F.col("s").alias("si")), scale.select(F.col("id").alias("j"), F.col("s").alias("sj"))
    return matrix.join(left, "i").join(right, "j").select("i", "j", (F.col("v") * F.col("si") * F.col("sj")).alias("v"))


def smooth_filter(edges: DataFrame, nodes: DataFrame, damping: float = 0.1) -> DataFrame:
    """D^-1/2 (A + damping I) D^-1/2 with D the row sums of the middle."""
    a = both_ways(edges).unionAll(nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(damping).alias("v")))
    return scaled(a, a.groupBy(F.col("i").alias("id")).agg((1 / F.sqrt(F.sum("v"))).alias("s")))


def strong(edges: DataFrame, share: float = 0.1) -> DataFrame:
    """Edges whose weight is at least ``share`` of the lesser of both ends' largest weights."""
    top = both_ways(edges).groupBy("i").agg(F.max(F.abs("v")).alias("b"))
    e = edges.join(top.withColumnRenamed("b", "bi"), "i").join(top.select(F.col("i").alias("j"), F.col("b").alias("bj")), "j")
    return e.where(F.abs("w") >= share * F.least("bi", "bj")).select("i", "j", "w")


def large_entries(edges: DataFrame, share: float) -> DataFrame:
    """Edges whose weight is at least ``share`` of the greater of both ends' largest weights."""
    top = both_ways(edges).groupBy("i").agg(F.max(F.abs("v")).alias("b"))
    e = edges.join(top.withColumnRenamed("b", "bi"), "i").join(top.select(F.col("i").alias("j"), F.col("b").alias("bj")), "j")
    return e.where(F.abs("w") >= share * F.greatest("bi", "bj")).select("i", "j", "w")


def as_laplacian(matrix: DataFrame) -> DataFrame:
    """The Laplacian of a symmetric matrix: with a non-zero diagonal it counts as a pattern of weight 1, without one by absolute values."""
    flag = matrix.agg((F.count_if((F.col("i") == F.col("j")) & (F.col("v") != 0)) > 0).alias("diagonal"))
    w = matrix.where("i <> j").join(F.broadcast(flag)).select("i", "j", F.when(F.col("diagonal"), 1.0).otherwise(F.abs("v")).alias("v"))  # flag: one row
    return w.groupBy("i").agg(F.sum("v").alias("v")).select("i", F.col("i").alias("j"), "v").unionAll(w.select("i", "j", (-F.col("v")).alias("v")))


def second_neighbours(edges: DataFrame) -> DataFrame:
    """Distinct ordered pairs at distance two by way of some node."""
    a = both_ways(edges).select("i", "j")
    return a.alias("a").join(a.alias("b"), F.col("a.j") == F.col("b.i")).where("a.i <> b.j").select(F.col("a.i").alias("i"), F.col("b.j").alias("j")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once, its nodes by ascending degree. Edges point to the end of higher degree, so that no node starts more than the
    square root of twice the number of edges, hubs included."""
    d = degrees(edges).select("id", "degree")
    e = edges.join(d.select(F.col("id").alias("i"), F.col("degree").alias("di")), "i").join(d.select(F.col("id").alias("j"), F.col("degree").alias("dj")), "j")
    up = (F.col("di") < F.col("dj")) | ((F.col("di") == F.col("dj")) & (F.col("i") < F.col("j")))
    e = e.select(F.when(up, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(up, F.col("j")).otherwise(F.col("i")).alias("b"), F.when(up, F.col("dj")).otherwise(F.col("di")).alias("degree"))
    wedge = e.alias("x").join(e.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.struct("x.degree", "x.b") < F.struct("y.degree", "y.b"))).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    return wedge.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).select("a", "b", "c")


def clustering_coefficients(edges: DataFrame) -> DataFrame:
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    d = degrees(edges)
    return d.join(t, "id", "left").select("id", F.when(F.col("degree") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("coefficient"))


def conductance(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(cluster, cut, volume, phi), unweighted; phi is null where it is not finite."""
    a = both_ways(edges).join(assign.select(F.col("id").alias("i"), F.col("cluster").alias("ci")), "i").join(assign.select(F.col("id").alias("j"), F.col("cluster").alias("cj")), "j")
    per = a.groupBy(F.col("ci").alias("cluster")).agg(F.count_if(F.col("ci") != F.col("cj")).alias("cut"), F.count("*").alias("volume"))
    total = edges.agg((2 * F.count("*")).alias("total"))
    least = F.least("volume", F.col("total") - F.col("volume"))
    return per.crossJoin(F.broadcast(total)).select("cluster", "cut", "volume", F.when(least > 0, F.col("cut") / least).alias("phi"))  # total: one row


def pooled(x: DataFrame, assign: DataFrame) -> DataFrame:
    """(cluster, size, total, mean) of a vector."""
    return x.join(assign, "id").groupBy("cluster").agg(F.count("*").alias("size"), F.sum("x").alias("total"), F.avg("x").alias("mean"))


def unpool(coarse: DataFrame, assign: DataFrame, how: str = "copy", degree: DataFrame | None = None) -> DataFrame:
    """Cluster values back to nodes: to all ("copy", and "mean", which is the same for one-hot assignments), to the "first" or the "central" node of each; others get 0."""
    values = assign.join(coarse.select(F.col("id").alias("cluster"), "x"), "cluster")
    if how in ("copy", "mean"):
        return values.select("id", "x")
    if how == "first":
        chosen = assign.groupBy("cluster").agg(F.min("id").alias("chosen"))
    elif how == "central":
        d = assign.join(degree, "id", "left").select("id", "cluster", F.coalesce("degree", F.lit(0)).alias("degree"))
        chosen = d.groupBy("cluster").agg(F.min_by("id", F.struct(-F.col("degree"), F.col("id"))).alias("chosen"))
    else:
        raise ValueError(f"unknown way to unpool: {how}")
    return values.join(chosen, "cluster").select("id", F.when(F.col("id") == F.col("chosen"), F.col("x")).otherwise(0.0).alias("x"))


def jacobi_step(edges: DataFrame, x: DataFrame, b: DataFrame, damping: float = 2 / 3) -> DataFrame:
    """(1 - w) x + w D^-1 (b + W x) for the Laplacian of ``edges``; nodes without edges stay as they are."""
    wx = times_vector(both_ways(edges), x).withColumnRenamed("x", "wx")
    d = degrees(edges).select("id", "weight")
    return x.join(b.withColumnRenamed("x", "b"), "id").join(d, "id", "left").join(wx, "id", "left").select("id", F.when(F.col("weight").isNull(), F.col("x")).otherwise((1 - damping) * F.col("x") + damping * (F.col("b") + F.col("wx")) / F.col("weight")).alias("x"))


def nodal_energy(edges: DataFrame, x: DataFrame) -> DataFrame:
    """x (L x) - L (x x) / 2 at each node of ``edges``: half of the sum of w (x_i - x_j)^2."""
    l = laplacian(edges)
    lx, lxx = times_vector(l, x).withColumnRenamed("x", "lx"), times_vector(l, x.select("id", (F.col("x") * F.col("x")).alias("x"))).withColumnRenamed("x", "lxx")
    return x.join(lx, "id").join(lxx, "id").select("id", (F.col("x") * F.col("lx") - F.col("lxx") / 2).alias("energy"))


def node2vec_transitions(edges: DataFrame, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """(previous, current, next, probability) of second-order walks."""
    a = both_ways(edges)
    step = a.select(F.col("i").alias("previous"), F.col("j").alias("current")).join(a.select(F.col("i").alias("current"), F.col("j").alias("next"), "v"), "current")
    common = a.select(F.col("i").alias("previous"), F.col("j").alias("next"), F.lit(True).alias("common"))
    weight = F.when(F.col("next") == F.col("previous"), F.col("v") / p).when(F.col("common"), F.col("v")).otherwise(F.col("v") / q)
    w = Window.partitionBy("previous", "current")
    return step.join(common, ["previous", "next"], "left").select("previous", "current", "next", weight.alias("w")).select("previous", "current", "next", (F.col("w") / F.sum("w").over(w)).alias("probability"))


def uniform(id_: Column, c: int | Column) -> Column:
    """Reproducible numbers in [0, 1) by node and column (a whole number, as a column a long), the same in any SQL engine. Ids are taken modulo p first, as their products with the factor would leave 64 bits."""
    p = 2147483647
    z1 = (id_ % p * 1103515245 + (c + 1) * 620899117 + 7) % p
    z2 = (z1 * z1 + c + 1) % p
    return ((z2 * z2 + id_) % p) / F.lit(float(p))


def sampled_neighbours(edges: DataFrame, width: int) -> DataFrame:
    """(id, slot, neighbour): ``width`` neighbours of each node, the first in hashed order; nodes with fewer repeat them."""
    order = Window.partitionBy("i").orderBy(uniform(F.col("i") * 7919 + F.col("j"), 0), "j")
    ranked = both_ways(edges).select("i", "j", (F.row_number().over(order) - 1).alias("r"), F.count("*").over(Window.partitionBy("i")).alias("n"))
    return ranked.where(F.col("r") < width).select(F.col("i").alias("id"), F.col("j").alias("neighbour"), F.explode(F.sequence(F.col("r").cast("long"), F.lit(width - 1).cast("long"), F.least("n", F.lit(width)))).alias("slot")).select("id", "slot", "neighbour")
