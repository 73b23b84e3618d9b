"""Fits of coarse energies to fine ones over test vectors: ratios, least squares a cluster, greedy least squares an edge. Vectors are (id, x array of a few columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.operators import graph as g
from latticework.operators import levels as lv


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)


def means(x: DataFrame, assign: DataFrame) -> DataFrame:
    """(id, x): cluster means of all columns."""
    return lv.wide(lv.long(x).join(assign.hint("merge"), "id").groupBy(F.col("cluster").alias("id"), "c").agg(F.avg("x").alias("x")))


def _on_edges(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(i, j, w, b): squared differences across each edge, a number a column."""
    both = edges.join(x.select(F.col("id").alias("i"), F.col("x").alias("p")).hint("merge"), "i").join(x.select(F.col("id").alias("j"), F.col("x").alias("q")).hint("merge"), "j")
    return both.select("i", "j", "w", F.zip_with("p", "q", lambda a, b: (a - b) * (a - b)).alias("b"))


def nodal(edges: DataFrame, x: DataFrame, assign: DataFrame | None = None) -> DataFrame:
    """(id, c, energy): half the sum of w (x_i - x_j)^2 over a node's edges, or over those of all nodes of a cluster; nodes without edges are left out."""
    ends = _on_edges(edges, x).select(F.explode(F.array("i", "j")).alias("id"), "w", F.posexplode("b").alias("c", "b"))
    if assign is not None:
        ends = ends.join(assign, "id").withColumn("id", F.col("cluster"))
    return ends.groupBy("id", "c").agg((F.sum(F.col("w") * F.col("b")) / 2).alias("energy"))


def _both(edges: DataFrame, x: DataFrame, assign: DataFrame) -> DataFrame:
    """(id, c, fine, coarse) of all clusters with fine edges."""
    below = nodal(lv.coarse_edges(edges, assign), means(x, assign)).withColumnRenamed("energy", "coarse")
    return nodal(edges, x, assign).withColumnRenamed("energy", "fine").join(below, ["id", "c"], "left").fillna(0.0, ["coarse"])


def adaptive(edges: DataFrame, x: DataFrame, assign: DataFrame) -> DataFrame:
    """(id, c, factor): fine by coarse energy of each cluster for each vector, the factor of its right-hand side; null where the coarse energy is 0."""
    return _both(edges, x, assign).select("id", "c", F.when(F.col("coarse") > 0, F.col("fine") / F.col("coarse")).alias("factor"))


def nodal_factors(edges: DataFrame, x: DataFrame, assign: DataFrame) -> DataFrame:
    """(id, factor): by what a cluster's coarse energies are multiplied to be nearest to its fine ones over all vectors; 1 where they are all 0."""
    fit = _both(edges, x, assign).groupBy("id").agg(F.sum(F.col("fine") * F.col("coarse")).alias("ab"), F.sum(F.col("coarse") ** 2).alias("aa"))
    return fit.select("id", F.when(F.col("aa") > 0, F.col("ab") / F.col("aa")).otherwise(1.0).alias("factor"))


def nodal_edges(edges: DataFrame, x: DataFrame, assign: DataFrame) -> DataFrame:
    """Coarse edges whose weights are multiplied by the mean of both ends' factors."""
    f = nodal_factors(edges, x, assign)
    e = lv.coarse_edges(edges, assign).join(f.select(F.col("id").alias("i"), F.col("factor").alias("fi")), "i").join(f.select(F.col("id").alias("j"), F.col("factor").alias("fj")), "j")
    return e.select("i", "j", (F.col("w") * (F.col("fi") + F.col("fj")) / 2).alias("w"))


def greedy_terms(edges: DataFrame, x: DataFrame, assign: DataFrame, terms: int = 4, good: float = 1e-9) -> DataFrame:
    """(i, j, w, lo, hi, q): each fine edge's squared differences as one or two coarse edges' (lo, hi) squared differences times q > 0.

    Candidates are the coarse edge between both ends' clusters and the ``terms`` heaviest of either, so their number doesn't grow with degrees. First comes the one that leaves
    the least squares, ties by clusters; then the one that with it leaves less still, if both get q > 0, unless the rest is below ``good`` of the whole. Edges of clusters without coarse edges have no terms.
    """
    coarse = _on_edges(lv.coarse_edges(edges, assign), means(x, assign)).select(F.col("i").alias("lo"), F.col("j").alias("hi"), "w", F.col("b").alias("a"))
    ends = coarse.select(F.explode(F.array("lo", "hi")).alias("end"), "lo", "hi", "w", "a")
    heavy = Window.partitionBy("end").orderBy(F.desc("w"), "lo", "hi")
    listed = ends.withColumn("nth", F.row_number().over(heavy)).where(F.col("nth") <= terms).select("end", "lo", "hi", "a")
    at = assign.select(F.col("id").alias("i"), F.col("cluster").alias("ci")), assign.select(F.col("id").alias("j"), F.col("cluster").alias("cj"))
    fine = _on_edges(edges, x).join(at[0], "i").join(at[1], "j")
    near = fine.withColumn("end", F.explode(F.array_distinct(F.array("ci", "cj")))).join(listed, "end")
    own = fine.withColumns({"lo": F.least("ci", "cj"), "hi": F.greatest("ci", "cj")}).join(coarse.select("lo", "hi", "a"), ["lo", "hi"])
    some = near.unionByName(own, allowMissingColumns=True).select("i", "j", "w", "b", "lo", "hi", "a", _dot("b", "b").alias("bb"), _dot("a", "b").alias("ab"), _dot("a", "a").alias("aa"))
    some = some.where("aa > 0 and ab > 0").dropDuplicates(["i", "j", "lo", "hi"])
    first = some.groupBy("i", "j").agg(F.min(F.struct((F.col("bb") - F.col("ab") * F.col("ab") / F.col("aa")).alias("rest"), "lo", "hi", "a", "ab", "aa", "bb", "w")).alias("f"))
    pair = some.join(first, ["i", "j"]).where("(lo <> f.lo or hi <> f.hi) and f.rest > {good} * bb".format(good=good))
    cross = _dot(F.col("f.a"), F.col("a"))
    pair = pair.withColumn("x", cross).withColumn("det", F.col("f.aa") * F.col("aa") - F.col("x") * F.col("x")).where(f"det > {good} * f.aa * aa")
    pair = pair.withColumns({"p": (F.col("f.ab") * F.col("aa") - F.col("ab") * F.col("x")) / F.col("det"), "q": (F.col("ab") * F.col("f.aa") - F.col("f.ab") * F.col("x")) / F.col("det")}).where("p > 0 and q > 0")
    second = pair.groupBy("i", "j").agg(F.min(F.struct((F.col("bb") - F.col("p") * F.col("f.ab") - F.col("q") * F.col("ab")).alias("rest"), "lo", "hi", "p", "q")).alias("t"))
    both = first.join(second, ["i", "j"], "left").select("i", "j", "f", F.when(F.col("t.rest") < F.col("f.rest"), F.col("t")).alias("t"))
    one = F.struct(F.col("f.lo").alias("lo"), F.col("f.hi").alias("hi"), F.coalesce("t.p", F.col("f.ab") / F.col("f.aa")).alias("q"))
    chosen = F.filter(F.array(one, F.struct(F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"), F.col("t.q").alias("q"))), lambda t: t["q"].isNotNull())
    return both.select("i", "j", F.col("f.w").alias("w"), F.inline(chosen))


def greedy_edges(edges: DataFrame, x: DataFrame, assign: DataFrame, terms: int = 4) -> DataFrame:
    """Coarse edges whose weights are the sums of w q over all fine edges' terms."""
    return greedy_terms(edges, x, assign, terms).groupBy(F.col("lo").alias("i"), F.col("hi").alias("j")).agg(F.sum(F.col("w") * F.col("q")).alias("w"))
