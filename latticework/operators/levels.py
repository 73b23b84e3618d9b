"""Coarse levels, elimination, spectra and embeddings over levels. Dense matrices are rows (id, c, x), one for each column c."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import vectors as vec
from latticework.operators import graph as g
from latticework.operators import iterative as it


def times_columns(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(id, c, x) of the product with a dense matrix. A merge join, as estimates take a vector's many rows for those of a small table of nodes and would broadcast them."""
    return matrix.join(x.select(F.col("id").alias("j"), "c", "x").hint("merge"), "j").groupBy(F.col("i").alias("id"), "c").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def random_vectors(nodes: DataFrame, columns: int = 7) -> DataFrame:
    """(id, x): an array of reproducible numbers in [-1, 1)."""
    return nodes.select("id", F.array(*(2 * g.uniform(F.col("id"), c) - 1 for c in range(columns))).alias("x"))


def long(x: DataFrame) -> DataFrame:
    return x.select("id", F.posexplode("x").alias("c", "x"))


def wide(x: DataFrame) -> DataFrame:
    return x.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("x"))


def test_vectors(edges: DataFrame, nodes: DataFrame, columns: int = 7, steps: int = 2) -> DataFrame:
    """(id, x): random vectors less their means, smoothed."""
    x = long(random_vectors(nodes, columns))
    x = x.join(F.broadcast(x.groupBy("c").agg(F.avg("x").alias("m"))), "c").select("id", "c", (F.col("x") - F.col("m")).alias("x"))  # m: a row for each column
    smooth = it.checkpointed(g.smooth_filter(edges, nodes))
    for _ in range(steps):
        x = it.checkpointed(times_columns(smooth, x))
    return wide(x)


def on_edges(edges: DataFrame, x: DataFrame, f) -> DataFrame:
    """(i, j, v): ``f`` of both ends' vectors."""
    both = edges.join(x.select(F.col("id").alias("i"), F.col("x").alias("xi")).hint("merge"), "i").join(x.select(F.col("id").alias("j"), F.col("x").alias("xj")).hint("merge"), "j")
    return both.select("i", "j", f(F.col("xi"), F.col("xj")).alias("v"))


def affinity_matrix(edges: DataFrame, x: DataFrame) -> DataFrame:
    return on_edges(edges, x, vec.affinity)


def reweighted(edges: DataFrame, x: DataFrame, threshold: float) -> DataFrame:
    """Edges whose ends' vectors have a cosine above ``threshold``, which becomes the weight; zero vectors have none."""
    cosine = on_edges(edges, x, lambda a, b: F.try_divide(vec.dot(a, b), vec.norm(a) * vec.norm(b)))
    return cosine.where(F.col("v") > threshold).select("i", "j", F.col("v").alias("w"))


def greedy_clusters(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, cluster) of the scan by ascending rank in which each unmatched node claims its unmatched neighbours; cluster is the claiming node.

    links: (i, j), once a pair; ranks: (id, rank), no two equal. The claiming nodes are the first independent set in rank order, found in rounds.
    """
    r = it.checkpointed(ranks)
    both = links.select("i", "j").unionAll(links.select(F.col("j").alias("i"), F.col("i").alias("j")))
    ranked = both.join(r.select(F.col("id").alias("i"), F.col("rank").alias("ri")), "i").join(r.select(F.col("id").alias("j"), F.col("rank").alias("rj")), "j")
    lower = it.checkpointed(ranked.where("rj < ri").select("i", "j", "rj"))
    state = it.checkpointed(r.select("id", F.lit(None).cast("boolean").alias("seed")))
    while state.where("seed is null").limit(1).count():
        near = lower.join(state.where("seed is null").select(F.col("id").alias("i")), "i", "left_semi").join(state.withColumnRenamed("id", "j"), "j")
        near = near.groupBy(F.col("i").alias("id")).agg(F.bool_or(F.coalesce("seed", F.lit(False))).alias("claimed"), F.bool_or(F.col("seed").isNull()).alias("waiting"))
        decided = F.when(F.col("claimed"), False).when(~F.coalesce("waiting", F.lit(False)), True)
        state = it.checkpointed(state.join(near, "id", "left").select("id", F.coalesce("seed", decided).alias("seed")))
    claims = lower.join(state.where("seed").select(F.col("id").alias("j")), "j", "left_semi").groupBy(F.col("i").alias("id")).agg(F.min_by("j", "rj").alias("by"))
    return state.join(claims, "id", "left").select("id", F.when(F.col("seed"), F.col("id")).otherwise(F.col("by")).alias("cluster"))


def simple_coarsen(edges: DataFrame, nodes: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, cluster): by ascending degree, nodes claim neighbours of affinity above ``least``."""
    strong = affinity_matrix(edges, test_vectors(edges, nodes)).where(F.col("v") > least)
    ranks = nodes.join(g.degrees(edges), "id", "left").select("id", F.struct(F.coalesce("degree", F.lit(0)).alias("d"), F.col("id")).alias("rank"))
    return greedy_clusters(strong, ranks)


def coarse_edges(edges: DataFrame, assign: DataFrame) -> DataFrame:
    return g.adjacency(g.galerkin(g.laplacian(edges), assign))


def hierarchy(edges: DataFrame, nodes: DataFrame, levels: int) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """(edges, nodes, assignment to the next level) of each level, finest first; ends early at two nodes or where nothing merges."""
    out = []
    for _ in range(levels):
        before = nodes.count()
        if before <= 2:
            break
        assign = it.checkpointed(simple_coarsen(edges, nodes))
        out.append((edges, nodes, assign))
        edges, nodes = it.checkpointed(coarse_edges(edges, assign)), it.checkpointed(assign.select(F.col("cluster").alias("id")).distinct())
        if nodes.count() == before:
            break
    return out


def heaviest_edge_clusters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cluster): trees of each node's heaviest edge, ties to the smaller neighbour; cluster is the smallest node."""
    pick = g.both_ways(edges).groupBy("i").agg(F.min_by("j", F.struct(-F.col("v"), F.col("j"))).alias("j"))
    tree = pick.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(1.0).alias("w")).distinct()
    return it.connected_components(tree, nodes).withColumnRenamed("component", "cluster")


def spectral_filter(edges: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """(id, c, x): G^(k+1) x - G^k x with G = I - M / 2, M the normalised Laplacian."""
    m = it.checkpointed(g.normalised_laplacian(edges))
    before = x
    for step in range(k + 1):
        mx = times_columns(m, x).withColumnRenamed("x", "mx").hint("merge")
        before, x = x, it.checkpointed(x.join(mx, ["id", "c"], "left").select("id", "c", (F.col("x") - F.coalesce("mx", F.lit(0.0)) / 2).alias("x")))
    return x.join(before.withColumnRenamed("x", "b").hint("merge"), ["id", "c"]).select("id", "c", (F.col("x") - F.col("b")).alias("x"))


def filtered_clusters(edges: DataFrame, nodes: DataFrame, k: int = 10, columns: int = 10, threshold: float = 0.1) -> DataFrame:
    """(id, cluster): spectral filter of random vectors, edges weighted by cosine, trees of heaviest edges."""
    y = wide(spectral_filter(edges, long(random_vectors(nodes, columns)), k))
    return heaviest_edge_clusters(it.checkpointed(reweighted(edges, y, threshold)), nodes)


def elimination(edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, j, v): each eliminated node's row of -A_ff^-1 A_fc; (id, q): 1 / a_ff. ``gone`` (id) must be independent; nodes without edges are left out."""
    d = g.degrees(edges).join(gone, "id", "left_semi")
    rows = g.both_ways(edges).join(d.select(F.col("id").alias("i"), "weight"), "i").select("i", "j", (F.col("v") / F.col("weight")).alias("v"))
    return rows, d.select("id", (1 / F.col("weight")).alias("q"))


def schur_complement(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """A_cc + A_cf P of the Laplacian."""
    rows, _ = elimination(edges, gone)
    l = g.laplacian(edges)
    out_i, out_j = gone.select(F.col("id").alias("i")), gone.select(F.col("id").alias("j"))
    kept = l.join(out_i, "i", "left_anti").join(out_j, "j", "left_anti").select("i", "j", "v")
    return g.add(kept, g.multiply(l.join(out_j, "j", "left_semi").join(out_i, "i", "left_anti").select("i", "j", "v"), rows))


def refined(x: DataFrame, levels: list[tuple[DataFrame, DataFrame, DataFrame]], every: bool = False) -> DataFrame:
    """(id, c, x): the coarsest level's matrix brought to the finest; there, or at ``every`` level, it is smoothed twice."""
    for level in reversed(range(len(levels))):
        edges, nodes, assign = levels[level]
        x = assign.join(x.withColumnRenamed("id", "cluster"), "cluster").select("id", "c", "x")
        if every or level == 0:
            smooth = it.checkpointed(g.smooth_filter(edges, nodes))
            x = times_columns(smooth, it.checkpointed(times_columns(smooth, x)))
        x = it.checkpointed(x)
    return x


def embedding(edges: DataFrame, nodes: DataFrame, levels: int = 1, size: int = 128, window: int = 10, passes: int = 5, walks: int = 10, length: int = 80) -> DataFrame:
    """(id, c, x): levels, walks and skip-gram on the coarsest, refinement to all nodes."""
    from latticework.operators import walks as wk

    below = hierarchy(edges, nodes, levels)
    if below:
        e, _, assign = below[-1]
        edges, nodes = it.checkpointed(coarse_edges(e, assign)), assign.select(F.col("cluster").alias("id")).distinct()
    found = it.embed(wk.paths(edges, nodes, walks, length), size, window, passes).select("id", F.col("vector").alias("v"))
    from pyspark.ml.functions import vector_to_array

    x = found.select("id", F.posexplode(vector_to_array("v")).alias("c", "x"))
    return refined(it.checkpointed(x), below)


def scored(x: DataFrame, c: float = 1.0) -> DataFrame:
    """(train, n, accuracy) of multinomial logistic regression. x: (x array, label, train boolean); the penalty equals one of 1 / (2 c) on the summed loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = it.checkpointed(x.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), "train"))
    fit = rows.where("train")
    model = LogisticRegression(family="multinomial", regParam=1 / (c * max(fit.count(), 1)), elasticNetParam=0.0, standardization=False, maxIter=100).fit(fit)
    return model.transform(rows).groupBy("train").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def effective_resistance(edges: DataFrame, a: int, b: int, steps: int = 2000, tolerance: float = 1e-12) -> DataFrame:
    """One row: x_a - x_b where L x = e_a - e_b; both must be in one component."""
    l = it.checkpointed(g.laplacian(edges))
    ends = l.select(F.col("i").alias("id")).distinct().select("id", F.when(F.col("id") == a, 1.0).when(F.col("id") == b, -1.0).otherwise(0.0).alias("x"))
    x = it.conjugate_gradients(l, ends, steps, tolerance)
    return x.agg(F.sum(F.when(F.col("id") == a, F.col("x")).when(F.col("id") == b, -F.col("x"))).alias("resistance"))
