"""Queries over coarse levels, elimination, spectra and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators import levels as lv
from latticework.operators import sage
from latticework.operators import spectra as sp
from latticework.operators import walks as wk
from latticework.plans.common import Queries, r6
from latticework.plans.features import V_SQL, feature_graph, vectors
from latticework.plans.graphs import REACH, RECURSIVE, WITH, assign, edges, nodes, signal, u_sql
from latticework.sources import graphs as src

QUERIES = Queries()
add = QUERIES.add

TV = f"tv AS (SELECT id, [{', '.join(f'2 * {u_sql('id', c)} - 1' for c in range(7))}] AS x FROM n)"
GONE = "f AS (SELECT i AS id FROM a GROUP BY 1 HAVING i < min(j)), p AS (SELECT i, j, v / weight AS v FROM a JOIN d ON d.id = i WHERE i IN (SELECT id FROM f))"
SMOOTH = "m AS (SELECT * FROM a UNION ALL SELECT id, id, 0.1 FROM n), t AS (SELECT i AS id, sum(v) AS w FROM m GROUP BY 1), fl AS (SELECT i, j, v / (sqrt(p.w) * sqrt(q.w)) AS v FROM m JOIN t p ON p.id = i JOIN t q ON q.id = j)"


def gone(s, d):
    """Nodes smaller than all their neighbours: independent."""
    return g.both_ways(edges(s, d)).groupBy(F.col("i").alias("id")).agg(F.min("j").alias("j")).where("id < j").select("id")


@add("affinity_matrix", f"{WITH}, {TV} SELECT i, j, round(list_inner_product(p.x, q.x) ** 2 / (list_inner_product(p.x, p.x) * list_inner_product(q.x, q.x)), 6) AS v FROM e JOIN tv p ON p.id = i JOIN tv q ON q.id = j")
def _(s, d):
    return lv.affinity_matrix(edges(s, d), lv.random_vectors(nodes(s, d))).select("i", "j", r6("v").alias("v"))


@add("reweight_edges", f"{WITH}, {TV}, k AS (SELECT i, j, list_cosine_similarity(p.x, q.x) AS w FROM e JOIN tv p ON p.id = i JOIN tv q ON q.id = j) SELECT i, j, round(w, 6) AS w FROM k WHERE w > 0.1")
def _(s, d):
    return lv.reweighted(edges(s, d), lv.random_vectors(nodes(s, d)), 0.1).select("i", "j", r6("w").alias("w"))


@add("spectral_filter", f"""{WITH}, m AS (SELECT i, j, v / (sqrt(p.weight + 1e-12) * sqrt(q.weight + 1e-12)) AS v FROM l JOIN d p ON p.id = i JOIN d q ON q.id = j),
g1 AS (SELECT x.id, x.x - coalesce(t.t, 0) / 2 AS x FROM x LEFT JOIN (SELECT i AS id, sum(v * x) AS t FROM m JOIN x ON x.id = j GROUP BY 1) t USING (id)),
g2 AS (SELECT g1.id, g1.x - coalesce(t.t, 0) / 2 AS x FROM g1 LEFT JOIN (SELECT i AS id, sum(v * x) AS t FROM m JOIN g1 ON g1.id = j GROUP BY 1) t USING (id))
SELECT id, round(g2.x - g1.x, 6) + 0.0 AS x FROM g1 JOIN g2 USING (id)""")
def _(s, d):
    return lv.spectral_filter(edges(s, d), signal(s, d).withColumn("c", F.lit(0)), 1).select("id", r6("x").alias("x"))


@add("cmg_cluster", f"""{RECURSIVE}, h AS (SELECT i, arg_min(j, (-v, j)) AS j FROM a GROUP BY 1), hh AS (SELECT i, j FROM h UNION SELECT j, i FROM h),
r AS (SELECT id, id AS c FROM n UNION SELECT r.id, hh.j FROM r JOIN hh ON hh.i = r.c) SELECT id, min(c) AS cluster FROM r GROUP BY 1""")
def _(s, d):
    return lv.heaviest_edge_clusters(edges(s, d), nodes(s, d))


@add("cmg_pipeline")
def _(s, d):
    found = lv.filtered_clusters(edges(s, d), nodes(s, d))
    return g.conductance(edges(s, d), found).select("cluster", "cut", "volume", r6("phi").alias("phi"))


@add("simple_coarsen")
def _(s, d):
    return lv.simple_coarsen(edges(s, d), nodes(s, d))


@add("elimination_ops", f"{WITH}, {GONE} SELECT i, j, round(v, 6) AS v FROM p")
def _(s, d):
    return lv.elimination(edges(s, d), gone(s, d))[0].select("i", "j", r6("v").alias("v"))


@add("schur_eliminate", f"""{WITH}, {GONE}, u AS (SELECT i, j, v FROM l WHERE i NOT IN (SELECT id FROM f) AND j NOT IN (SELECT id FROM f)
  UNION ALL SELECT a.i, p.j, -a.v * p.v FROM a JOIN p ON p.i = a.j) SELECT i, j, round(sum(v), 6) + 0.0 AS v FROM u GROUP BY 1, 2""")
def _(s, d):
    return lv.schur_complement(edges(s, d), gone(s, d)).select("i", "j", r6("v").alias("v"))


@add("refinement", f"""{WITH}, {SMOOTH}, e0 AS (SELECT id, (cluster * 3)::DOUBLE AS x FROM s), e1 AS (SELECT i AS id, sum(v * x) AS x FROM fl JOIN e0 ON e0.id = j GROUP BY 1)
SELECT i AS id, round(sum(v * x), 6) + 0.0 AS x FROM fl JOIN e1 ON e1.id = j GROUP BY 1""")
def _(s, d):
    coarse = s.range(16).select("id", F.lit(0).alias("c"), (F.col("id") * 3).cast("double").alias("x"))
    return lv.refined(coarse, [(edges(s, d), nodes(s, d), assign(s, d))]).select("id", r6("x").alias("x"))


@add("interpolate_multilevel", f"{WITH} SELECT id, (id % 16 % 4 * 3)::DOUBLE AS x FROM n")
def _(s, d):
    coarse = s.range(4).select("id", (F.col("id") * 3).cast("double").alias("x"))
    return g.unpool(g.unpool(coarse, s.range(16).select("id", (F.col("id") % 4).alias("cluster"))), assign(s, d))


@add("map_features", f"{V_SQL}, t AS (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS c FROM x) SELECT cluster, c::INT AS c, round(avg(v), 6) + 0.0 AS v FROM t GROUP BY 1, 2")
def _(s, d):
    return vectors(s, d).select("cluster", F.posexplode("x").alias("c", "v")).groupBy("cluster", "c").agg(r6(F.avg("v")).alias("v"))


@add("geometric_coarsen", "SELECT r * 15 + c AS id, (r - r % 2) * 15 + c - c % 2 AS cluster FROM range(20) a(r), range(15) b(c)")
def _(s, d):
    r, c = F.floor(F.col("id") / 15), F.col("id") % 15
    return s.range(300).select("id", ((r - r % 2) * 15 + c - c % 2).alias("cluster"))


@add("gen_stencil", """SELECT r * 15 + c AS i, (r + y) * 15 + c + x AS j, 1.0::DOUBLE AS w FROM range(20) a(r), range(15) b(c), (VALUES (0, 1), (1, -1), (1, 0), (1, 1)) o(y, x)
WHERE r + y < 20 AND c + x BETWEEN 0 AND 14""")
def _(s, d):
    return src.grid_fe(s, 20, 15)


@add("error_norms", f"""{WITH}, r AS (SELECT i AS id, sum(v * x) AS r FROM l JOIN x ON x.id = j GROUP BY 1)
SELECT (SELECT round(sqrt(avg(x * x)), 6) FROM x) AS l2, (SELECT round(stddev_pop(x), 6) FROM x) AS l2_minus_mean, round(sqrt(avg(r * r)), 6) AS residual, round(sqrt(sum(r * r)), 6) AS unscaled FROM r""")
def _(s, d):
    r = g.times_vector(g.laplacian(edges(s, d)), signal(s, d)).agg(r6(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("residual"), r6(F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("unscaled"))
    return signal(s, d).agg(r6(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("l2"), r6(F.stddev_pop("x")).alias("l2_minus_mean")).crossJoin(r)  # one row each


@add("eigen_small")
def _(s, d):
    """The zero eigenvalues of the whole part graph's Laplacian, as many as components, and the five smallest others."""
    zeros, found = sp.laplacian_spectrum(edges(s, d, 1), nodes(s, d))
    zero = s.range(zeros).select(F.col("id").cast("long").alias("k"), F.lit(0.0).alias("value"))
    return zero.unionByName(s.createDataFrame([(zeros + k, round(float(x), 6)) for k, x in enumerate(found.values)], "k long, value double"))


@add("spectral_report")
def _(s, d):
    """Components, fiedler value, gaps, mixing time and conductance bound of the part graph with edges of two or more orders."""
    zeros, found = sp.laplacian_spectrum(edges(s, d), nodes(s, d), 2)
    return s.createDataFrame([sp.report(zeros, found.values)], "components long, fiedler double, gap double, first_gap double, mixing double, conductance_bound double")


RESISTANCE = f"""{RECURSIVE}, {REACH}, c AS (SELECT id, row_number() OVER (ORDER BY id) AS p FROM k WHERE component = (SELECT component FROM k WHERE id = (SELECT min(i) FROM e))),
nb AS (SELECT f.p, list({{'j': t.p, 'w': v}}) AS nb, sum(v) AS d FROM a JOIN c f ON f.id = i JOIN c t ON t.id = j GROUP BY 1), m AS (SELECT list(nb ORDER BY p) AS nb, list(d ORDER BY p) AS d, count(*) AS n FROM nb),
g AS (SELECT 0 AS step, list_transform(range(1, n + 1), lambda i: 0.0::DOUBLE) AS x, list_transform(range(1, n + 1), lambda i: CASE i WHEN 1 THEN 1.0::DOUBLE WHEN n THEN -1.0 ELSE 0.0 END) AS r, r AS p, 2.0::DOUBLE AS rr FROM m
  UNION ALL SELECT step + 1, x, r, list_transform(range(1, n + 1), lambda i: r[i] + list_inner_product(r, r) / rr * p[i]), list_inner_product(r, r) FROM (
    SELECT step, n, list_transform(range(1, n + 1), lambda i: x[i] + z * p[i]) AS x, list_transform(range(1, n + 1), lambda i: r[i] - z * q[i]) AS r, p, rr FROM (
      SELECT *, rr / list_inner_product(p, q) AS z FROM (
        SELECT g.*, n, list_transform(range(1, n + 1), lambda i: d[i] * p[i] - list_sum(list_transform(nb[i], lambda t: t.w * p[t.j]))) AS q FROM g, m WHERE rr > 1e-24))))
SELECT (SELECT id FROM c ORDER BY p LIMIT 1) AS a, (SELECT id FROM c ORDER BY p DESC LIMIT 1) AS b, round(x[1] - x[-1], 6) AS resistance FROM g ORDER BY step DESC LIMIT 1"""


@add("effective_resistance", RESISTANCE)
def _(s, d):
    """Between the first and the last node of the component that holds the first edge; SQL solves the same system by its own recursion."""
    e = it.checkpointed(edges(s, d))
    own = it.checkpointed(it.connected_components(e, nodes(s, d)))
    first = e.agg(F.min("i").alias("id"))
    ends = own.join(own.join(F.broadcast(first), "id").select("component"), "component", "left_semi").agg(F.min("id"), F.max("id")).first()
    return lv.effective_resistance(e.join(own.where(F.col("component") == ends[0]).select(F.col("id").alias("i")), "i", "left_semi"), *ends).select(F.lit(ends[0]).cast("long").alias("a"), F.lit(ends[1]).cast("long").alias("b"), r6("resistance").alias("resistance"))


@add("logistic_scoring")
def _(s, d):
    x = src.table(s, d, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label", (F.col("vec_id") % 10 < 8).alias("train"))
    return lv.scored(x)


@add("embedding_pipeline")
def _(s, d):
    """From fusion to accuracy: vectors' feature graph and part graph fused over the same ids, one coarse level, ten walks of 81 nodes, skip-gram of 128 in five passes, refinement, and the vectors' labels by logistic regression."""
    fused = g.adjacency(g.add(g.laplacian(feature_graph(vectors(s, d), 3)), g.laplacian(edges(s, d))))
    ids = vectors(s, d).select("id").unionByName(nodes(s, d)).distinct()
    x = lv.wide(lv.embedding(it.checkpointed(fused), it.checkpointed(ids)))
    labels = src.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 10 < 8).alias("train"))
    return lv.scored(x.join(labels, "id").select("x", "label", "train"))


def trained(s, d):
    """Edges kept for training, all edges, support rows and weights of the neighbourhood model on the feature graph of the vectors; edges of i + j divisible by 10 are held out."""
    x = vectors(s, d).where("x is not null")
    size = x.select(F.max(F.size("x"))).first()[0]
    x = it.checkpointed(x.where(F.size("x") == size))
    every = it.checkpointed(feature_graph(x, 3))
    kept = every.where("(i + j) % 10 <> 0")
    rows = it.stored(sage.support(kept, x.select("id", "x")), "sage-support")
    walks = wk.first_order(kept, x.select("id"), 4, 5)
    w, losses = sage.train(wk.context_pairs(walks), kept, rows, size)
    return every, kept, rows, w, losses


@add("sage_training")
def _(s, d):
    """Mean loss of each step, each before its move, over context pairs of walks of five steps."""
    losses = trained(s, d)[-1]
    return s.createDataFrame([(k, float(x)) for k, x in enumerate(losses)], "step int, loss double")


@add("sage_mrr")
def _(s, d):
    """Mean reciprocal ranks of kept and held-out edges among 100 nodes drawn by degree^0.75: by the trained vectors and by those of untrained weights."""
    every, kept, rows, w, _ = trained(s, d)
    pairs = it.checkpointed(every.select(F.col("i").alias("id"), F.col("j").alias("context"), ((F.col("i") + F.col("j")) % 10 == 0).alias("held_out")))
    others = it.checkpointed(sage.negatives(g.degrees(kept).select("id", "degree"), 1000, 100))
    out = None
    for name, weights in (("trained", w), ("untrained", sage.start(*w["own1"].shape))):
        z = it.stored(sage.embedded(rows, weights), "sage-vectors")
        ranks = sage.reciprocal_ranks(z, pairs.select("id", "context"), others).join(pairs, ["id", "context"])
        row = ranks.groupBy("held_out").agg(F.count("*").alias("pairs"), F.avg("reciprocal").alias("mrr")).withColumn("weights", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
