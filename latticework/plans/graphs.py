"""Queries over the graph of parts that are ordered together, and over generated graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators import walks as wk
from latticework.plans.common import Queries, r6
from latticework.sources import graphs as src

QUERIES = Queries()
add = QUERIES.add

E_SQL = """
op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
e AS (SELECT a.p AS i, b.p AS j, count(*)::DOUBLE AS w FROM op a JOIN op b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2),
a AS (SELECT i, j, w AS v FROM e UNION ALL SELECT j, i, w FROM e),
d AS (SELECT i AS id, count(*) AS degree, sum(v) AS weight FROM a GROUP BY 1),
l AS (SELECT id AS i, id AS j, weight AS v FROM d UNION ALL SELECT i, j, -v FROM a),
n AS (SELECT p_partkey AS id FROM part),
s AS (SELECT id, id % 16 AS cluster FROM n),
x AS (SELECT id, (id % 7)::DOUBLE AS x FROM n)"""
WITH, RECURSIVE = f"WITH {E_SQL}", f"WITH RECURSIVE {E_SQL}"

edges, nodes = src.part_edges, src.part_nodes


def assign(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("id", (F.col("id") % 16).alias("cluster"))


def signal(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("id", (F.col("id") % 7).cast("double").alias("x"))


@add("part_graph_strong", f"{WITH} SELECT i, j, w FROM e")
def _(s, d):
    return edges(s, d)


@add("part_graph", f"WITH {E_SQL.replace('HAVING count(*) >= 2', '')} SELECT i, j, w FROM e")
def _(s, d):
    return edges(s, d, 1)


@add("degree", f"{WITH} SELECT id, degree FROM d")
def _(s, d):
    return g.degrees(edges(s, d)).select("id", "degree")


@add("weighted_degree", f"{WITH} SELECT id, weight FROM d")
def _(s, d):
    return g.degrees(edges(s, d)).select("id", "weight")


@add("laplacian", f"{WITH} SELECT i, j, v FROM l")
def _(s, d):
    return g.laplacian(edges(s, d))


@add("adjacency_from_laplacian", f"{WITH} SELECT i, j, -v AS w FROM l WHERE i < j AND v < 0")
def _(s, d):
    return g.adjacency(g.laplacian(edges(s, d)))


@add("norm_laplacian", f"{WITH} SELECT i, j, round(v / (sqrt(p.weight + 1e-12) * sqrt(q.weight + 1e-12)), 6) + 0.0 AS v FROM l JOIN d p ON p.id = i JOIN d q ON q.id = j")
def _(s, d):
    return g.normalised_laplacian(edges(s, d)).select("i", "j", r6("v").alias("v"))


@add("smooth_filter", f"""{WITH}, m AS (SELECT * FROM a UNION ALL SELECT id, id, 0.1 FROM n), t AS (SELECT i AS id, sum(v) AS w FROM m GROUP BY 1)
SELECT i, j, round(v / (sqrt(p.w) * sqrt(q.w)), 6) + 0.0 AS v FROM m JOIN t p ON p.id = i JOIN t q ON q.id = j""")
def _(s, d):
    return g.smooth_filter(edges(s, d), nodes(s, d)).select("i", "j", r6("v").alias("v"))


@add("galerkin", f"{WITH} SELECT p.cluster AS i, q.cluster AS j, sum(v) + 0.0 AS v FROM l JOIN s p ON p.id = i JOIN s q ON q.id = j GROUP BY 1, 2")
def _(s, d):
    return g.galerkin(g.laplacian(edges(s, d)), assign(s, d)).select("i", "j", (F.col("v") + 0.0).alias("v"))


@add("spmm", f"{WITH} SELECT p.i, q.j, sum(p.v * q.v) AS v FROM a p JOIN a q ON p.j = q.i GROUP BY 1, 2")
def _(s, d):
    a = g.both_ways(edges(s, d))
    return g.multiply(a, a)


@add("matrix_add", f"{WITH} SELECT i, j, sum(v) + 0.0 AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM l) GROUP BY 1, 2")
def _(s, d):
    e = edges(s, d)
    return g.add(g.both_ways(e), g.laplacian(e)).select("i", "j", (F.col("v") + 0.0).alias("v"))


@add("sym_max", f"{WITH} SELECT i, j, max(v) AS v FROM (SELECT i, j, w * (i % 3) AS v FROM e UNION ALL SELECT j, i, w * (i % 3) FROM e UNION ALL SELECT i, j, w FROM e) GROUP BY 1, 2")
def _(s, d):
    e = edges(s, d)
    directed = e.select("i", "j", (F.col("w") * (F.col("i") % 3)).alias("v"))
    return g.elementwise_max(directed.unionByName(directed.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")), e.select("i", "j", F.col("w").alias("v")))


STRONG = "b AS (SELECT i AS id, max(abs(v)) AS b FROM a GROUP BY 1), k AS (SELECT e.* FROM e JOIN b p ON p.id = i JOIN b q ON q.id = j WHERE abs(w) >= 0.75 * least(p.b, q.b))"


@add("strong_adjacency", f"{WITH}, {STRONG} SELECT i, j, w FROM k")
def _(s, d):
    return g.strong(edges(s, d), 0.75)


@add("weak_edge_portion", f"{WITH}, {STRONG} SELECT round(1 - (SELECT count(*) FROM k) / count(*), 6) AS portion FROM e")
def _(s, d):
    e = edges(s, d)
    kept = g.strong(e, 0.75).agg(F.count("*").alias("k"))
    return e.agg(F.count("*").alias("n")).crossJoin(kept).select(r6(1 - F.col("k") / F.col("n")).alias("portion"))  # one row each


@add("second_degree_nbrs", f"{WITH} SELECT DISTINCT p.i, q.j FROM a p JOIN a q ON p.j = q.i WHERE p.i <> q.j")
def _(s, d):
    return g.second_neighbours(edges(s, d))


@add("drop_isolated", f"{WITH} SELECT id FROM n WHERE id IN (SELECT id FROM d)")
def _(s, d):
    return nodes(s, d).join(g.degrees(edges(s, d)), "id", "left_semi")


@add("compose_mapping", f"{WITH} SELECT id, id % 16 % 4 AS cluster FROM n")
def _(s, d):
    return g.compose(assign(s, d), s.range(16).select("id", (F.col("id") % 4).alias("cluster")))


@add("pool_sum", f"{WITH} SELECT cluster, count(*) AS size, sum(x) AS total, round(avg(x), 6) AS mean FROM x JOIN s USING (id) GROUP BY 1")
def _(s, d):
    return g.pooled(signal(s, d), assign(s, d)).select("cluster", "size", "total", r6("mean").alias("mean"))


@add("unpool_copy", f"{WITH} SELECT id, (cluster * 3)::DOUBLE AS x FROM s")
def _(s, d):
    return g.unpool(s.range(16).select("id", (F.col("id") * 3).cast("double").alias("x")), assign(s, d))


@add("unpool_first", f"{WITH} SELECT id, CASE WHEN id = min(id) OVER (PARTITION BY cluster) THEN (cluster * 3)::DOUBLE ELSE 0.0 END AS x FROM s")
def _(s, d):
    return g.unpool(s.range(16).select("id", (F.col("id") * 3).cast("double").alias("x")), assign(s, d), "first")


@add("unpool_central", f"""{WITH}, k AS (SELECT s.id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(degree, 0) DESC, s.id) AS nth FROM s LEFT JOIN d USING (id))
SELECT id, CASE WHEN nth = 1 THEN (cluster * 3)::DOUBLE ELSE 0.0 END AS x FROM k""")
def _(s, d):
    coarse = s.range(16).select("id", (F.col("id") * 3).cast("double").alias("x"))
    return g.unpool(coarse, assign(s, d), "central", g.degrees(edges(s, d)).select("id", "degree"))


@add("coarse_edge_counts", f"{WITH} SELECT least(p.cluster, q.cluster) AS i, greatest(p.cluster, q.cluster) AS j, count(*) AS n FROM e JOIN s p ON p.id = i JOIN s q ON q.id = j GROUP BY 1, 2")
def _(s, d):
    c = assign(s, d)
    e = edges(s, d).join(c.select(F.col("id").alias("i"), F.col("cluster").alias("p")), "i").join(c.select(F.col("id").alias("j"), F.col("cluster").alias("q")), "j")
    return e.groupBy(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).agg(F.count("*").alias("n"))


PHI = """k AS (SELECT p.cluster, count(*) FILTER (p.cluster <> q.cluster) AS cut, count(*) AS volume FROM a JOIN s p ON p.id = i JOIN s q ON q.id = j GROUP BY 1),
phi AS (SELECT cluster, cut, volume, CASE WHEN least(volume, (SELECT count(*) FROM a) - volume) > 0 THEN cut / least(volume, (SELECT count(*) FROM a) - volume) END AS phi FROM k)"""


@add("conductance", f"{WITH}, {PHI} SELECT cluster, cut, volume, round(phi, 6) AS phi FROM phi")
def _(s, d):
    return g.conductance(edges(s, d), assign(s, d)).select("cluster", "cut", "volume", r6("phi").alias("phi"))


@add("avg_conductance", f"{WITH}, {PHI} SELECT round(avg(phi), 6) AS phi FROM phi")
def _(s, d):
    return g.conductance(edges(s, d), assign(s, d)).agg(r6(F.avg("phi")).alias("phi"))


@add("level_stats", f"{WITH} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT cluster) FROM s) AS clusters, round((SELECT count(*) FROM n) / (SELECT count(DISTINCT cluster) FROM s), 6) AS ratio")
def _(s, d):
    parts = nodes(s, d).agg(F.count("*").alias("nodes")).crossJoin(edges(s, d).agg(F.count("*").alias("edges"))).crossJoin(assign(s, d).agg(F.count_distinct("cluster").alias("clusters")))
    return parts.withColumn("ratio", r6(F.col("nodes") / F.col("clusters")))  # one row each


@add("density", f"{WITH} SELECT round(2 * (SELECT count(*) FROM e) / (count(*) * (count(*) - 1)), 9) AS density FROM n")
def _(s, d):
    n = nodes(s, d).agg(F.count("*").alias("n")).crossJoin(edges(s, d).agg(F.count("*").alias("m")))
    return n.select(F.round(2 * F.col("m") / (F.col("n") * (F.col("n") - 1)), 9).alias("density"))


@add("sun_nodes", f"{WITH}, t AS (SELECT i AS id, sum(abs(v) * d.degree) / any_value(w.weight) AS mean FROM a JOIN d ON d.id = j JOIN d w ON w.id = i GROUP BY 1) SELECT id FROM d JOIN t USING (id) WHERE degree >= 2 * mean")
def _(s, d):
    e = edges(s, d)
    deg = g.degrees(e)
    near = g.both_ways(e).join(deg.select(F.col("id").alias("j"), "degree"), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.abs("v") * F.col("degree")).alias("t"))
    return deg.join(near, "id").where(F.col("degree") >= 2 * (F.col("t") / F.col("weight"))).select("id")


@add("median_nbr", f"{WITH} SELECT i AS id, list_sort(list(v))[(count(*) // 2)::INT + 1] AS median FROM a GROUP BY 1")
def _(s, d):
    return g.both_ways(edges(s, d)).groupBy(F.col("i").alias("id")).agg(F.sort_array(F.collect_list("v")).alias("v")).select("id", F.element_at("v", F.expr("cast(size(v) div 2 as int) + 1")).alias("median"))


TRI = "t AS (SELECT x.i AS a1, x.j AS b1, y.j AS c1 FROM e x JOIN e y ON x.j = y.i JOIN e z ON z.i = x.i AND z.j = y.j), c AS (SELECT id, count(*) AS t FROM (SELECT a1 AS id FROM t UNION ALL SELECT b1 FROM t UNION ALL SELECT c1 FROM t) GROUP BY 1)"


@add("clustering_coefficient", f"{WITH}, {TRI} SELECT id, round(CASE WHEN degree > 1 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0.0 END, 6) AS coefficient FROM d LEFT JOIN c USING (id)")
def _(s, d):
    return g.clustering_coefficients(edges(s, d)).select("id", r6("coefficient").alias("coefficient"))


@add("subgraph", f"{WITH} SELECT i, j, w FROM e WHERE i % 3 = 0 AND j % 3 = 0")
def _(s, d):
    keep = nodes(s, d).where("id % 3 = 0")
    return edges(s, d).join(keep.withColumnRenamed("id", "i"), "i", "left_semi").join(keep.withColumnRenamed("id", "j"), "j", "left_semi")


@add("edge_split", f"{WITH} SELECT i, j, i % 10 >= 8 OR j % 10 >= 8 AS train_removed FROM e")
def _(s, d):
    return edges(s, d).select("i", "j", ((F.col("i") % 10 >= 8) | (F.col("j") % 10 >= 8)).alias("train_removed"))


@add("nodal_energy", f"{WITH} SELECT i AS id, round(sum(v * (p.x - q.x) * (p.x - q.x)) / 2, 6) + 0.0 AS energy FROM a JOIN x p ON p.id = i JOIN x q ON q.id = j GROUP BY 1")
def _(s, d):
    return g.nodal_energy(edges(s, d), signal(s, d)).select("id", r6("energy").alias("energy"))


@add("rayleigh_quotient", f"{WITH} SELECT round((SELECT sum(w * (p.x - q.x) * (p.x - q.x)) FROM e JOIN x p ON p.id = i JOIN x q ON q.id = j) / sum(x * x), 6) AS quotient FROM x")
def _(s, d):
    x = signal(s, d)
    top = x.join(g.times_vector(g.laplacian(edges(s, d)), x).withColumnRenamed("x", "lx"), "id").agg(F.sum(F.col("x") * F.col("lx")).alias("t"))
    return top.crossJoin(x.agg(F.sum(F.col("x") * F.col("x")).alias("b"))).select(r6(F.col("t") / F.col("b")).alias("quotient"))


@add("jacobi_step", f"""{WITH}, wx AS (SELECT i AS id, sum(v * x) AS wx FROM a JOIN x ON x.id = j GROUP BY 1)
SELECT id, round(CASE WHEN weight IS NULL THEN x ELSE (1 - 0.5) * x + 0.5 * (1 + wx) / weight END, 6) + 0.0 AS x FROM x LEFT JOIN d USING (id) LEFT JOIN wx USING (id)""")
def _(s, d):
    b = nodes(s, d).select("id", F.lit(1.0).alias("x"))
    return g.jacobi_step(edges(s, d), signal(s, d), b, 0.5).select("id", r6("x").alias("x"))


@add("remove_zero_modes", f"{WITH} SELECT id, round(x - avg(x) OVER (PARTITION BY cluster), 6) + 0.0 AS x FROM x JOIN s USING (id)")
def _(s, d):
    m = g.pooled(signal(s, d), assign(s, d)).select("cluster", "mean")
    return signal(s, d).join(assign(s, d), "id").join(m, "cluster").select("id", r6(F.col("x") - F.col("mean")).alias("x"))


U_SQL = "((({z} * {z} + {c} + 1) % 2147483647) * (({z} * {z} + {c} + 1) % 2147483647) + {i}) % 2147483647 / 2147483647::DOUBLE"
Z_SQL = "(({i} * 1103515245 + ({c} + 1)::BIGINT * 620899117 + 7) % 2147483647)"


def u_sql(i: str, c: int) -> str:
    return "(" + U_SQL.format(z=Z_SQL.format(i=i, c=c), c=c, i=i) + ")"


@add("test_vectors", f"{WITH} SELECT id, c, round(u - avg(u) OVER (PARTITION BY c), 6) + 0.0 AS v FROM (" + " UNION ALL ".join(f"SELECT id, {c} AS c, 2 * {u_sql('id', c)} - 1 AS u FROM n" for c in range(7)) + ")")
def _(s, d):
    u = nodes(s, d).select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), (2 * g.uniform(F.col("id"), c) - 1).alias("u")) for c in range(7)))).alias("t")).select("id", "t.*")
    mean = u.groupBy("c").agg(F.avg("u").alias("m"))
    return u.join(F.broadcast(mean), "c").select("id", "c", r6(F.col("u") - F.col("m")).alias("v"))  # mean: seven rows


@add("node2vec_transition", f"""{WITH}, m AS (SELECT x.i AS previous, x.j AS current, y.j AS next, CASE WHEN y.j = x.i THEN y.v / 2 WHEN k.i IS NOT NULL THEN y.v ELSE y.v / 0.5 END AS w
  FROM a x JOIN a y ON x.j = y.i LEFT JOIN a k ON k.i = x.i AND k.j = y.j)
SELECT previous, current, next, round(w / sum(w) OVER (PARTITION BY previous, current), 6) AS probability FROM m""")
def _(s, d):
    return g.node2vec_transitions(edges(s, d), 2.0, 0.5).select("previous", "current", "next", r6("probability").alias("probability"))


@add("neighbor_sample", f"""{WITH}, k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY {u_sql('(i * 7919 + j)', 0)}, j) - 1 AS r, count(*) OVER (PARTITION BY i) AS n FROM a)
SELECT i AS id, slot::BIGINT AS slot, j AS neighbour FROM k, unnest(range(r, 4, least(n, 4))) AS t(slot) WHERE r < 4""")
def _(s, d):
    return g.sampled_neighbours(edges(s, d), 4)


@add("sage_mean_agg", f"{WITH} SELECT i AS id, round(avg(x), 6) AS x FROM a JOIN x ON x.id = j GROUP BY 1")
def _(s, d):
    return g.both_ways(edges(s, d)).join(signal(s, d).withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(r6(F.avg("x")).alias("x"))


@add("sage_gcn_agg", f"{WITH} SELECT id, round(avg(x), 6) AS x FROM (SELECT i AS id, x FROM a JOIN x ON x.id = j UNION ALL SELECT id, x FROM x) GROUP BY 1")
def _(s, d):
    near = g.both_ways(edges(s, d)).join(signal(s, d).withColumnRenamed("id", "j"), "j").select(F.col("i").alias("id"), "x")
    return near.unionByName(signal(s, d)).groupBy("id").agg(r6(F.avg("x")).alias("x"))


@add("sage_max_agg", f"{WITH} SELECT i AS id, max(x) AS x FROM a JOIN x ON x.id = j GROUP BY 1")
def _(s, d):
    return g.both_ways(edges(s, d)).join(signal(s, d).withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(F.max("x").alias("x"))


REACH = "r AS (SELECT id, id AS c FROM n UNION SELECT r.id, a.j FROM r JOIN a ON a.i = r.c), k AS (SELECT id, min(c) AS component FROM r GROUP BY 1)"


@add("connected_components", f"{RECURSIVE}, {REACH} SELECT id, component FROM k")
def _(s, d):
    return it.connected_components(edges(s, d), nodes(s, d))


@add("component_sizes", f"{RECURSIVE}, {REACH} SELECT size, count(*) AS n FROM (SELECT component, count(*) AS size FROM k GROUP BY 1) GROUP BY 1")
def _(s, d):
    return it.connected_components(edges(s, d), nodes(s, d)).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@add("low_degree_mis")
def _(s, d):
    return it.independent_set(edges(s, d), nodes(s, d), 20)


@add("cg_solve", f"{RECURSIVE}, {REACH}, y AS (SELECT id, {u_sql('id', 11)} AS y FROM n) SELECT id, round(y - avg(y) OVER (PARTITION BY component), 6) + 0.0 AS x FROM y JOIN k USING (id) JOIN d USING (id)")
def _(s, d):
    """Right-hand side L y for hashed numbers y: from zero, the solution is y less its mean over each component."""
    l = it.checkpointed(g.laplacian(edges(s, d)))
    y = nodes(s, d).select("id", g.uniform(F.col("id"), 11).alias("x"))
    return it.conjugate_gradients(l, g.times_vector(l, y), tolerance=1e-12).select("id", r6("x").alias("x"))


def walk_sql(walks: int, length: int) -> str:
    u = u_sql("(w.id * 31 + w.walk * 17 + w.step + 1)", "(w.step + 1)")
    return f"""cum AS (SELECT i, j, v, sum(v) OVER (PARTITION BY i ORDER BY j) AS upto, sum(v) OVER (PARTITION BY i) AS total FROM a),
w AS (SELECT walk, id, 0 AS step, id AS node FROM n, range({walks}) t(walk) UNION ALL SELECT w.walk, w.id, w.step + 1, coalesce(c.j, w.node)
  FROM w LEFT JOIN cum c ON c.i = w.node AND {u} * c.total >= c.upto - c.v AND {u} * c.total < c.upto WHERE w.step < {length})"""


@add("weighted_walk", f"{RECURSIVE}, {walk_sql(10, 80)} SELECT walk::INT AS walk, id, count(*) AS nodes, max(CASE WHEN step = 80 THEN node END) AS last, sum(node * (step + 1))::BIGINT AS path FROM w GROUP BY 1, 2")
def _(s, d):
    """Ten walks of 81 nodes from every node: of each its length, last node and a sum over all its nodes by their places."""
    found = wk.first_order(it.checkpointed(edges(s, d)), nodes(s, d))
    return found.groupBy("walk", "id").agg(F.count("*").alias("nodes"), F.max(F.when(F.col("step") == 80, F.col("node"))).alias("last"), F.sum(F.col("node") * (F.col("step") + 1)).alias("path"))


@add("node2vec_walk")
def _(s, d):
    """Ten second-order walks of 80 nodes from every node: how often each node is met at each step."""
    found = wk.second_order(it.checkpointed(edges(s, d)), nodes(s, d), 0.5, 2.0)
    return found.groupBy("node", "step").agg(F.count("*").alias("visits"))


@add("gen_grid", "SELECT r * 15 + c AS i, r * 15 + c + 1 AS j, 1.0::DOUBLE AS w FROM range(20) a(r), range(14) b(c) UNION ALL SELECT r * 15 + c, r * 15 + c + 15, 1.0::DOUBLE FROM range(19) a(r), range(15) b(c)")
def _(s, d):
    return src.grid(s, 20, 15)


@add("gen_path", "SELECT i, i + 1 AS j, CASE WHEN i = 49 THEN 0.001 ELSE 1.0 END::DOUBLE AS w FROM range(99) a(i)")
def _(s, d):
    return src.path(s, 100, 0.001)


@add("gen_sun", "SELECT 0::BIGINT AS i, j, 1.0::DOUBLE AS w FROM range(1, 50) a(j)")
def _(s, d):
    return src.star(s, 50)


@add("gen_complete", "SELECT i, j, 1.0::DOUBLE AS w FROM range(30) a(i), range(30) b(j) WHERE i < j")
def _(s, d):
    return src.complete(s, 30)


@add("gen_union", "SELECT 0::BIGINT AS i, j, 1.0::DOUBLE AS w FROM range(1, 10) a(j) UNION ALL SELECT i + 10, j + 10, 1.0::DOUBLE FROM range(6) a(i), range(6) b(j) WHERE i < j UNION ALL SELECT 0, 10, 0.5")
def _(s, d):
    return src.union(src.star(s, 10), src.complete(s, 6), 10, (0, 10, 0.5))
