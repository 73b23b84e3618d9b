"""Queries over entries, components, pooling, sampling and generated graphs that complete those of plans/graphs.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.operators import distances as ds
from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators import levels as lv
from latticework.operators import spectra as sp
from latticework.operators import walks as wk
from latticework.plans.common import Queries, r6
from latticework.plans.graphs import REACH, RECURSIVE, WITH, assign, edges, nodes, signal, u_sql, walk_sql
from latticework.plans.levels import SMOOTH, TV
from latticework.sources import graphs as src

QUERIES = Queries()
add = QUERIES.add


@add("filter_small_entries", f"{WITH}, b AS (SELECT i AS id, max(abs(v)) AS b FROM a GROUP BY 1) SELECT i, j, w FROM e JOIN b p ON p.id = i JOIN b q ON q.id = j WHERE abs(w) >= 0.6 * greatest(p.b, q.b)")
def _(s, d):
    return g.large_entries(edges(s, d), 0.6)


@add("edge_count_range", f"{WITH} SELECT id, degree FROM d WHERE degree BETWEEN 2 AND 5")
def _(s, d):
    return g.degrees(edges(s, d)).where(F.col("degree").between(2, 5)).select("id", "degree")


@add("laplacian_to_edges", f"{WITH} SELECT i, j, -v AS w FROM l WHERE i < j AND v < 0")
def _(s, d):
    return g.adjacency(g.laplacian(edges(s, d)))


@add("to_laplacian_policy", f"{WITH}, f AS (SELECT count(CASE WHEN i = j AND v <> 0 THEN 1 END) > 0 AS diagonal FROM l), w AS (SELECT i, j, CASE WHEN diagonal THEN 1.0 ELSE abs(v) END::DOUBLE AS v FROM l, f WHERE i <> j) SELECT i, i AS j, sum(v) AS v FROM w GROUP BY 1 UNION ALL SELECT i, j, -v FROM w")
def _(s, d):
    """A matrix with a diagonal counts as a pattern, any other by its absolute values."""
    return g.as_laplacian(g.laplacian(edges(s, d)))


@add("spmm_dense", f"{WITH}, {TV} SELECT i AS id, c - 1 AS c, round(sum(v * x[c]), 6) + 0.0 AS x FROM a JOIN tv ON tv.id = j, unnest(range(1, 8)) AS t(c) GROUP BY 1, 2")
def _(s, d):
    return lv.times_columns(g.both_ways(edges(s, d)), lv.long(lv.random_vectors(nodes(s, d)))).select("id", F.col("c").cast("long").alias("c"), r6("x").alias("x"))


@add("smoothed_tv", f"""{WITH}, u AS (""" + " UNION ALL ".join(f"SELECT id, {c} AS c, 2 * {u_sql('id', c)} - 1 AS u FROM n" for c in range(7)) + f"""), t0 AS (SELECT id, c, u - avg(u) OVER (PARTITION BY c) AS x FROM u), {SMOOTH},
y1 AS (SELECT i AS id, c, sum(v * x) AS x FROM fl JOIN t0 ON t0.id = j GROUP BY 1, 2), y2 AS (SELECT i AS id, c, sum(v * x) AS x FROM fl JOIN y1 ON y1.id = j GROUP BY 1, 2) SELECT id, c, round(x, 6) + 0.0 AS x FROM y2""")
def _(s, d):
    """Centred random vectors after two steps of the smooth filter."""
    u = lv.long(lv.random_vectors(nodes(s, d)))
    mean = u.groupBy("c").agg(F.avg("x").alias("m"))
    x = u.join(F.broadcast(mean), "c").select("id", "c", (F.col("x") - F.col("m")).alias("x"))  # mean: seven rows
    f = it.checkpointed(g.smooth_filter(edges(s, d), nodes(s, d)))
    return lv.times_columns(f, lv.times_columns(f, x)).select("id", F.col("c").cast("int").alias("c"), r6("x").alias("x"))


@add("max_open_affinity", f"{WITH}, {TV}, f AS (SELECT i, j, list_inner_product(p.x, q.x) ** 2 / (list_inner_product(p.x, p.x) * list_inner_product(q.x, q.x)) AS v FROM a JOIN tv p ON p.id = i JOIN tv q ON q.id = j WHERE j % 3 <> 0) SELECT i AS id, round(max(v), 6) AS affinity FROM f GROUP BY 1")
def _(s, d):
    """Largest affinity to a neighbour that is still open."""
    f = lv.affinity_matrix(edges(s, d), lv.random_vectors(nodes(s, d)))
    return g.both_ways(f.withColumnRenamed("v", "w")).where("j % 3 <> 0").groupBy(F.col("i").alias("id")).agg(r6(F.max("v")).alias("affinity"))


@add("largest_component", f"{RECURSIVE}, {REACH}, z AS (SELECT component, count(*) AS size FROM k GROUP BY 1) SELECT component, size, round(size / (SELECT count(*) FROM n), 6) AS share FROM z ORDER BY size DESC, component LIMIT 1")
def _(s, d):
    found = it.connected_components(edges(s, d), nodes(s, d)).groupBy("component").agg(F.count("*").alias("size"))
    total = nodes(s, d).agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("size"), "component").limit(1).join(F.broadcast(total)).select("component", "size", r6(F.col("size") / F.col("total")).alias("share"))  # total: one row


@add("component_decomposition", f"{RECURSIVE}, {REACH} SELECT component, count(*) AS size FROM k GROUP BY 1 HAVING count(*) >= 3")
def _(s, d):
    return it.connected_components(edges(s, d), nodes(s, d)).groupBy("component").agg(F.count("*").alias("size")).where("size >= 3")


@add("component_index", f"{RECURSIVE}, {REACH} SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS component FROM k")
def _(s, d):
    """Components by running number, in the order of their least nodes."""
    found = it.checkpointed(it.connected_components(edges(s, d), nodes(s, d)))
    index = it.numbered(found.select(F.col("component").alias("id")).distinct())
    return found.join(index.withColumnRenamed("id", "component"), "component").select("id", F.col("number").alias("component"))


@add("aggregate_index", f"{WITH} SELECT id, dense_rank() OVER (ORDER BY id - id % 16) - 1 AS aggregate FROM n")
def _(s, d):
    """Aggregates by running number, from each node's seed."""
    seeds = nodes(s, d).select("id", (F.col("id") - F.col("id") % 16).alias("seed"))
    index = it.numbered(seeds.select(F.col("seed").alias("id")).distinct())
    return seeds.join(index.withColumnRenamed("id", "seed"), "seed").select("id", F.col("number").alias("aggregate"))


@add("pool_mean", f"{WITH} SELECT cluster, round(avg(x), 6) AS x FROM x JOIN s USING (id) GROUP BY 1")
def _(s, d):
    return g.pooled(signal(s, d), assign(s, d)).select("cluster", r6("mean").alias("x"))


@add("pool_by_graph", f"{WITH} SELECT id % 3 AS graph_id, cluster, count(*) AS size, sum(x) AS total, round(avg(x), 6) AS mean FROM x JOIN s USING (id) GROUP BY 1, 2")
def _(s, d):
    """Pooling of a batch of graphs: the graph is part of the key."""
    x = signal(s, d).join(assign(s, d), "id").groupBy((F.col("id") % 3).alias("graph_id"), "cluster")
    return x.agg(F.count("*").alias("size"), F.sum("x").alias("total"), r6(F.avg("x")).alias("mean"))


@add("multi_hop_sample", f"""{WITH}, k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY {u_sql('(i * 7919 + j)', 0)}, j) - 1 AS r, count(*) OVER (PARTITION BY i) AS n FROM a),
m AS (SELECT i AS id, slot::BIGINT AS slot, j FROM k, unnest(range(r, 4, least(n, 4))) AS t(slot) WHERE r < 4) SELECT p.id, p.slot AS first, q.slot AS second, q.j AS neighbour FROM m p JOIN m q ON q.id = p.j""")
def _(s, d):
    """Sampled neighbours of sampled neighbours: a fixed width at either hop, so rows grow with the nodes alone."""
    m = g.sampled_neighbours(edges(s, d), 4)
    return m.select("id", F.col("slot").alias("first"), F.col("neighbour").alias("by")).join(m.select(F.col("id").alias("by"), F.col("slot").alias("second"), "neighbour"), "by").select("id", "first", "second", "neighbour")


@add("sage_layer", f"""{WITH}, m AS (SELECT i AS id, avg(x) AS m FROM a JOIN x ON x.id = j GROUP BY 1), o AS (SELECT id, greatest(0, 0.5 * x - 1) AS p, greatest(0, 2 * m - 1) AS q FROM x JOIN m USING (id))
SELECT id, round(CASE WHEN p = 0 AND q = 0 THEN 0 ELSE p / sqrt(p * p + q * q) END, 6) AS own, round(CASE WHEN p = 0 AND q = 0 THEN 0 ELSE q / sqrt(p * p + q * q) END, 6) AS near FROM o""")
def _(s, d):
    """One mean layer with weights: own and neighbours' values side by side, rectified, of unit length."""
    mean = g.both_ways(edges(s, d)).join(signal(s, d).withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(F.avg("x").alias("m"))
    out = signal(s, d).join(mean, "id").select("id", F.greatest(F.lit(0.0), 0.5 * F.col("x") - 1).alias("p"), F.greatest(F.lit(0.0), 2 * F.col("m") - 1).alias("q"))
    norm = F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    unit = lambda c: r6(F.when(norm == 0, 0.0).otherwise(F.col(c) / norm))
    return out.select("id", unit("p").alias("own"), unit("q").alias("near"))


@add("negative_sampling", f"{WITH} SELECT id, round(power(degree, 0.75) / (SELECT sum(power(degree, 0.75)) FROM d), 9) AS probability FROM d")
def _(s, d):
    weight = g.degrees(edges(s, d)).select("id", F.pow("degree", F.lit(0.75)).alias("p"))
    return weight.join(F.broadcast(weight.agg(F.sum("p").alias("total")))).select("id", F.round(F.col("p") / F.col("total"), 9).alias("probability"))  # total: one row


@add("alias_setup", f"{WITH} SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 6) AS probability FROM a")
def _(s, d):
    """Each neighbour's probability, put together again from the alias tables."""
    t = wk.alias_tables(edges(s, d))
    at = t.select("i", "to", F.size("to").alias("n"), F.posexplode(F.arrays_zip("keep", "other")).alias("k", "t"))
    shares = at.select("i", F.explode(F.array(F.struct(F.element_at("to", F.col("k") + 1).alias("j"), (F.col("t.keep") / F.col("n")).alias("p")), F.struct(F.element_at("to", F.col("t.other")).alias("j"), ((1 - F.col("t.keep")) / F.col("n")).alias("p")))).alias("s"))
    return shares.groupBy("i", F.col("s.j").alias("j")).agg(r6(F.sum("s.p")).alias("probability"))


@add("walk_pairs", f"{RECURSIVE}, {walk_sql(50, 5)} SELECT id, node AS context, count(*) AS n FROM w WHERE step > 0 AND node <> id GROUP BY 1, 2")
def _(s, d):
    """Context pairs of 50 walks of five steps from every node: each node with the walk's start, without pairs of a node with itself."""
    walks = wk.first_order(it.checkpointed(edges(s, d)), nodes(s, d), 50, 5)
    return wk.context_pairs(walks).groupBy("id", "context").agg(F.count("*").alias("n"))


@add("simple_multilevel")
def _(s, d):
    """Nodes and edges of each level."""
    out = None
    for level, (e, _, c) in enumerate(lv.hierarchy(edges(s, d), nodes(s, d), 2)):
        row = e.agg(F.lit(level).alias("level"), F.count("*").alias("edges")).join(F.broadcast(c.agg(F.count_distinct("cluster").alias("clusters"))))  # one row
        out = row if out is None else out.unionByName(row)
    return out


HOPS = f"""{RECURSIVE}, {REACH}, z AS (SELECT component, count(*) AS size FROM k GROUP BY 1), top AS (SELECT * FROM z ORDER BY size DESC, component LIMIT 1)"""


@add("hops_from_sources", f"""{HOPS}, h(source, id, hops) USING KEY (source, id) AS (SELECT id, id, 0 FROM n WHERE id % 50 = 1
  UNION SELECT h.source, a.j, h.hops + 1 FROM h JOIN a ON a.i = h.id LEFT JOIN recurring.h o ON o.source = h.source AND o.id = a.j WHERE o.id IS NULL) SELECT source, id, hops FROM h""")
def _(s, d):
    """Hops from every fiftieth node to all that it reaches."""
    return ds.hops(it.checkpointed(edges(s, d)), nodes(s, d).where("id % 50 = 1"))


@add("connectivity_report", f"""{HOPS}, h(source, id, hops) USING KEY (source, id) AS (SELECT id, id, 0 FROM k WHERE component = (SELECT component FROM top)
  UNION SELECT h.source, a.j, h.hops + 1 FROM h JOIN a ON a.i = h.id LEFT JOIN recurring.h o ON o.source = h.source AND o.id = a.j WHERE o.id IS NULL), x1 AS (SELECT source, max(hops) AS e FROM h GROUP BY 1),
t AS (SELECT p.i AS id, count(*) AS t FROM a p JOIN a q ON q.i = p.j JOIN a r ON r.i = q.j AND r.j = p.i GROUP BY 1), c AS (SELECT sum(CASE WHEN degree > 1 THEN coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END) AS c FROM d LEFT JOIN t USING (id)),
m AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges)
SELECT nodes, edges, (SELECT count(*) FROM z) AS components, (SELECT count(*) = 1 FROM z) AS is_connected, top.size AS largest, round(top.size / nodes, 6) AS share, (SELECT max(e) FROM x1)::BIGINT AS diameter, (SELECT min(e) FROM x1)::BIGINT AS radius,
round(c / nodes, 6) AS clustering, round(2.0::DOUBLE * edges / (nodes * (nodes - 1)), 6) AS density FROM m, top, c""")
def _(s, d):
    found = ds.report(edges(s, d), nodes(s, d))
    row = s.createDataFrame([found], "nodes long, edges long, components long, is_connected boolean, largest long, share double, diameter long, radius long, clustering double, density double")
    return row.select(*(r6(c).alias(c) if c in ("share", "clustering", "density") else c for c in row.columns))


@add("spectral_summary")
def _(s, d):
    """How a coarse level keeps the low spectrum: the ratio of its smallest eigenvalues to the fine graph's, both without zeros."""
    e, fine, c = it.checkpointed(edges(s, d)), nodes(s, d), assign(s, d)
    coarse = it.checkpointed(lv.coarse_edges(e, c))
    (n, before), (m, after) = sp.laplacian_spectrum(e, fine, 2), sp.laplacian_spectrum(coarse, c.select(F.col("cluster").alias("id")).distinct(), 2)
    rows = [(k, n, m, float(x), float(y), float(y / x)) for k, (x, y) in enumerate(zip(before.values, after.values))]
    return s.createDataFrame(rows, "k long, components long, coarse_components long, fine double, coarse double, ratio double")


PLANTED = f"SELECT a.i, b.i AS j, 1.0::DOUBLE AS w FROM range(140) a(i) JOIN range(140) b(i) ON a.i < b.i WHERE {u_sql('(a.i * 7919 + b.i)', 3)} < CASE WHEN a.i % 7 = b.i % 7 THEN 0.1 ELSE 0.01 END"


@add("gen_planted", PLANTED)
def _(s, d):
    return src.planted(s, 140, 7, 0.1, 0.01)


@add("gen_grid_periodic", "WITH t AS (SELECT r * 9 + c AS a, r * 9 + (c + 1) % 9 AS b FROM range(8) x(r), range(9) y(c) UNION SELECT r * 9 + c, (r + 1) % 8 * 9 + c FROM range(8) x(r), range(9) y(c)) SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j, 1.0::DOUBLE AS w FROM t")
def _(s, d):
    return src.grid(s, 8, 9, periodic=True)


@add("resistance_problem", f"{WITH} SELECT id, CASE WHEN id = (SELECT min(i) FROM e) THEN 1.0 WHEN id = (SELECT max(j) FROM e) THEN -1.0 ELSE 0.0 END::DOUBLE AS x FROM n")
def _(s, d):
    """Right-hand side between the first and the last node that have edges."""
    ends = edges(s, d).agg(F.min("i").alias("first"), F.max("j").alias("last"))
    return nodes(s, d).join(F.broadcast(ends)).select("id", F.when(F.col("id") == F.col("first"), 1.0).when(F.col("id") == F.col("last"), -1.0).otherwise(0.0).alias("x"))  # ends: one row
