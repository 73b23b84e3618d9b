"""Queries over multigrid parts, special functions and random variates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from latticework.functions import special as sp
from latticework.operators import amg
from latticework.operators import energies as en
from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.operators import levels as lv
from latticework.operators import multigrid as mg
from latticework.operators import relaxation as rx
from latticework.plans.common import Queries, r6
from latticework.plans.graphs import REACH, RECURSIVE, WITH, assign, edges, nodes, signal, u_sql
from latticework.plans.levels import TV
from latticework.sources.graphs import table

QUERIES = Queries()
add = QUERIES.add


@add("energy_flat", f"{WITH}, b AS (SELECT i AS id, sum(v * x) AS x FROM l JOIN x ON x.id = j GROUP BY 1) SELECT cluster AS id, round(sum(x) * 4 / 3, 6) + 0.0 AS x FROM b JOIN s USING (id) GROUP BY 1")
def _(s, d):
    b = g.times_vector(g.laplacian(edges(s, d)), signal(s, d))
    return mg.coarse_rhs(b, assign(s, d)).select("id", r6("x").alias("x"))


@add("energy_constant", f"{WITH} SELECT p.cluster AS i, q.cluster AS j, round(sum(v) * 0.75, 6) + 0.0 AS v FROM l JOIN s p ON p.id = i JOIN s q ON q.id = j GROUP BY 1, 2")
def _(s, d):
    return mg.scaled(g.galerkin(g.laplacian(edges(s, d)), assign(s, d)), 0.75).select("i", "j", r6("v").alias("v"))


@add("energy_flat_ls", f"""{WITH}, {TV}, t AS (SELECT id, cluster, c, x[c] AS x FROM tv JOIN s USING (id), unnest(range(1, 8)) AS u(c)), m AS (SELECT cluster, c, avg(x) AS x FROM t GROUP BY 1, 2),
f AS (SELECT p.c, sum(w * (p.x - q.x) ** 2) AS fine, sum(w * (pm.x - qm.x) ** 2) AS coarse FROM e JOIN t p ON p.id = i JOIN t q ON q.id = j AND q.c = p.c
  JOIN m pm ON pm.cluster = p.cluster AND pm.c = p.c JOIN m qm ON qm.cluster = q.cluster AND qm.c = p.c GROUP BY 1)
SELECT round(avg(coarse / fine), 6) AS factor FROM f WHERE fine > 0""")
def _(s, d):
    return mg.energy_factor(edges(s, d), assign(s, d), lv.long(lv.random_vectors(nodes(s, d)))).select(r6("factor").alias("factor"))


FITTED = f"""{WITH}, {TV}, ta AS (SELECT id, cluster, c, x[c] AS x FROM tv JOIN s USING (id), unnest(range(1, 8)) AS u(c)), ma AS (SELECT cluster, c, avg(x) AS x FROM ta GROUP BY 1, 2), mx AS (SELECT cluster, list(x ORDER BY c) AS x FROM ma GROUP BY 1),
ce AS (SELECT least(p.cluster, q.cluster) AS lo, greatest(p.cluster, q.cluster) AS hi, sum(w) AS w FROM e JOIN s p ON p.id = i JOIN s q ON q.id = j WHERE p.cluster <> q.cluster GROUP BY 1, 2),
fe AS (SELECT p.cluster AS id, p.c, sum(v * (p.x - q.x) ** 2) / 2 AS fine FROM a JOIN ta p ON p.id = i JOIN ta q ON q.id = j AND q.c = p.c GROUP BY 1, 2),
cc AS (SELECT lo AS i, hi AS j, w FROM ce UNION ALL SELECT hi, lo, w FROM ce), be AS (SELECT i AS id, p.c, sum(w * (p.x - q.x) ** 2) / 2 AS coarse FROM cc JOIN ma p ON p.cluster = i JOIN ma q ON q.cluster = j AND q.c = p.c GROUP BY 1, 2),
fb AS (SELECT id, c, fine, coalesce(coarse, 0) AS coarse FROM fe LEFT JOIN be USING (id, c)), nf AS (SELECT id, CASE WHEN sum(coarse ** 2) > 0 THEN sum(fine * coarse) / sum(coarse ** 2) ELSE 1 END AS factor FROM fb GROUP BY 1)"""
GREEDY = f"""{FITTED}, ct AS (SELECT lo, hi, w, list_transform(range(1, 8), lambda k: (p.x[k] - q.x[k]) * (p.x[k] - q.x[k])) AS a FROM ce JOIN mx p ON p.cluster = lo JOIN mx q ON q.cluster = hi),
ht AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY w DESC, lo, hi) AS nth FROM (SELECT lo AS e, * FROM ct UNION ALL SELECT hi, * FROM ct)) WHERE nth <= 4),
ft AS (SELECT i, j, w, sp.cluster AS ci, sq.cluster AS cj, list_transform(range(1, 8), lambda k: (p.x[k] - q.x[k]) * (p.x[k] - q.x[k])) AS b FROM e JOIN tv p ON p.id = i JOIN tv q ON q.id = j JOIN s sp ON sp.id = i JOIN s sq ON sq.id = j),
ca AS (SELECT i, j, ft.w, b, lo, hi, a FROM ft JOIN ht ON ht.e = ci OR ht.e = cj UNION SELECT i, j, ft.w, b, lo, hi, a FROM ft JOIN ct ON lo = least(ci, cj) AND hi = greatest(ci, cj)),
cs AS (SELECT *, list_inner_product(b, b) AS bb, list_inner_product(a, b) AS ab, list_inner_product(a, a) AS aa FROM ca), c1 AS (SELECT *, bb - ab * ab / aa AS rest FROM cs WHERE aa > 0 AND ab > 0),
f1 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY rest, lo, hi) = 1),
pr AS (SELECT c1.*, f1.ab AS fab, f1.aa AS faa, f1.rest AS frest, list_inner_product(f1.a, c1.a) AS x FROM c1 JOIN f1 USING (i, j) WHERE (c1.lo <> f1.lo OR c1.hi <> f1.hi) AND f1.rest > 1e-9 * c1.bb),
pd AS (SELECT *, (fab * aa - ab * x) / (faa * aa - x * x) AS p, (ab * faa - fab * x) / (faa * aa - x * x) AS q FROM pr WHERE faa * aa - x * x > 1e-9 * faa * aa),
s2 AS (SELECT *, bb - p * fab - q * ab AS least_rest FROM pd WHERE p > 0 AND q > 0 QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY bb - p * fab - q * ab, lo, hi) = 1), s3 AS (SELECT * FROM s2 WHERE least_rest < frest),
gt AS (SELECT f1.i, f1.j, f1.w, f1.lo, f1.hi, coalesce(s3.p, f1.ab / f1.aa) AS q FROM f1 LEFT JOIN s3 ON s3.i = f1.i AND s3.j = f1.j UNION ALL SELECT i, j, w, lo, hi, q FROM s3)"""


@add("energy_adaptive", f"{FITTED} SELECT id, (c - 1)::INT AS c, round(CASE WHEN coarse > 0 THEN fine / coarse END, 6) AS factor FROM fb")
def _(s, d):
    """A factor for each cluster and vector."""
    return en.adaptive(edges(s, d), lv.random_vectors(nodes(s, d)), assign(s, d)).select("id", F.col("c").cast("int").alias("c"), r6("factor").alias("factor"))


@add("energy_nodal_ls", f"{FITTED} SELECT lo AS i, hi AS j, round(w * (p.factor + q.factor) / 2, 6) AS w FROM ce JOIN nf p ON p.id = lo JOIN nf q ON q.id = hi")
def _(s, d):
    """Coarse edges with weights fitted by clusters."""
    return en.nodal_edges(edges(s, d), lv.random_vectors(nodes(s, d)), assign(s, d)).select("i", "j", r6("w").alias("w"))


@add("energy_greedy_ls", f"{GREEDY} SELECT lo AS i, hi AS j, count(*) AS terms, round(sum(w * q), 6) AS w FROM gt GROUP BY 1, 2")
def _(s, d):
    """Coarse edges with weights fitted fine edge by fine edge."""
    found = en.greedy_terms(edges(s, d), lv.random_vectors(nodes(s, d)), assign(s, d))
    return found.groupBy(F.col("lo").alias("i"), F.col("hi").alias("j")).agg(F.count("*").alias("terms"), r6(F.sum(F.col("w") * F.col("q"))).alias("w"))


COLOURS = f"""o AS (SELECT id, row_number() OVER (ORDER BY {u_sql('id', 5)} DESC, id) AS p FROM n), nb AS (SELECT f.p, list(t.p) AS nb FROM a JOIN o f ON f.id = i JOIN o t ON t.id = j WHERE t.p < f.p GROUP BY 1),
om AS (SELECT list(coalesce(nb, []) ORDER BY o.p) AS nb, count(*) AS n FROM o LEFT JOIN nb USING (p)),
cl AS (SELECT []::BIGINT[] AS c FROM om UNION ALL SELECT list_append(c, list_filter(range(0, len(nb[len(c) + 1]) + 1), lambda k: NOT list_contains(list_transform(nb[len(c) + 1], lambda q: c[q]), k))[1]) FROM cl, om WHERE len(c) < n),
co AS (SELECT id, c[p] AS colour FROM o, (SELECT c FROM cl ORDER BY len(c) DESC LIMIT 1))"""


@add("graph_colouring", f"{RECURSIVE}, {COLOURS} SELECT id, colour::INT AS colour FROM co")
def _(s, d):
    """SQL colours the nodes one by one."""
    return rx.colouring(it.checkpointed(edges(s, d)), nodes(s, d))


@add("coloured_gauss_seidel", f"""{RECURSIVE}, {COLOURS}, y AS (SELECT x.id, x, row_number() OVER (ORDER BY colour, x.id) AS p FROM x JOIN co USING (id)),
gn AS (SELECT f.p, list({{'w': v, 'q': t.p}}) AS nb, sum(v) AS d FROM a JOIN y f ON f.id = i JOIN y t ON t.id = j GROUP BY 1), gm AS (SELECT list(nb ORDER BY y.p) AS nb, list(d ORDER BY y.p) AS d, count(*) AS n FROM y LEFT JOIN gn USING (p)),
gs AS (SELECT 0 AS step, list(x ORDER BY p) AS x FROM y UNION ALL SELECT step + 1, list_concat(list_concat(x[1:step], [CASE WHEN d[step + 1] IS NULL THEN x[step + 1] ELSE (1 + list_sum(list_transform(nb[step + 1], lambda t: t.w * x[t.q]))) / d[step + 1] END]), x[step + 2:]) FROM gs, gm WHERE step < n)
SELECT id, round(z.x[p], 6) + 0.0 AS x FROM y, (SELECT x FROM gs ORDER BY step DESC LIMIT 1) z""")
def _(s, d):
    """One sweep; SQL moves the nodes one by one, by colour and id."""
    e, b = it.checkpointed(edges(s, d)), nodes(s, d).select("id", F.lit(1.0).alias("x"))
    return rx.gauss_seidel(e, rx.colouring(e, nodes(s, d)), signal(s, d), b).select("id", r6("x").alias("x"))


@add("aggregation_sweep")
def _(s, d):
    """Who joins whom in which round, over the part graph with hashed test vectors."""
    e, x = it.checkpointed(edges(s, d)), it.checkpointed(lv.test_vectors(edges(s, d), nodes(s, d), 4))
    return amg.assignment(amg.sweep_stage(amg.start_sweep(e, nodes(s, d), x), 4))


@add("amg_setup")
def _(s, d):
    """A row for each level of the part graph: how it came about, its size, its filter's rate, alpha and beta, and nodes, edges and work so far by the finest's."""
    found = amg.setup(it.checkpointed(edges(s, d)), nodes(s, d))
    rows = [(k, x.kind, x.size, x.links, x.rate, x.alpha, x.beta, x.stage, *amg.complexities(found[: k + 1])) for k, x in enumerate(found)]
    return s.createDataFrame(rows, "level int, kind string, nodes long, edges long, rate double, alpha double, beta double, stage int, node_complexity double, edge_complexity double, work double")


@add("pcg_solve", f"{RECURSIVE}, {REACH}, y AS (SELECT id, {u_sql('id', 12)} AS y FROM n) SELECT id, round(y - avg(y) OVER (PARTITION BY component), 6) + 0.0 AS x FROM y JOIN k USING (id)")
def _(s, d):
    """Right-hand side L y for hashed numbers y, solved by gradients with multigrid cycles; of the solutions, that without means over components."""
    e = it.checkpointed(edges(s, d))
    y = nodes(s, d).select("id", g.uniform(F.col("id"), 12).alias("x"))
    b = nodes(s, d).join(g.times_vector(g.laplacian(e), y), "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"))
    x, _ = amg.Solver(amg.setup(e, nodes(s, d), most=2)).solve(it.checkpointed(b), 1e-11)
    x = x.join(it.connected_components(e, nodes(s, d)), "id")
    return x.join(x.groupBy("component").agg(F.avg("x").alias("m")), "component").select("id", r6(F.col("x") - F.col("m")).alias("x"))


@add("random_rhs", f"{RECURSIVE}, {REACH}, u AS (SELECT id, {u_sql('id', 9)} AS u FROM n) SELECT id, round(u - avg(u) OVER (PARTITION BY component), 6) + 0.0 AS x FROM u JOIN k USING (id)")
def _(s, d):
    """Random right-hand side, without the null space of each component."""
    u = it.connected_components(edges(s, d), nodes(s, d)).withColumn("u", g.uniform(F.col("id"), 9))
    mean = u.groupBy("component").agg(F.avg("u").alias("m"))
    return u.join(mean, "component").select("id", r6(F.col("u") - F.col("m")).alias("x"))


@add("restricted_eigenspace")
def _(s, d):
    found = mg.restricted_eigenspace(g.laplacian(edges(s, d)), lv.random_vectors(nodes(s, d), 4), 4)
    return s.createDataFrame([(k, float(x)) for k, x in enumerate(found)], "k long, value double")


@add("kmeans")
def _(s, d):
    x = table(s, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return mg.kmeans(x, 8)


@add("gamma_functions", """WITH q AS (SELECT DISTINCT l_quantity::BIGINT AS q FROM lineitem), h AS (SELECT q, coalesce(sum(1.0::DOUBLE / k), 0) AS h1, coalesce(sum(1.0::DOUBLE / k ** 2), 0) AS h2, coalesce(sum(1.0::DOUBLE / k ** 3), 0) AS h3 FROM q LEFT JOIN range(1, 100) t(k) ON k < q GROUP BY 1)
SELECT q, round(lgamma(q::DOUBLE), 6) + 0.0 AS gammaln, round(h1 - 0.5772156649015329, 6) AS digamma, round(pi() ** 2 / 6 - h2, 6) AS trigamma, round(2 * h3 - 2 * 1.2020569031595942, 6) AS tetragamma FROM h""")
def _(s, d):
    """At whole numbers, where SQL has the sums of reciprocals."""
    q = table(s, d, "lineitem").select(F.col("l_quantity").cast("long").alias("q")).distinct()
    x = F.col("q").cast("double")
    return q.select("q", *(r6(f(x)).alias(f.__name__) for f in (sp.gammaln, sp.digamma, sp.trigamma, sp.tetragamma)))


@add("normal_cdf", """WITH q AS (SELECT DISTINCT l_quantity::BIGINT AS q, (l_quantity::DOUBLE - 25) / 5 AS x FROM lineitem)
SELECT q, round(0.5 + sum(CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (x * k / 400) * (x * k / 400))) * x / 1200 / sqrt(2 * pi()), 6) AS p FROM q, range(0, 401) t(k) GROUP BY q, x""")
def _(s, d):
    """SQL integrates the density by Simpson's rule."""
    q = table(s, d, "lineitem").select(F.col("l_quantity").cast("long").alias("q"), ((F.col("l_quantity").cast("double") - 25) / 5).alias("x")).distinct()
    return q.select("q", r6(sp.normal_cdf(F.col("x"))).alias("p"))


_POISSON = [sum(math.exp(i * math.log(2.5) - 2.5 - math.lgamma(i + 1)) for i in range(k + 1)) for k in range(60)]


@add("random_variates", f"""{WITH}, u AS (SELECT id, {', '.join(f'{u_sql("id", c)} AS u{c}' for c in range(20, 30))} FROM n),
v AS (SELECT *, -ln(1 - u22) - ln(1 - u23) AS g2, -ln(1 - u24) - ln(1 - u25) - ln(1 - u26) AS g3 FROM u)
SELECT id, round(sqrt(-2 * ln(1 - u20)) * cos(2 * pi() * u21), 6) + 0.0 AS normal, round(g2, 6) AS gamma, round(g2 / (g2 + g3), 6) AS beta, ((u20 < 0.3)::INT + (u21 < 0.3)::INT + (u22 < 0.3)::INT + (u23 < 0.3)::INT) AS binomial,
CASE WHEN u27 < 0.5 THEN 0 WHEN u27 < 0.8 THEN 1 ELSE 2 END AS class, len(list_filter({_POISSON}, lambda p: p <= u28)) AS poisson FROM v""")
def _(s, d):
    """From uniform numbers by node: normal, gamma, beta, binomial, categorical and Poisson."""
    u = {c: F.col(f"u{c}") for c in range(20, 30)}
    rows = nodes(s, d).select("id", *(g.uniform(F.col("id"), c).alias(f"u{c}") for c in u))
    two, three = sp.gamma([u[22], u[23]]), sp.gamma([u[24], u[25], u[26]])
    return rows.select(
        "id",
        r6(sp.normal(u[20], u[21])).alias("normal"),
        r6(two).alias("gamma"),
        r6(two / (two + three)).alias("beta"),
        sp.binomial([u[c] for c in range(20, 24)], 0.3).alias("binomial"),
        sp.categorical(u[27], (5, 3, 2)).alias("class"),
        sp.poisson(u[28], 2.5).cast("long").alias("poisson"),
    )
