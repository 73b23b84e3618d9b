"""Scans and sinks as queries: the graph of parts is written in a text format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.operators import graph as g
from latticework.operators import iterative as it
from latticework.plans.common import Queries
from latticework.plans.graphs import WITH, assign, edges, nodes
from latticework.sources import catalogue as cat
from latticework.sources import graphs as src
from latticework.streaming import edges as stream

QUERIES = Queries()
add = QUERIES.add


@add("scan_mtx_graph", f"{WITH} SELECT i, j, w FROM e")
def _(s, d):
    at = it.scratch(s, "mtx")
    n = nodes(s, d).agg(F.max("id") + 1).first()[0]
    src.write_matrix_market(g.laplacian(edges(s, d)), at, n, n)
    return g.adjacency(src.read_matrix_market(s, at))


@add("scan_mtx_projection", f"{WITH} SELECT cluster AS i, id AS j, 1.0::DOUBLE AS v FROM s")
def _(s, d):
    at = it.scratch(s, "projection")
    n = nodes(s, d).agg(F.max("id") + 1).first()[0]
    src.write_matrix_market(assign(s, d).select(F.col("cluster").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), at, 16, n)
    return src.read_matrix_market(s, at)


@add("scan_dimacs", f"{WITH} SELECT i, j, w FROM e")
def _(s, d):
    at = it.scratch(s, "dimacs")
    edges(s, d).select(F.format_string("e %d %d %s", F.col("i") + 1, F.col("j") + 1, F.col("w").cast("string"))).write.text(at)
    return src.read_dimacs(s, at)


@add("scan_compressed_column", f"{WITH} SELECT i, j, v FROM l")
def _(s, d):
    at = it.scratch(s, "columns")
    g.laplacian(edges(s, d)).select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v").cast("string"))).write.text(at)
    return src.read_compressed_column(s, at)


@add("scan_node_link", f"{WITH} SELECT i, j, 1.0::DOUBLE AS w FROM e")
def _(s, d):
    """A node-link document is one JSON value, so its graph is one row: for graphs that fit one."""
    at = it.scratch(s, "links")
    links = edges(s, d).agg(F.collect_list(F.struct(F.col("i").alias("source"), F.col("j").alias("target"))).alias("links"))
    ends = edges(s, d).select(F.explode(F.array("i", "j")).alias("id")).distinct().agg(F.collect_list(F.struct("id", F.lit(False).alias("val"), F.lit(False).alias("test"))).alias("nodes"))
    links.join(F.broadcast(ends)).select(F.to_json(F.struct("nodes", "links"))).coalesce(1).write.text(at)  # one row each
    return src.read_node_link(s, at)[1]


@add("scan_coordinates", "SELECT p_partkey AS id, (p_partkey % 10)::DOUBLE AS x, p_size::DOUBLE AS y FROM part")
def _(s, d):
    at = it.scratch(s, "plain")
    part = src.table(s, d, "part")
    part.select(F.concat_ws(" ", F.lit("node"), "p_partkey", F.col("p_partkey") % 10, "p_size", F.lit("0.5 0.5 label"))).write.text(at)
    return src.read_coordinates(s, at)


@add("scan_scalar", "SELECT (count(*) - 1)::BIGINT AS value FROM region")
def _(s, d):
    """Levels: the number in the file's first line less one."""
    at = it.scratch(s, "scalar")
    src.table(s, d, "region").agg(F.count("*").cast("string")).write.text(at)
    return s.read.text(at).where("trim(value) <> ''").select((F.trim("value").cast("bigint") - 1).alias("value"))


@add("sink_dot", f"{WITH} SELECT printf('  %d -- %d [weight=%.1f];', i, j, w) AS value FROM e UNION ALL SELECT 'graph {{' UNION ALL SELECT '}}'")
def _(s, d):
    at = it.scratch(s, "dot")
    src.write_dot(edges(s, d), at)
    return s.read.text(at)


@add("sink_report", "SELECT p_brand, count(*)::VARCHAR AS n FROM part GROUP BY 1")
def _(s, d):
    at = it.scratch(s, "report")
    src.write_report(src.table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")), at)
    return s.read.csv(at, header=True)


@add("read_by_extension", f"{WITH} SELECT i, j, w FROM e WHERE i % 2 = 0")
def _(s, d):
    """The reader is chosen by the path's ending."""
    at = it.scratch(s, "graph") + ".dimacs"
    edges(s, d).where("i % 2 = 0").select(F.format_string("e %d %d %s", F.col("i") + 1, F.col("j") + 1, F.col("w").cast("string"))).write.text(at)
    return src.read_graph(s, at)


@add("stream_edge_weights", "SELECT user_id AS i, event_type AS j, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS w FROM events GROUP BY 1, 2, 3")
def _(s, d):
    """Edge weights kept up by a stream of events, after all of them have come."""
    found = stream.after_all(s, f"{d}/events.parquet", it.scratch(s, "stream"))
    return found.select("i", "j", "day", "n", F.round("w", 4).alias("w"))


@add("scan_mtx_tolerant", f"{WITH} SELECT i, j, CASE WHEN least(i, j) % 3 = 0 THEN 1 ELSE v END AS v FROM a")
def _(s, d):
    """A symmetric file with comments, blank and broken lines, ragged blanks and missing values."""
    at = it.scratch(s, "tolerant") + ".mtx"
    tab = F.lit("\t")
    entry = F.when(F.col("i") % 3 == 0, F.concat(F.lit("  "), F.col("j") + 1, tab, F.col("i") + 1)).otherwise(F.concat_ws("  ", F.col("j") + 1, F.col("i") + 1, F.col("w").cast("string")))
    body = edges(s, d).select(F.lit(2).alias("n"), F.explode(F.array(entry, F.when(F.col("i") % 5 == 0, "% note").when(F.col("i") % 7 == 0, "").when(F.col("i") % 11 == 0, "x y 1.0").otherwise("  "))).alias("value"))
    head = s.createDataFrame([(0, "%%MatrixMarket matrix coordinate real symmetric"), (1, "% comment")], "n int, value string")
    size = nodes(s, d).agg(F.max("id") + 1).first()[0]
    sizes = edges(s, d).agg(F.lit(1).alias("n"), F.format_string(f"{size} {size} %d", F.count("*")).alias("value"))
    head.unionByName(sizes).unionByName(body).orderBy("n").select("value").coalesce(1).write.text(at)
    return src.read_matrix_market(s, at)


@add("scan_results_broken", """SELECT l_orderkey AS k, CASE WHEN l_linenumber <> 4 THEN l_linenumber END::INT AS line, CASE WHEN l_linenumber IN (1, 2) THEN l_tax END::DOUBLE AS seconds,
CASE l_linenumber WHEN 3 THEN 'missing' WHEN 4 THEN 'broken' WHEN 5 THEN 'failed' WHEN 6 THEN 'timeout' WHEN 7 THEN 'broken' ELSE 'ok' END AS state FROM lineitem""")
def _(s, d):
    """Lines of results with FAILED, TIMEOUT, missing and unreadable values, and lines cut short."""
    at = it.scratch(s, "results")
    value = F.expr("CASE l_linenumber WHEN 3 THEN '' WHEN 5 THEN 'FAILED' WHEN 6 THEN ' timeout ' WHEN 7 THEN '1.2.3' ELSE string(double(l_tax)) END")
    line = F.when(F.col("l_linenumber") == 4, F.col("l_orderkey").cast("string")).otherwise(F.concat_ws(",", "l_orderkey", "l_linenumber", value))
    src.table(s, d, "lineitem").select(line).write.text(at)
    return cat.read_results(s, at, "k long, line int", "seconds")


def _files(s, d):
    """The graph of parts as nine files of three formats, by i % 9."""
    at = it.scratch(s, "catalogue")
    e = it.checkpointed(edges(s, d)).withColumn("g", F.concat(F.lit("graph-"), F.col("i") % 9))
    e.where("i % 3 = 0").repartition("g").select("g", F.format_string("a %d %d %s", F.col("i") + 1, F.col("j") + 1, F.col("w").cast("string"))).write.partitionBy("g").text(f"{at}/dimacs")
    entry = lambda a, b: F.concat_ws(" ", F.col(a) + 1, F.col(b) + 1, (-F.col("w")).cast("string"))
    e.where("i % 3 = 1").repartition("g").select("g", entry("i", "j")).write.partitionBy("g").text(f"{at}/cc")
    body = e.where("i % 3 = 2").select("g", F.lit(1).alias("n"), entry("j", "i").alias("value"))
    heads = body.select("g").distinct().select("g", F.explode(F.array(*(F.struct(F.lit(0).alias("n"), F.lit(v).alias("value")) for v in ("%%MatrixMarket matrix coordinate real symmetric", "9 9 9")))).alias("h")).select("g", "h.*")
    heads.unionByName(body).repartition("g").sortWithinPartitions("g", "n", F.when(F.col("value").startswith("%"), 0).otherwise(1)).select("g", "value").write.partitionBy("g").text(f"{at}/mtx")
    return cat.catalogue(s, at, {r"/dimacs/.*\.txt$": "dimacs", r"/cc/.*\.txt$": "cc", r"/mtx/.*\.txt$": "mtx"})


@add("batch_read", f"{WITH} SELECT 'graph-' || (i % 9) AS graph, i, j, w FROM e")
def _(s, d):
    """All files of a catalogue as one table of edges."""
    return cat.read_all(_files(s, d)).select(F.regexp_extract("key", "graph-[0-9]", 0).alias("graph"), "i", "j", "w")


@add("batch_run", f"""{WITH}, g AS (SELECT i % 9 AS g, count(*) AS edges, sum(w) AS weight FROM e GROUP BY 1), k AS (SELECT g, count(DISTINCT id) AS nodes FROM (SELECT i % 9 AS g, i AS id FROM e UNION ALL SELECT i % 9, j FROM e) GROUP BY 1)
SELECT 'graph-' || g AS graph, nodes, edges, weight, CASE WHEN g < 4 THEN 'first' ELSE 'second' END AS run FROM g JOIN k USING (g)""")
def _(s, d):
    """Four graphs by a first run, the other five by a second one over all of them."""
    files, at = it.checkpointed(_files(s, d)), it.scratch(s, "runs")
    cat.run(files.where("key rlike 'graph-[0-3]'"), at, cat.statistics, label="first")
    cat.run(files, at, cat.statistics, at_once=3, label="second")
    return cat.finished(s, at).select(F.regexp_extract("key", "graph-[0-9]", 0).alias("graph"), "nodes", "edges", "weight", "run")


@add("graphs_by_edge_count", f"{WITH}, c AS (SELECT i % 40 AS g, count(*) AS n FROM e GROUP BY 1) SELECT g AS key, i, j, w FROM e JOIN c ON g = i % 40 WHERE n BETWEEN 40 AND 60")
def _(s, d):
    """Of the graphs by i % 40, those of 40 to 60 edges."""
    return cat.with_edges_between(it.checkpointed(edges(s, d)).select((F.col("i") % 40).alias("key"), "i", "j", "w"), 40, 60)
