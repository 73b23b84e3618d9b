"""Queries for summaries of runs, losses, ranks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.functions.logarithms import log10
from latticework.plans.analytics import R_SQL, runs
from latticework.plans.common import Queries, rounded, same
from latticework.sources.graphs import table

QUERIES = Queries()
add = QUERIES.add


def both(name: str, sql: str) -> None:
    """A query over the table ``r`` of runs that reads the same in both engines."""
    QUERIES[name] = (lambda s, d: s.sql(sql.replace("FROM r ", "FROM {r} "), r=runs(s, d)), f"{R_SQL} {sql}")


both("stability_summary", "SELECT method, dataset, count(*) AS n, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std, round(max(accuracy) - min(accuracy), 6) AS spread FROM r WHERE method IS NOT NULL GROUP BY method, dataset HAVING count(*) >= 3")
both("multilevel_summary", "SELECT level, count(*) AS n, round(avg(accuracy), 6) AS accuracy, round(avg(nodes), 6) AS nodes, max(seconds) AS slowest FROM r WHERE method <> 'N' GROUP BY level")
both("affinity_connection", "SELECT DISTINCT accuracy, CASE WHEN accuracy = 1 THEN CAST('Infinity' AS DOUBLE) ELSE round(1 / (1 - accuracy), 6) END AS connection FROM r ")
both("softplus_losses", "SELECT method, round(sum(ln(1 + exp(-10 * accuracy)) + ln(1 + exp(accuracy - 1))), 4) AS xent FROM r GROUP BY method")
both("range_predicates", "SELECT method, count(CASE WHEN nodes BETWEEN 10 AND 20 THEN 1 END) AS in_range, count(CASE WHEN accuracy > 0 THEN 1 END) AS positive, count(CASE WHEN seconds = floor(seconds) THEN 1 END) AS integral FROM r GROUP BY method")
both("special_functions", "SELECT DISTINCT accuracy, round(x * x * (3 - 2 * x), 6) AS smoothstep, round(exp(-x * x / 2) / sqrt(2 * pi()), 6) AS normpdf, round(-x * x / 2 - ln(2 * pi()) / 2, 6) AS lognormpdf, round(CASE WHEN x = 0 THEN 1e0 ELSE sin(pi() * x) / (pi() * x) END, 6) AS sinc, round(1 / (1 + exp(-x)), 6) AS sigmoid FROM (SELECT accuracy, accuracy * 5 AS x FROM r ) AS t")


@add("normalised_time", f"{R_SQL} SELECT run, CASE WHEN accuracy = 0 THEN CAST('Infinity' AS DOUBLE) ELSE round(seconds / log10(nodes / accuracy + 2), 4) END AS t FROM r WHERE nodes > 0")
def _(s, d):
    """The JVM's logarithm differs from the C library's in the last bit here and there, and its ``round`` goes by decimal text: near a tie either shows."""
    lasting = F.col("nodes") / F.when(F.col("accuracy") != 0, F.col("accuracy")) + 2  # null in place of a division by zero
    t = runs(s, d).where("nodes > 0").select("run", "accuracy", (F.col("seconds") / log10(lasting)).alias("t"))
    return t.select("run", F.when(F.col("accuracy") == 0, float("inf")).otherwise(rounded(F.col("t"), 4)).alias("t"))


@add("xent_loss", "SELECT l_returnflag AS method, round(sum(ln(1 + exp(-10 * l_discount)) + ln(1 + exp(10 * l_tax))), 4) AS loss FROM lineitem GROUP BY 1")
def _(s, d):
    soft = lambda x: F.log1p(F.exp(x))
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.round(F.sum(soft(-10 * F.col("l_discount")) + soft(10 * F.col("l_tax"))), 4).alias("loss"))


@add("hinge_loss", "SELECT l_returnflag AS method, round(sum(greatest(0, l_tax - (l_discount - 0.1))), 6) AS loss FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.round(F.sum(F.greatest(F.lit(0.0), F.col("l_tax") - (F.col("l_discount") - F.lit(0.1)))), 6).alias("loss"))


@add("skipgram_loss", "SELECT l_orderkey AS k, round(max(l_discount) - ln(sum(exp(l_tax))), 6) AS loss FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.max("l_discount") - F.log(F.sum(F.exp("l_tax"))), 6).alias("loss"))


@add("mrr", """WITH t AS (SELECT l_orderkey AS k, max(l_discount) AS true_score FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
k AS (SELECT t.k, 1 + count(CASE WHEN l.l_linenumber > 2 AND l.l_discount > true_score THEN 1 END) AS place FROM t JOIN lineitem l ON l.l_orderkey = t.k GROUP BY 1) SELECT count(*) AS n, round(avg(1.0 / place), 6) AS mrr FROM k""")
def _(s, d):
    """Mean reciprocal rank of the best of an order's first lines among its others."""
    true = F.max(F.when(F.col("l_linenumber") <= 2, F.col("l_discount")))
    per = table(s, d, "lineitem").groupBy("l_orderkey").agg(true.alias("t"), F.collect_list(F.when(F.col("l_linenumber") > 2, F.col("l_discount"))).alias("others")).where("t is not null")
    return per.agg(F.count("*").alias("n"), F.round(F.avg(1 / (1 + F.size(F.filter("others", lambda x: x > F.col("t"))))), 6).alias("mrr"))


@add("logger_stats", "WITH b AS (SELECT l_suppkey AS run, max(l_discount) AS valid, arg_max(l_tax, (l_discount, -l_orderkey, -l_linenumber, l_tax)) AS test FROM lineitem GROUP BY 1) SELECT count(*) AS runs, round(100 * avg(valid), 4) AS valid, round(100 * avg(test), 4) AS test, round(100 * stddev_samp(test), 4) AS std FROM b")
def _(s, d):
    """Test score at the epoch of the best validation score of each run, then mean and deviation over runs."""
    at = F.struct("l_discount", -F.col("l_orderkey"), -F.col("l_linenumber"), "l_tax")
    best = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_discount").alias("valid"), F.max_by("l_tax", at).alias("test"))
    return best.agg(F.count("*").alias("runs"), F.round(100 * F.avg("valid"), 4).alias("valid"), F.round(100 * F.avg("test"), 4).alias("test"), F.round(100 * F.stddev_samp("test"), 4).alias("std"))


@add("ema", """WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, round(sum(value * CASE WHEN k = 1 THEN power(0.99, n - 1) ELSE 0.01 * power(0.99, n - k) END), 4) AS ema FROM k GROUP BY 1""")
def _(s, d):
    """Exponential moving average at the last event, in closed form."""
    return s.sql("""SELECT user_id, round(sum(value * CASE WHEN k = 1 THEN power(0.99D, n - 1) ELSE 0.01D * power(0.99D, n - k) END), 4) AS ema
      FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM {e} WHERE value IS NOT NULL) GROUP BY user_id""", e=table(s, d, "events"))


@add("ema_series", """WITH k AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL)
SELECT user_id, event_id, round(sum(value * CASE WHEN k = 1 THEN 1 ELSE 0.01 END * power(0.99, -k)) OVER (PARTITION BY user_id ORDER BY k) * power(0.99, k), 4) AS ema FROM k""")
def _(s, d):
    """The running average at every event, places from 1 as in SQL, whose sums of few terms it equals to the bit: within blocks of 1,000 events by a window sum of weights that stay in range, plus what the four blocks before leave (older ones weigh less than 0.99^4000)."""
    e = table(s, d, "events").where("value is not null")
    k = e.select("user_id", "event_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("k"))
    block = F.floor((F.col("k") - 1) / 1000)
    k = k.select("user_id", "event_id", block.alias("block"), (F.col("k") - block * 1000).alias("p"), (F.col("value").cast("double") * F.when(F.col("k") == 1, 1.0).otherwise(0.01)).alias("v"))
    power = lambda c: F.pow(F.lit(0.99), c)
    whole = k.groupBy("user_id", "block").agg(F.sum(F.col("v") * power(1000 - F.col("p"))).alias("s"))
    before = F.array(*(F.lag("s", b, 0.0).over(Window.partitionBy("user_id").orderBy("block")) * 0.99 ** (1000 * (b - 1)) for b in (1, 2, 3, 4)))
    left = whole.select("user_id", "block", F.aggregate(before, F.lit(0.0), lambda a, b: a + b).alias("left"))
    inside = F.sum(F.col("v") * power(-F.col("p"))).over(Window.partitionBy("user_id", "block").orderBy("p")) * power(F.col("p"))
    return k.withColumn("inside", inside).join(left, ["user_id", "block"]).select("user_id", "event_id", rounded(F.col("inside") + F.col("left") * power(F.col("p")), 4).alias("ema"))


@add("cumprod_cycle", "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, round(exp(sum(ln(1 + l_discount)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_discount)), 6) AS product FROM lineitem")
def _(s, d):
    """Cumulative products by sums of logarithms."""
    return s.sql("SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, round(exp(sum(ln(1 + l_discount)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_discount)), 6) AS product FROM {l}", l=table(s, d, "lineitem"))


@add("hierarchy_complexity", "SELECT l_orderkey AS k, floor(sum(l_quantity) / max_by(l_quantity, (-l_linenumber, l_quantity)) * 10000 + 0.5) / 10000 AS nodes, floor(sum(l_quantity * power(1.5, l_linenumber - 1)) / max_by(l_quantity, (-l_linenumber, l_quantity)) * 10000 + 0.5) / 10000 AS cycle FROM lineitem GROUP BY 1")
def _(s, d):
    """Nodes of all levels, plain and weighted by visits, over those of the finest: an order is a hierarchy, its lines are levels."""
    finest = F.max_by("l_quantity", F.struct(-F.col("l_linenumber"), "l_quantity"))
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(same(F.sum("l_quantity") / finest, 4).alias("nodes"), same(F.sum(F.col("l_quantity") * F.pow(F.lit(1.5), F.col("l_linenumber") - 1)) / finest, 4).alias("cycle"))


@add("reduction_per_iter", "SELECT user_id, count(*) AS n, round(power(arg_max(value, (ts, event_id)) / arg_min(value, (ts, event_id)), 1.0 / count(*)), 4) AS reduction FROM events WHERE value > 0 GROUP BY 1")
def _(s, d):
    at = F.struct("ts", "event_id")
    e = table(s, d, "events").where("value > 0").groupBy("user_id").agg(F.count("*").alias("n"), (F.max_by("value", at) / F.min_by("value", at)).alias("q"))
    return e.select("user_id", "n", F.round(F.pow("q", 1 / F.col("n")), 4).alias("reduction"))


@add("split_take", "SELECT vec_id, label FROM embeddings WHERE vec_id % 10 >= 8 ORDER BY vec_id LIMIT 100")
def _(s, d):
    """The first test ids: a fixed number, as the operator has it."""
    return table(s, d, "embeddings").where("vec_id % 10 >= 8").select("vec_id", "label").orderBy("vec_id").limit(100)


@add("cross_validate", "SELECT a.id, a.n AS first, b.n AS second, a.n = b.n AS agrees FROM (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a JOIN (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) b ON a.id = b.id")
def _(s, d):
    """Values of two result sets for the ids that both have."""
    o = table(s, d, "orders")
    of = lambda k, name: o.where(F.col("o_orderkey") % k == 0).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias(name))
    return of(2, "first").join(of(3, "second"), "id").withColumn("agrees", F.col("first") == F.col("second"))


@add("agreement_ratio", "SELECT round(avg(CASE WHEN (o_orderkey % 2 = 0) = (o_custkey % 2 = 0) THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM orders")
def _(s, d):
    return table(s, d, "orders").agg(F.round(F.avg(((F.col("o_orderkey") % 2 == 0) == (F.col("o_custkey") % 2 == 0)).cast("double")), 6).alias("ratio"))


@add("integer_functions", "SELECT p_partkey AS id, p_partkey // 7 AS floordiv, ceil(p_partkey / 7.0)::BIGINT AS ceildiv, bin(p_partkey) AS base2, length(p_partkey::VARCHAR)::INT AS digits, (p_partkey % 10)::BIGINT AS sub1, (p_partkey // 10 % 10)::BIGINT AS sub2, (p_partkey * (p_partkey - 1) // 2)::BIGINT AS choose2 FROM part")
def _(s, d):
    p = F.col("p_partkey")
    ten = F.floor(p / 10)
    return table(s, d, "part").select(
        p.alias("id"), F.floor(p / 7).alias("floordiv"), F.ceil(p / 7).alias("ceildiv"), F.bin(p).alias("base2"), F.length(p.cast("string")).alias("digits"), (p % 10).alias("sub1"), (ten % 10).alias("sub2"), F.floor(p * (p - 1) / 2).alias("choose2")
    )


@add("string_functions", "SELECT p_partkey AS id, regexp_full_match(p_name, 'c.*d.*') AS globbed, len(regexp_extract_all(p_name, 'o'))::INT AS found, concat_ws('-', p_brand, p_type) AS joined, regexp_matches(p_type, '^(ECONOMY|PROMO)$') AS listed, printf('%05d', p_size) AS padded FROM part")
def _(s, d):
    """Glob, find all, join with a delimiter, match against a list, format."""
    return table(s, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").rlike("^(?:c.*d.*)$").alias("globbed"), F.size(F.regexp_extract_all("p_name", F.lit("o"), 0)).alias("found"), F.concat_ws("-", "p_brand", "p_type").alias("joined"),
        F.col("p_type").rlike("^(ECONOMY|PROMO)$").alias("listed"), F.format_string("%05d", "p_size").alias("padded"),
    )


@add("json_fields", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"type\":\"' || event_type || '\"}' AS again FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"))).alias("again"))


@add("results_report", f"{R_SQL} SELECT '| ' || method || ' | ' || n || ' | ' || printf('%.3f', best) || ' |' AS line FROM (SELECT method, count(*) AS n, max(accuracy) AS best FROM r GROUP BY 1)")
def _(s, d):
    """Lines of a text table."""
    r = runs(s, d).groupBy("method").agg(F.count("*").alias("n"), F.max("accuracy").alias("best"))
    return r.select(F.format_string("| %s | %d | %.3f |", "method", "n", "best").alias("line"))


@add("conv_factor", "SELECT user_id, event_id, floor(value / lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10000 + 0.5) / 10000 AS factor FROM events WHERE value > 0")
def _(s, d):
    """Quotient of consecutive values; halves go up in both engines."""
    from pyspark.sql.window import Window

    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(s, d, "events").where("value > 0").select("user_id", "event_id", same(F.col("value") / before, 4).alias("factor"))
