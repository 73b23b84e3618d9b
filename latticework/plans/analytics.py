"""Reporting queries over a table of experiment runs, for which ``lineitem`` stands in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.plans.common import Queries, r6
from latticework.sources.graphs import table

QUERIES = Queries()
add = QUERIES.add

R_SQL = """WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS run, l_returnflag AS method, l_linestatus AS dataset, l_linenumber AS level,
  l_discount AS accuracy, l_extendedprice AS seconds, l_quantity AS nodes FROM lineitem)"""


def runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("run"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("dataset"), F.col("l_linenumber").alias("level"),
        F.col("l_discount").alias("accuracy"), F.col("l_extendedprice").alias("seconds"), F.col("l_quantity").alias("nodes"),
    )


def both(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """A query that reads the same in both engines; ``r`` is the table of runs."""

    def query(s: SparkSession, d: str) -> DataFrame:
        return s.sql(spark_sql.replace("FROM r", "FROM {r}"), r=runs(s, d))

    QUERIES[name] = (query, f"{R_SQL} {duck_sql or spark_sql}")


@add("filter_conj", f"{R_SQL} SELECT run, method, accuracy FROM r WHERE method = 'A' AND dataset <> 'O' AND accuracy >= 0.05")
def _(s, d):
    return runs(s, d).where((F.col("method") == "A") & (F.col("dataset") != "O") & (F.col("accuracy") >= 0.05)).select("run", "method", "accuracy")


@add("filter_in", f"{R_SQL} SELECT run, level FROM r WHERE level IN (1, 3) AND method NOT IN ('N')")
def _(s, d):
    return runs(s, d).where(F.col("level").isin(1, 3) & ~F.col("method").isin("N")).select("run", "level")


@add("filter_regex", "SELECT event_id FROM events WHERE coalesce(regexp_matches(event_type, '^(c|p)'), false)")
def _(s, d):
    return table(s, d, "events").where(F.coalesce(F.col("event_type").rlike("^(c|p)"), F.lit(False))).select("event_id")


@add("drop_nulls", "SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events) WHERE value IS NOT NULL")
def _(s, d):
    return table(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")).na.drop(subset=["value"])


@add("coerce_numeric", "SELECT l_orderkey AS k, l_linenumber AS n, try_cast(CASE WHEN l_linenumber = 1 THEN 'FAILED' ELSE CAST(l_linenumber AS VARCHAR) END AS DOUBLE) AS v FROM lineitem")
def _(s, d):
    text = F.when(F.col("l_linenumber") == 1, "FAILED").otherwise(F.col("l_linenumber").cast("string"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), text.try_cast("double").alias("v"))


@add("extract_param", "SELECT p_partkey, try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS param FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).try_cast("int").alias("param"))


@add("safe_ratio", f"{R_SQL} SELECT run, round(CASE WHEN accuracy = 0 THEN NULL ELSE nodes / accuracy END, 6) AS ratio FROM r")
def _(s, d):
    return runs(s, d).select("run", r6(F.try_divide("nodes", "accuracy")).alias("ratio"))


@add("param_summary", f"{R_SQL} SELECT method, level, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std, max(accuracy) AS best, min(accuracy) AS worst, count(*) AS n FROM r WHERE method IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return runs(s, d).where("method is not null").groupBy("method", "level").agg(r6(F.avg("accuracy")).alias("mean"), r6(F.stddev_samp("accuracy")).alias("std"), F.max("accuracy").alias("best"), F.min("accuracy").alias("worst"), F.count("*").alias("n"))


both("stats_ci", "SELECT method, round(avg(accuracy), 6) AS mean, round(CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(accuracy) / sqrt(count(*)) ELSE 0 END, 6) AS ci FROM r GROUP BY method")
both("cv_having", "SELECT method, level, round(stddev_samp(accuracy) / avg(accuracy) * 100, 6) AS cv FROM r GROUP BY method, level HAVING count(*) >= 3")
both("value_counts", "SELECT method, dataset, count(*) AS n FROM r GROUP BY method, dataset")
both("scaling_factor", "SELECT dataset, round((max(m) - min(m)) / max(m), 6) AS factor FROM (SELECT dataset, level, avg(seconds) AS m FROM r GROUP BY dataset, level) AS t GROUP BY dataset")
both("int_hist", "SELECT level, count(*) AS n FROM r GROUP BY level")
both("logsumexp", "SELECT method, round(max(m) + ln(sum(exp(accuracy - m))), 6) AS v FROM (SELECT method, accuracy, max(accuracy) OVER (PARTITION BY method) AS m FROM r) AS t GROUP BY method")
both("lpnorm", "SELECT method, round(power(sum(power(abs(accuracy), 3)) / count(*), 1.0 / 3), 6) AS p3, round(sqrt(sum(accuracy * accuracy) / count(*)), 6) AS p2, max(abs(accuracy)) AS pinf FROM r GROUP BY method")
both("linear_fit", "SELECT method, round(regr_slope(seconds, nodes), 4) AS slope, round(regr_intercept(seconds, nodes), 3) AS intercept FROM r GROUP BY method")
both("lambda_critical", "SELECT DISTINCT level, round(2 / (1 + level / 2e0), 6) AS critical, round(2 * (2 - 2 / (1 + level / 2e0)) / (2 / (1 + level / 2e0)), 6) AS inverse FROM r")
both("dim_lookup_default", "SELECT run, coalesce(size, 0) AS size FROM r LEFT JOIN (SELECT 'A' AS m, 2708 AS size UNION ALL SELECT 'N' AS m, 3327 AS size) AS t ON t.m = method")
both("dup_rows", "SELECT method, level, accuracy, nodes, count(*) AS n FROM r GROUP BY method, level, accuracy, nodes HAVING count(*) > 1")


@add("best_config", f"{R_SQL} SELECT method, dataset, run, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY method, dataset ORDER BY accuracy DESC, run) AS nth FROM r) WHERE nth = 1")
def _(s, d):
    best = F.max_by(F.struct("run", "accuracy"), F.struct("accuracy", -F.col("run")))
    return runs(s, d).groupBy("method", "dataset").agg(best.alias("b")).select("method", "dataset", "b.run", "b.accuracy")


@add("speedup_vs_baseline", f"{R_SQL}, m AS (SELECT method, dataset, level, avg(seconds) AS t FROM r GROUP BY 1, 2, 3) SELECT m.method, m.dataset, m.level, round(b.t / m.t, 6) AS speedup FROM m LEFT JOIN m b ON b.method = 'N' AND b.dataset = m.dataset AND b.level = m.level")
def _(s, d):
    m = runs(s, d).groupBy("method", "dataset", "level").agg(F.avg("seconds").alias("t"))
    base = m.where("method = 'N'").select("dataset", "level", F.col("t").alias("base"))
    return m.join(base, ["dataset", "level"], "left").select("method", "dataset", "level", r6(F.col("base") / F.col("t")).alias("speedup"))


@add("delta_efficiency", f"{R_SQL}, m AS (SELECT method, level, avg(accuracy) AS acc, avg(seconds) AS t FROM r GROUP BY 1, 2) SELECT method, level, round(acc - lag(acc) OVER w, 6) + 0.0 AS d_acc, round(t - lag(t) OVER w, 4) + 0.0 AS d_t FROM m WINDOW w AS (PARTITION BY method ORDER BY level)")
def _(s, d):
    w = Window.partitionBy("method").orderBy("level")
    m = runs(s, d).groupBy("method", "level").agg(F.avg("accuracy").alias("acc"), F.avg("seconds").alias("t"))
    return m.select("method", "level", r6(F.col("acc") - F.lag("acc").over(w)).alias("d_acc"), (F.round(F.col("t") - F.lag("t").over(w), 4) + 0.0).alias("d_t"))


@add("scaling_first_last", f"{R_SQL} SELECT method, min_by(seconds, (nodes, run, seconds)) AS first, max_by(seconds, (nodes, run, seconds)) AS last FROM r GROUP BY 1")
def _(s, d):
    at = F.struct("nodes", "run", "seconds")
    return runs(s, d).groupBy("method").agg(F.min_by("seconds", at).alias("first"), F.max_by("seconds", at).alias("last"))


@add("timing_summary", f"{R_SQL} SELECT method, round(sum(seconds), 2) AS total, round(avg(seconds), 4) AS mean, count(*) AS n, max_by(seconds, (run, seconds)) AS latest FROM r GROUP BY 1")
def _(s, d):
    return runs(s, d).groupBy("method").agg(F.round(F.sum("seconds"), 2).alias("total"), F.round(F.avg("seconds"), 4).alias("mean"), F.count("*").alias("n"), F.max_by("seconds", F.struct("run", "seconds")).alias("latest"))


@add("topk_sorted", f"{R_SQL} SELECT run, accuracy, seconds FROM r ORDER BY accuracy DESC, seconds, run LIMIT 10")
def _(s, d):
    return runs(s, d).select("run", "accuracy", "seconds").orderBy(F.desc("accuracy"), "seconds", "run").limit(10)


@add("equi_bins", f"{R_SQL}, m AS (SELECT min(seconds) AS lo, max(seconds) AS hi FROM r) SELECT least(floor(10 * (seconds - lo) / CASE WHEN hi - lo < 1e-15 THEN 1 ELSE hi - lo END), 9)::BIGINT AS bin, count(*) AS n FROM r, m GROUP BY 1")
def _(s, d):
    r = runs(s, d)
    m = r.agg(F.min("seconds").alias("lo"), F.max("seconds").alias("hi"))
    width = F.when(F.col("hi") - F.col("lo") < 1e-15, 1.0).otherwise(F.col("hi") - F.col("lo"))
    return r.crossJoin(F.broadcast(m)).groupBy(F.least(F.floor(10 * (F.col("seconds") - F.col("lo")) / width), F.lit(9).cast("long")).alias("bin")).agg(F.count("*").alias("n"))  # m: one row


@add("beta_increase", "SELECT user_id, event_id, round(value / min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS increase FROM events WHERE value > 0")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").where("value > 0").select("user_id", "event_id", r6(F.col("value") / F.min("value").over(w)).alias("increase"))


@add("trapz", "SELECT user_id, round(sum(a), 3) AS area FROM (SELECT user_id, (value + lag(value) OVER w) / 2 * (n - lag(n) OVER w) AS a FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY n)) GROUP BY 1")
def _(s, d):
    n = table(s, d, "events").select("user_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    w = Window.partitionBy("user_id").orderBy("n")
    return n.select("user_id", ((F.col("value") + F.lag("value").over(w)) / 2 * (F.col("n") - F.lag("n").over(w))).alias("a")).groupBy("user_id").agg(F.round(F.sum("a"), 3).alias("area"))


def keys(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).distinct(), table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("k")).distinct()


K_SQL = ("SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0")


@add("set_union", " UNION ".join(K_SQL))
def _(s, d):
    a, b = keys(s, d)
    return a.union(b).distinct()


@add("set_intersect", " INTERSECT ".join(K_SQL))
def _(s, d):
    a, b = keys(s, d)
    return a.intersect(b)


@add("set_except", " EXCEPT ".join(K_SQL))
def _(s, d):
    a, b = keys(s, d)
    return a.subtract(b)


@add("missing_extra_ids", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'extra' END AS kind FROM (SELECT p_partkey AS id FROM part) a FULL JOIN (SELECT DISTINCT l_partkey + 1 AS id FROM lineitem) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def _(s, d):
    a = table(s, d, "part").select(F.col("p_partkey").alias("id"))
    b = table(s, d, "lineitem").select((F.col("l_partkey") + 1).alias("id")).distinct()
    return a.join(b, "id", "left_anti").withColumn("kind", F.lit("missing")).unionByName(b.join(a, "id", "left_anti").withColumn("kind", F.lit("extra")))


@add("log_extract", "SELECT event_id, regexp_extract(props, '\"([a-z_]+)\"', 1) AS key, len(regexp_extract_all(props, '[0-9]+')) AS numbers FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.regexp_extract("props", '"([a-z_]+)"', 1).alias("key"), F.size(F.regexp_extract_all("props", F.lit("[0-9]+"), 0)).cast("long").alias("numbers"))


@add("minibatch_assign", "SELECT p_partkey AS id, (row_number() OVER (ORDER BY p_partkey % 97, p_partkey) - 1) // 64 AS batch FROM part")
def _(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).alias("b"))
    before = part.groupBy("b").agg(F.count("*").alias("n")).select(F.col("b").alias("c"), (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))  # 97 rows
    nth = F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1
    return part.join(F.broadcast(before), F.col("b") == F.col("c")).select("id", F.floor((F.col("before") + nth) / 64).alias("batch"))


@add("scan_results_clean", f"{R_SQL} SELECT run, method, accuracy FROM r WHERE accuracy > 0 AND seconds IS NOT NULL")
def _(s, d):
    return runs(s, d).where("accuracy > 0 and seconds is not null").select("run", "method", "accuracy")


@add("masked_accuracy", "SELECT round(avg(CASE WHEN label = vec_id % 10 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM embeddings WHERE vec_id % 10 >= 8")
def _(s, d):
    return table(s, d, "embeddings").where("vec_id % 10 >= 8").agg(r6(F.avg((F.col("label") == F.col("vec_id") % 10).cast("double"))).alias("accuracy"))
