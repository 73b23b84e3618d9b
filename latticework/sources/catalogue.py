"""Many graphs at once: a catalogue of files, one table of all their edges, and runs that skip what is finished."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.sources import graphs as src

FORMATS = {r"\.mtx$": "mtx", r"\.dimacs$": "dimacs", r"\.cc$": "cc"}  #: pattern of a path -> format


def catalogue(spark: SparkSession, root: str, formats: dict[str, str] = FORMATS) -> DataFrame:
    """(key, folder, name, format, bytes, path) of all files below ``root`` that a pattern of ``formats`` fits, the first one deciding; contents are not read. Files of no bytes are left out: Spark lists none.

    ``key`` is the path below ``root``. Choose files by ordinary filters on these columns.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    kind = F.coalesce(*(F.when(F.col("path").rlike(p), f) for p, f in formats.items()))
    base = root.rstrip("/").partition(":")[2].lstrip("/") if ":" in root else root.strip("/")
    below = F.substring_index("path", f"{base}/", -1)
    return found.select(below.alias("key"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), kind.alias("format"), "bytes", "path").where("format is not null")


def read_all(files: DataFrame) -> DataFrame:
    """(key, i, j, w): edges of all ``files`` of a catalogue, one scan for each format; matrices are read as Laplacians. Files without edges have no rows.

    Only paths reach the driver, which lists them for the scans.
    """
    spark = files.sparkSession
    paths: dict[str, list[str]] = {}
    for r in files.select("format", "path").collect():
        paths.setdefault(r["format"], []).append(r.path)
    out = spark.createDataFrame([], "at string, i long, j long, w double")
    for kind, each in sorted(paths.items()):
        lines = spark.read.text(each).select("value", F.col("_metadata.file_path").alias("at"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("place"))
        out = out.unionByName({"mtx": _mtx, "dimacs": _dimacs, "cc": _cc}[kind](lines))
    name = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    return out.withColumn("at", name("at")).join(files.select(name("path").alias("at"), "key"), "at").select("key", "i", "j", "w")


def _mtx(lines: DataFrame) -> DataFrame:
    return src.matrix_entries(lines, "at").where("i < j and v < 0").select("at", "i", "j", (-F.col("v")).alias("w"))


def _dimacs(lines: DataFrame) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    e = lines.where("value rlike '^[ae] '").select("at", (part[1].try_cast("long") - 1).alias("a"), (part[2].try_cast("long") - 1).alias("b"), F.coalesce(F.try_element_at(part, F.lit(4)).try_cast("double"), F.lit(1.0)).alias("w"))
    return e.groupBy("at", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.max("w").alias("w")).where("i <> j")


def _cc(lines: DataFrame) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    m = lines.select("at", (part[0].try_cast("long") - 1).alias("i"), (F.try_element_at(part, F.lit(2)).try_cast("long") - 1).alias("j"), F.try_element_at(part, F.lit(3)).try_cast("double").alias("v"))
    return m.where("i < j and v < 0").select("at", "i", "j", (-F.col("v")).alias("w"))


def with_edges_between(edges: DataFrame, low: int, high: int) -> DataFrame:
    """(key, i, j, w) of the graphs that have ``low`` to ``high`` edges."""
    kept = edges.groupBy("key").count().where(F.col("count").between(low, high)).select("key")
    return edges.join(kept, "key", "left_semi")


def statistics(edges: DataFrame) -> DataFrame:
    """(key, nodes, edges, weight) of each graph of (key, i, j, w)."""
    ends = edges.select("key", F.explode(F.array("i", "j")).alias("id")).distinct().groupBy("key").agg(F.count("*").alias("nodes"))
    return edges.groupBy("key").agg(F.count("*").alias("edges"), F.sum("w").alias("weight")).join(ends, "key").select("key", "nodes", "edges", "weight")


def run(files: DataFrame, results: str, job: Callable[[DataFrame], DataFrame], at_once: int = 1000, label: str = "") -> int:
    """Runs ``job`` (edges by key -> a row a key) over the files whose keys ``results`` lacks, and says how many those were.

    Graphs run together, ``at_once`` files in one job, whose rows are appended before the next starts: a run cut short goes on after its last whole job. Files for which ``job`` has no row
    get one of nulls, so they aren't tried again. ``run`` names the run (``label``). A job that fails half-way through its write can leave rows of keys twice; ``finished`` takes one.
    """
    spark = files.sparkSession
    todo = files.join(_keys(spark, results), "key", "left_anti")
    todo = todo.withColumn("turn", F.floor((F.row_number().over(Window.orderBy("key")) - 1) / at_once))  # rows are files
    rows = todo.select("key", "format", "path", "turn").collect()
    for turn in sorted({r.turn for r in rows}):
        now = spark.createDataFrame([r[:3] for r in rows if r.turn == turn], "key string, format string, path string")
        now.select("key").join(job(read_all(now)), "key", "left").withColumn("run", F.lit(label)).write.mode("append").parquet(results)
    return len(rows)


def _keys(spark: SparkSession, results: str) -> DataFrame:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(results)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], "key string")
    return spark.read.schema("key string").parquet(results)


def finished(spark: SparkSession, results: str) -> DataFrame:
    """All results so far, a row a key."""
    return spark.read.parquet(results).dropDuplicates(["key"])


def read_results(spark: SparkSession, path: str, fields: str, value: str) -> DataFrame:
    """Lines of a CSV of results, none lost: ``fields`` as named by the DDL, ``value`` as a number, and state: ok, failed, timeout, missing or broken (too few or unreadable fields, all null but what could be read)."""
    schema = f"{fields}, {value} string, _broken string"
    rows = spark.read.csv(path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    word, number = F.upper(value), F.col(value).try_cast("double")
    state = F.when(F.col("_broken").isNotNull(), "broken").when(word == "FAILED", "failed").when(word == "TIMEOUT", "timeout").when(F.col(value).isNull() | (F.col(value) == ""), "missing").when(number.isNull() | F.isnan(number), "broken").otherwise("ok")
    return rows.select(*(c for c in rows.columns if c not in (value, "_broken")), F.when(state == "ok", number).alias(value), state.alias("state"))
