"""Graphs drawn from the driver's tables, generated graphs and text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """Into how many partitions ``rows`` are dealt so that none holds more than about ``each``, as many as there are cores if that leaves them 20,000 or more."""
    return max(-(-rows // each), min(spark.sparkContext.defaultParallelism, -(-rows // 20_000)), 1)


def part_edges(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Parts that are ordered together at least ``least`` times; the weight is the number of orders.

    Orders and pairs are dealt into partitions by the number of rows (a file's footer tells it), so a task's sorts and hash tables don't grow with the table.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).where("o is not null and p is not null")
    n = dealt(spark, table(spark, sf_dir, "lineitem").count())
    op = lines.repartition(n, "o").distinct()
    pairs = op.alias("a").join(op.alias("b").hint("merge"), (F.col("a.o") == F.col("b.o")) & (F.col("a.p") < F.col("b.p")))
    pairs = pairs.select(F.col("a.p").alias("i"), F.col("b.p").alias("j")).repartition(2 * n, "i", "j")  # about two pairs a line
    return pairs.groupBy("i", "j").agg(F.count("*").cast("double").alias("w")).where(F.col("w") >= least)


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def grid(spark: SparkSession, n: int, m: int, periodic: bool = False) -> DataFrame:
    """Edges of an n by m grid, node (r, c) being r * m + c."""
    at = spark.range(n * m).select("id", F.floor(F.col("id") / m).alias("r"), (F.col("id") % m).alias("c"))
    if periodic:
        right, down = F.col("r") * m + (F.col("c") + 1) % m, (F.col("r") + 1) % n * m + F.col("c")
        ends = at.select("id", F.explode(F.array(right, down)).alias("to"))
    else:
        ends = at.select("id", F.explode(F.array(F.when(F.col("c") < m - 1, F.col("id") + 1), F.when(F.col("r") < n - 1, F.col("id") + m))).alias("to")).where("to is not null")
    return ends.where("id <> to").select(F.least("id", "to").alias("i"), F.greatest("id", "to").alias("j"), F.lit(1.0).alias("w")).distinct()


def grid_fe(spark: SparkSession, n: int, m: int) -> DataFrame:
    """Edges of an n by m grid with all eight neighbours."""
    at = spark.range(n * m).select("id", F.floor(F.col("id") / m).alias("r"), (F.col("id") % m).alias("c"))
    steps = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 1), (1, -1), (1, 0), (1, 1))))
    inside = at.withColumn("o", F.explode(steps)).where((F.col("r") + F.col("o.y") < n) & (F.col("c") + F.col("o.x")).between(0, m - 1))
    return inside.select(F.col("id").alias("i"), (F.col("id") + F.col("o.y") * m + F.col("o.x")).alias("j"), F.lit(1.0).alias("w"))


def path(spark: SparkSession, n: int, weak: float) -> DataFrame:
    """A path whose middle edge has weight ``weak``."""
    return spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.when(F.col("id") == (n - 1) // 2, F.lit(weak)).otherwise(1.0).alias("w"))


def star(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w"))


def complete(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(n).cast("long"))).alias("j")).where(F.col("j") < n).withColumn("w", F.lit(1.0))


def union(a: DataFrame, b: DataFrame, offset: int, bridge: tuple[int, int, float]) -> DataFrame:
    """Both graphs, the second's ids moved by ``offset``, and one edge between them."""
    moved = b.select((F.col("i") + offset).alias("i"), (F.col("j") + offset).alias("j"), "w")
    return a.unionByName(moved).unionByName(a.sparkSession.createDataFrame([bridge], "i long, j long, w double"))


def planted(spark: SparkSession, n: int, blocks: int, inside: float, across: float) -> DataFrame:
    """A planted partition: node k is in block k modulo ``blocks``; a pair is an edge by a hash below its probability."""
    from latticework.operators.graph import uniform

    pairs = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(n).cast("long"))).alias("j")).where(F.col("j") < n)
    p = F.when(F.col("i") % blocks == F.col("j") % blocks, inside).otherwise(across)
    return pairs.where(uniform(F.col("i") * 7919 + F.col("j"), 3) < p).withColumn("w", F.lit(1.0))


def read_coordinates(spark: SparkSession, path_: str) -> DataFrame:
    """(id, x, y) of the "node id x y ..." lines of a plain graph drawing."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path_).where("value rlike '^node '").select(part[1].cast("long").alias("id"), part[2].cast("double").alias("x"), part[3].cast("double").alias("y"))


def read_graph(spark: SparkSession, path_: str) -> DataFrame:
    """Edges of a file by its ending: .mtx (a Laplacian), .json, .dimacs, .graph, .cc or .parquet."""
    from latticework.operators.graph import adjacency

    readers = {
        "mtx": lambda: adjacency(read_matrix_market(spark, path_)), "json": lambda: read_node_link(spark, path_)[1], "dimacs": lambda: read_dimacs(spark, path_), "graph": lambda: read_chaco(spark, path_),
        "cc": lambda: adjacency(read_compressed_column(spark, path_)), "parquet": lambda: spark.read.parquet(path_).select("i", "j", "w"),
    }
    ending = path_.rstrip("/").rpartition(".")[2].lower()
    if ending not in readers:
        raise ValueError(f"no reader for .{ending}")
    return readers[ending]()


def matrix_entries(lines: DataFrame, document: str) -> DataFrame:
    """(``document``, i, j, v), 0-based, of the lines (value, document column, place) of many coordinate files at once.

    Banners, comments and blank lines are left out, as is each document's size line, its first other one; missing values are 1, "symmetric" and "skew-symmetric" banners expanded, lines without two whole numbers skipped.
    """
    text = F.trim("value")
    about = lines.where(~text.startswith("%") & (text != "")).groupBy(document).agg(F.min("place").alias("size"))
    banner = lines.where(text.startswith("%%")).groupBy(document).agg(F.lower(F.min_by("value", "place")).alias("banner"))
    part = F.split(text, r"\s+")
    body = lines.where(~text.startswith("%") & (text != "")).join(about.join(banner, document, "left"), document).where("place <> size")
    number = lambda k: F.try_element_at(part, F.lit(k)).try_cast("long") - 1
    m = body.select(document, number(1).alias("i"), number(2).alias("j"), F.coalesce(F.try_element_at(part, F.lit(3)).try_cast("double"), F.lit(1.0)).alias("v"), "banner").where("i is not null and j is not null")
    sign = F.when(F.col("banner").contains("skew-symmetric"), -1.0).when(F.col("banner").contains("symmetric"), 1.0)
    ends = F.array(F.struct("i", "j", "v"), F.when(sign.isNotNull() & (F.col("i") != F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (sign * F.col("v")).alias("v"))))
    return m.select(document, F.explode(ends).alias("e")).where("e is not null").select(document, "e.*")


def read_matrix_market(spark: SparkSession, path_: str) -> DataFrame:
    """(i, j, v), 0-based, of a coordinate file or a folder of its parts in order of names, by the rules of ``matrix_entries``."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    return matrix_entries(spark.read.text(path_).select("value", F.lit(0).alias("document"), place.alias("place")), "document").select("i", "j", "v")


def read_node_link(spark: SparkSession, path_: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link JSON document."""
    whole = spark.read.schema("nodes array<struct<id: bigint, val: boolean, test: boolean>>, links array<struct<source: bigint, target: bigint>>").json(path_, multiLine=True)
    edges = whole.select(F.explode("links").alias("l")).where("l.source <> l.target").select(F.least("l.source", "l.target").alias("i"), F.greatest("l.source", "l.target").alias("j"), F.lit(1.0).alias("w")).distinct()
    return whole.select(F.inline("nodes")), edges


def read_dimacs(spark: SparkSession, path_: str) -> DataFrame:
    """Edges of "e i j [w]" and "a i j [w]" lines, 0-based."""
    part = F.split(F.trim("value"), r"\s+")
    e = spark.read.text(path_).where("value rlike '^[ae] '").select((part[1].cast("long") - 1).alias("a"), (part[2].cast("long") - 1).alias("b"), F.coalesce(F.try_element_at(part, F.lit(4)).try_cast("double"), F.lit(1.0)).alias("w"))
    return e.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.max("w").alias("w")).where("i <> j")


def read_compressed_column(spark: SparkSession, path_: str) -> DataFrame:
    """(i, j, v), 0-based, of "i j value" lines."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path_).where("trim(value) <> ''").select((part[0].cast("long") - 1).alias("i"), (part[1].cast("long") - 1).alias("j"), part[2].cast("double").alias("v"))


def read_chaco(spark: SparkSession, path_: str) -> DataFrame:
    """Edges of an unweighted Chaco file: a line of sizes, then a line of neighbours for each node, 0-based. One file is one document, as its line numbers are ids."""
    lines = spark.read.text(path_, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("n", "line"))
    ends = lines.where("n > 0").select((F.col("n") - 1).cast("long").alias("a"), F.explode(F.split(F.trim("line"), r"\s+")).alias("b")).where("b <> ''")
    pairs = ends.select("a", (F.col("b").cast("long") - 1).alias("b")).where("a <> b")
    return pairs.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), F.lit(1.0).alias("w")).distinct()


def read_npy(spark: SparkSession, path_: str) -> DataFrame:
    """(id, x array) of two-dimensional .npy files, each read by one task."""
    import io

    import numpy as np
    import pandas as pd

    def rows(batches):
        for b in batches:
            for content in b["content"]:
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(m), 10_000):
                    part = m[at : at + 10_000].astype(float)
                    yield pd.DataFrame({"id": np.arange(at, at + len(part)), "x": list(part)})

    return spark.read.format("binaryFile").load(path_).select("content").mapInPandas(rows, "id long, x array<double>")


def write_dot(edges: DataFrame, path_: str) -> None:
    """One DOT file of an undirected graph."""
    spark = edges.sparkSession
    ends = spark.createDataFrame([("graph {", 0), ("}", 2)], "value string, n int")
    body = edges.select(F.format_string("  %d -- %d [weight=%s];", "i", "j", F.col("w").cast("string")).alias("value"), F.lit(1).alias("n"), "i", "j")
    ends.unionByName(body, allowMissingColumns=True).orderBy("n", "i", "j").select("value").coalesce(1).write.text(path_)


def write_report(rows: DataFrame, path_: str) -> None:
    """CSV with a header; for summaries."""
    rows.coalesce(1).write.csv(path_, header=True)


def write_matrix_market(matrix: DataFrame, path_: str, rows: int, columns: int) -> None:
    """Coordinate text: header, size, then 1-based entries; one file."""
    head = matrix.agg(F.format_string(f"{rows} {columns} %d", F.count("*")).alias("value"))
    lines = matrix.sparkSession.createDataFrame([("%%MatrixMarket matrix coordinate real general",)], "value string").withColumn("n", F.lit(0))
    body = matrix.select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, "v").alias("value"), F.lit(2).alias("n"), "i", "j")
    everything = lines.unionByName(head.withColumn("n", F.lit(1))).unionByName(body, allowMissingColumns=True)
    everything.orderBy("n", "i", "j").select("value").coalesce(1).write.text(path_)
