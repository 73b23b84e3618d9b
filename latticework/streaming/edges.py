"""Edge weights kept up from a stream of events: windows by event time, late events up to a watermark, updates merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_weights(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(i, j, day, n, w): events of a user (i) by type (j) in each window of event time; events later than ``late`` are left out by a running stream."""
    by = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("window"), F.col("user_id").alias("i"), F.col("event_type").alias("j"))
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("w")).select("i", "j", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "w")


def after_all(spark: SparkSession, path: str, scratch: str) -> DataFrame:
    """Runs a stream over the files of ``path`` until all are read; each batch's changed windows are appended to a table in
    ``scratch``, and the last state of every window is returned."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    events = reader.parquet(f"{path.rpartition('/')[0]}/*{path.rpartition('/')[2]}")
    table = f"{scratch}/table"

    def merge(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")  # a batch that is run again replaces itself

    query = windowed_weights(events, late="3650 days").writeStream.outputMode("update").option("checkpointLocation", f"{scratch}/state").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    state = spark.read.parquet(table)
    key = ("i", "j", "day")
    return state.groupBy(*key).agg(F.max_by(F.struct("n", "w"), "batch").alias("last")).select(*key, "last.n", "last.w")
