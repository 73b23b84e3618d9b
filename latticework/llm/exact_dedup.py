"""Exact dedup by stateful streaming: keyed state on disk, without expiry, retains digest, stable identifier and content locator; hits are checked by full bytes.

Only DataFrame and SQL functions: the stream keeps, for each digest, the greatest identifier, where that row lies (file and row) and how many rows
had the digest. State is RocksDB, committed to the shared folder with every batch, so a lost executor's part is taken up by another and a later run over the
same folder reads only new files.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import shared_dir, with_groups, written

COPIES_A_TASK = 512  #: copies that meet one copy of the retained text
BITS = (15, 30)  #: log2 of the filter's bits: at least one bitmap of 4 KB, at most 128 MB


def normalised(text: str | Column) -> Column:
    """A-Z to lower case, nothing else; null as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(rows: DataFrame, id_: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, id, file, row, body); the source's own columns, whatever their names, aren't in the way."""
    body, at = normalised(rows[text]), rows.metadataColumn("_metadata")
    return rows.select(digest(body).alias("digest"), rows[id_].alias("id"), at["file_path"].alias("file"), at["row_index"].alias("row"), body.alias("body"))


def retained(spark: SparkSession, path: str, state: str, id_: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, batch: int = 64 << 30) -> DataFrame:
    """(digest, keep struct<id, file, row>, n): the state after all Parquet files at ``path``, ``batch`` bytes of them at a time.

    ``state``: the stream's folder; files that an earlier run over it has read aren't read again, their keys are still there. Partial sums go to the
    keys' partitions, so a hot key sends one row a task.
    """
    own = spark.newSession()  # the settings below aren't the caller's
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "400")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else each partition of the state takes 4 MB before it has a row
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    schema = spark.read.parquet(path).schema
    files = path.rstrip("/")
    stream = own.readStream.schema(schema).option("maxBytesPerTrigger", str(batch)).parquet(f"{files[:-1]}[{files[-1]}]")  # a pattern, as a stream takes no single file
    rows = _keyed(stream, id_, text, digest).groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    query = rows.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    held = spark.read.format("statestore").load(state).select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n"))
    return written(held, "retained")


def _filter(repeated: DataFrame, keys: int) -> tuple[DataFrame, int]:
    """(bucket, bits): bitmaps of 4 KB with a bit for each digest, and log2 of all bits: eight for each key, 2^30 (128 MB) at most."""
    log2 = min(max((8 * keys).bit_length(), BITS[0]), BITS[1])
    at = F.pmod(F.xxhash64("digest"), F.lit(1 << log2))
    return repeated.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), log2


def marked(spark: SparkSession, path: str, held: DataFrame, id_: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(digest, id, file, row, keep, n, body): every row, with what the state has of its digest where that has more than one row; body only there.

    A bitmap of repeated digests goes to all tasks; texts that it rules out are not shuffled. Its size is bounded: beyond its bits, more texts than
    needed go along, with the same result. Digests with a thousandth of all rows or more (a thousand at most) meet their rows without a shuffle.
    """
    repeated = written(held.where("n > 1"), "repeated")
    total, keys = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], repeated.count()
    bits, log2 = _filter(repeated, keys)
    rows = _keyed(spark.read.parquet(path), id_, text, digest)
    at = F.pmod(F.xxhash64("digest"), F.lit(1 << log2))
    rows = rows.withColumn("bucket", F.bitmap_bucket_number(at)).withColumn("bit", F.bitmap_bit_position(at)).join(F.broadcast(bits), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.col("bits").isNotNull() & (F.call_function("getbit", byte, F.pmod(F.col("bit"), F.lit(8)).cast("int")) == 1)
    rows = rows.select("digest", "id", "file", "row", F.when(maybe, F.col("body")).alias("body"))
    return written(with_groups(rows, repeated, "digest", "n", total, F.xxhash64("file", "row")), "marked")


def collisions(rows: DataFrame) -> DataFrame:
    """(digest) of those of ``marked`` rows whose bytes differ from the retained row's, which is fetched by its locator.

    A retained text is repeated for every ``COPIES_A_TASK`` rows of its digest, so copies in any number are spread over tasks.
    """
    hits = rows.where("keep is not null")
    is_kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    salts = F.ceil(F.col("n") / COPIES_A_TASK)
    held = hits.where(is_kept).select("digest", F.col("body").alias("theirs"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    others = hits.where(~is_kept).select("digest", "body", F.pmod(F.xxhash64("file", "row"), salts).alias("salt"))
    return others.join(held, ["digest", "salt"]).where(F.col("body").cast("binary") != F.col("theirs").cast("binary")).select("digest").distinct()


def decisions(spark: SparkSession, path: str, id_: str = "doc_id", text: str = "text", state: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of the Parquet files at ``path``: (id, keep_id, group_size, kept, text_sha256, file, row).

    Texts are equal if they are the same bytes after A-Z become lower case; null counts as empty. Of equal texts the row with the greatest id stays; null
    ids come before all others, and of rows with the same id the last by file and place stays, so exactly one row of a group is kept. No files, no rows.
    Further columns are not read. ``state``: the folder of an earlier run, whose files must still be there; by default a new one in the shared folder.
    Rows whose digests agree and bytes don't are grouped anew by their bytes. text_sha256 is null where ``digest`` is another function.
    """
    state = state or f"{shared_dir(spark).rstrip('/')}/seen-{uuid.uuid4().hex}"
    held = retained(spark, path, state, id_, text, digest)
    rows = marked(spark, path, held, id_, text, digest)
    odd = written(collisions(rows), "collided")
    own = F.struct("id", "file", "row")
    if odd.limit(1).count():
        clash = rows.join(odd, "digest", "left_semi")
        groups = clash.groupBy("digest", "body").agg(F.max(own).alias("keep"), F.count("*").alias("n"))
        again = clash.drop("keep", "n").join(groups, ["digest", "body"]).select(*rows.columns)
        rows = rows.join(odd, "digest", "left_anti").select(*again.columns).unionByName(again)
    keep = F.coalesce("keep", own)
    sha = F.lower(F.hex("digest")) if digest is sha256 else F.lit(None).cast("string")
    return rows.select(
        F.col("id"), keep["id"].alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        ((keep["file"] == F.col("file")) & (keep["row"] == F.col("row"))).alias("kept"), sha.alias("text_sha256"), "file", "row",
    )


def unique_rows(spark: SparkSession, path: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all columns as they are."""
    source = spark.read.parquet(path)
    at = source.metadataColumn("_metadata")
    stay = decisions(spark, path, id_, text).where("kept").select("file", "row")
    return source.join(stay, (at["file_path"] == stay["file"]) & (at["row_index"] == stay["row"]), "left_semi")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: (doc_id, keep_id, group_size, kept, text_sha256); of equal texts the row with the largest doc_id stays."""
    return decisions(spark, f"{sf_dir}/documents.parquet").select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
