"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, substring dedup and packing over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import line_dedup, packing, quality, simhash_dedup, substring_dedup
from latticework.llm.common import components, merged, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more stay."""
    machine = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return _documents(quality.scored(docs, machine).where("score >= 0.3"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of single lines go; documents stay, if only as empty texts."""
    return _documents(line_dedup.without_repeats(docs, least=1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash fingerprints within 4 bits, or by a five-word similarity of 0.8 or more, most of which fingerprints miss, the one with the smallest doc_id stays; texts without words are one group."""
    found = (simhash_dedup.near_duplicates(docs), simhash_dedup.similar_documents(docs))
    simhash, similar = (x.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")) for x in found)
    links = simhash.unionAll(similar)
    gone = components(links, "near-cc").where("id <> root").select(F.col("id").alias("doc_id"))
    return _documents(docs.join(merged(gone), "doc_id", "left_anti"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; texts without such words stay as they are."""
    found = substring_dedup.without_repeats(docs)
    return _documents(found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents' tokens."""
    import public_tokenizers

    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, near-dedup and the tokenizer are beyond SQL; the tests compare the operators of the stages with brute force, and of the stages themselves packing, the line and near-dedup decisions on small tables.
ORACLE_SQL = None
