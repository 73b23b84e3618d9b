"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import ann, bpe, centroids, embedding_dedup, exact_dedup, filter_audit, line_dedup, packing, quality, simhash_dedup, substring_dedup, suffix_dedup, toxicity


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_ann": ann.op6_ann,
        "op7_packing": packing.op7_packing,
        "op8_quality": quality.op8_quality,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_exact_dedup": exact_dedup.op12_exact_dedup,
        "op13_centroid_clustering": centroids.op13_centroid_clustering,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op4_substring_dedup": substring_dedup.OP4_SQL,
        "op6_ann": ann.OP6_SQL,
        "op9_suffix_dedup": suffix_dedup.OP9_SQL,
        "op10_embedding_dedup": embedding_dedup.OP10_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_exact_dedup": exact_dedup.OP12_SQL,
        "op13_centroid_clustering": centroids.OP13_SQL,
    }
