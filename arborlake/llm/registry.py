"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import divergence, exact_dedup, fingerprints, language_id, license_scan, mixing, personal_data, resampling, sentencepiece_codec, sharding, simhash, substring_dedup, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, over the whole of documents."""
    operators = {
        "op1_substring_dedup": substring_dedup.query,
        "op2_language_id": language_id.query,
        "op3_mixing": mixing.query,
        "op4_simhash": simhash.components,
        "op5_sentencepiece": sentencepiece_codec.query,
        "op6_fingerprints": fingerprints.query,
        "op7_exact_dedup": exact_dedup.groups,
        "op8_token_counts": token_counts.count_tokens,
        "op9_license_scan": license_scan.scan,
        "op10_sharding": sharding.assign,
        "op11_divergence": divergence.audit,
        "op13_personal_data": personal_data.query,
    }
    found = {name: lambda spark, sf_dir, f=f: f(_documents(spark, sf_dir)) for name, f in operators.items()}
    found["op12_resampling"] = lambda spark, sf_dir: resampling.query(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {"op3_mixing": mixing.ORACLE_SQL, "op7_exact_dedup": exact_dedup.ORACLE_SQL, "op10_sharding": sharding.oracle_sql(), "op11_divergence": divergence.ORACLE_SQL, "op12_resampling": resampling.ORACLE_SQL}
