"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    importance_resampling,
    license_scan,
    near_dups,
    packing,
    periodic_runs,
    permutation_index,
    pii,
    piece_codec,
    quality_model,
    quality_rules,
    token_counts,
    url_filters,
    warc,
)


def vocabulary(name: str) -> str:
    """A public tokenizer's file; the package that holds them is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2, share=80)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filters.rule_table(spark))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.codec_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), text=periodic_runs.with_planted_period())
    return periodic_runs.run_report(found)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(license_scan.find_notices(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_near_dups": op2_near_dups,
    "op3_pii": op3_pii,
    "op4_permutation_index": op4_permutation_index,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_quality_model": op7_quality_model,
    "op8_url_filters": op8_url_filters,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_license_scan": op12_license_scan,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE_SQL,
    "op2_near_dups": near_dups.ORACLE_SQL,
    "op8_url_filters": url_filters.ORACLE_SQL,
    "op13_importance_resampling": importance_resampling.ORACLE_SQL,
}
