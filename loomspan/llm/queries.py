"""The registered queries of the training-data operators, and their SQL.

Each query reads its whole table and returns the full result of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from loomspan.llm import decontaminate, jaccard, licenses, mixing, ngram, quality, quotes, sharding, template, urlfilter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(_read(spark, sf_dir, "conversations"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_read(spark, sf_dir, "documents"))


def op4_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.fitted_scores(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(_read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urlfilter.listed_captures(urlfilter.derived_captures(pages), urlfilter.derived_entries(pages))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_read(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.main_texts(_read(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quotation_links, op2_license_scan, op3_ngram_jaccard, op4_ngram_scores, op5_quality_rules, op6_mix_sources, op7_url_filter, op8_decontaminate, op9_shard, op10_main_text,
        pipeline,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op6_mix_sources": mixing.SQL, "op7_url_filter": urlfilter.SQL}
