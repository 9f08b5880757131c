"""The thin queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, fingerprints, html_text, language, media, mixing, near_dedup, quality, spelling, suffix_dedup, toxicity, warc
from .common import arrow_limits, materialize, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_weights(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return suffix_dedup.digest_rows(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    archives = materialize(warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages"))))
    return warc.read_archives(archives).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    stored = materialize(media.store(table(spark, sf_dir, "documents")))
    return media.payload_digests(stored)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return language.classify(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_warc": op4_warc,
    "op5_media": op5_media,
    "op6_near_dedup": op6_near_dedup,
    "op7_language": op7_language,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_fingerprints": op10_fingerprints,
    "op11_html_text": op11_html_text,
    "op12_spelling": op12_spelling,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.ORACLE_SQL, "op4_warc": warc.ORACLE_SQL, "op6_near_dedup": near_dedup.ORACLE_SQL, "op12_spelling": spelling.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
