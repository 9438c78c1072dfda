"""One query for each operator, over its whole table, with the columns that were agreed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, lm, media, neardup, quality, secrets, substring, urls, wavelet
from .common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.write_and_read(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.classes(media.pictured(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_quality, op3_near_dedup, op4_wavelet, op5_decontamination, op6_lm_scoring, op7_secrets, op8_url_filter, op9_image_copies, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontaminate.SQL, "op10_substring_dedup": substring.SQL}
