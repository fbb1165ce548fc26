"""The queries of this subpackage for `__spark_entry__`: one for each operator, over its whole table."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents


def op4_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import encode_corpus

    return encode_corpus(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import count_tokens

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import fit, scan

    docs = documents(spark, sf_dir)
    return scan(docs, fit(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .telephony import digest_payloads

    return digest_payloads(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, grade_documents

    docs = documents(spark, sf_dir)
    return grade_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge

    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import resample

    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .scoring import score_documents

    return score_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_telephony, op2_toxicity, op3_quality_rules, op4_byte_bpe_codec, op5_token_counts, op6_quality_classifier, op7_simhash, op8_licenses, op9_packing, op10_lm_scores)}
#: None of these can be written in SQL: they need tokenizers, trained models, bit counts or files.
ORACLE_SQL: dict[str, str] = {}
