"""The corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. `run` writes each stage's result to the shared folder and reads it again
as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import packing, quality, rules, simhash
from tallyloom.llm.common import documents, written

#: None of the stages' results can be written in SQL (trained models, bit counts, tokenizers); tests hold run() against a brute-force version.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that importance resampling keeps, each weighed by its own text.

    Null and empty texts have weight 0; equal keys at the bar stay; repeated rows share one verdict. An empty table
    gives none, and without good labels all rows stay. Columns of any name pass through.
    """
    return quality.keep_documents(docs, _labels(spark, sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the base test and the decision list, which is learned from the labelled part of the whole table.

    Null, empty and short texts fail the base test and go; repeated rows share one verdict; without labels the base
    test decides alone. Columns of any name pass through.
    """
    learned = rules.learn_rules(documents(spark, sf_dir), _labels(spark, sf_dir))
    return rules.keep_documents(docs, learned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, rows without an id last.

    Texts of one id that aren't alike belong to groups of their own. Null and empty texts are one group.
    """
    return simhash.keep_representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in training sequences.

    A null or empty text is its end id alone; repeated rows and rows without an id are packed one by one.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
