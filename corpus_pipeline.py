"""The corpus pipeline: language ID, near-dedup, decontamination, PII surrogates, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's
rows as Parquet below the shared folder and rereads them as the next one's docs. All
stages but the last keep the columns of documents: language ID drops what has no language
and writes the one it found to lang, near-dedup keeps one document of each class,
decontamination cuts spans out of text (or drops what is mostly benchmark), PII replaces
entities in text. The last returns every document's token ids and their digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamis.llm import bpe, common, decontam, language, near_dedup, pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenised(docs, with_ids=True)


STAGES = [("language_id", language_id), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("pii", pii_surrogates), ("bpe", bpe_encoding)]
#: Language ID and ProbMinHash can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
