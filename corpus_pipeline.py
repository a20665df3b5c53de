"""A corpus pipeline of five stages, each reading what the one before it wrote.

Language identification drops texts without a language; of each group of near copies the smallest document stays;
documents with benchmark passages go; personal data is redacted; the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkspan.llm import common, decontaminate, jaccard_join, language_id, pii, sentencepiece_codec


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no language: null texts and texts without a letter ('und')."""
    return language_id.predict_languages(docs).where("lang_pred <> 'und'").select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs)


STAGES = [("language_id", identify), ("ngram_jaccard_join", deduplicate), ("decontamination", decontaminated), ("pii", redact), ("sentencepiece", encode)]

#: None of the stages but the third and fourth has a SQL form; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, was = common.table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
        common.release(*was)
        was = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
