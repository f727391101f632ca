"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, tokens.

Every stage takes all rows of documents that the one before kept.  Null texts and
texts without a letter have no language and go in the first stage; those without
words stay in the second; empty tables give empty tables; repeated rows are copies,
of which the second stage keeps one; ties go to the smallest doc_id, and rows
without a doc_id stay.  All columns but text and n_chars pass unchanged, columns
with other names too.  Texts are taken whole, whatever their length.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, decontaminate, jaccard, langid, pii
from tidemark.llm.queries import tokenizer_path


WORDS, PERCENT = 5, 80  # of the near-duplicate stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject."""
    return langid.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join, at five words and 0.8."""
    return jaccard.one_of_each(docs, words=WORDS, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of every document."""
    return bpe.encode(docs, tokenizer_path()).select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Language models, boosted trees and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; only the last one's table stays in the shared folder."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.scope(spark, keep=("pipeline-",)):
            docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.drop_saved(spark, before)
        before = docs
    return docs
