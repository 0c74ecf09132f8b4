"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketwise.llm.byte_bpe import encode_texts, given_vocabulary
from basketwise.llm.decontaminate import drop_leaks
from basketwise.llm.exact_dedup import fresh_index, keep_first_copies
from basketwise.llm.language_id import keep_identified
from basketwise.llm.ngram_join import keep_one_of_each
from basketwise.llm.store import kept, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest id stays."""
    return keep_first_copies(docs, fresh_index(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the one with the smallest id stays."""
    return keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and decoded again."""
    return encode_texts(docs, given_vocabulary())


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("decontaminate", decontaminated),
    ("byte_bpe", tokenized),
]

#: Language ID and the shingle join can't be written in SQL that runs on whole tables; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
