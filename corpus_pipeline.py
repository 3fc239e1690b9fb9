"""From raw documents to token ids: five stages, each working on all that its predecessor kept.

``STAGES`` lists them; a stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, all but the last
with the columns of documents.  ``run`` writes every stage's rows to the shared folder and reads them
back, so a lost executor never costs more than the stage it belonged to.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from corpusflow.llm.common import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality discriminant accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of the largest id."""
    return exact_dedup.drop_duplicates(docs, exact_dedup.fresh_index(spark, docs.schema["doc_id"].dataType))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles, that of the smallest id."""
    return ngram_join.keep_one(docs, n=5, num=8, den=10)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text they decode to."""
    return bpe.digests(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("ngram_join", without_near_copies),
          ("decontamination", without_benchmark), ("bpe", token_ids)]

#: Neither the discriminant nor the encoding can be stated in SQL; tests check the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
