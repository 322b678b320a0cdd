"""Corpus pipeline over documents: language, toxicity, near duplicates, packing.

Each stage is a function (spark, docs, sf_dir) to a DataFrame that is written as Parquet in the shared folder and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm import language_id, packing, simhash, toxicity
from weft.llm.shared import new_path, scratch, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: no letter, or unlike every language that it knows."""
    return language_id.keep_accepted(docs, language_id.train(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorization machine takes for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of SimHash near duplicates."""
    return simhash.keep_firsts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0, with_ids=False)


STAGES = [("language_id", language), ("toxicity", clean), ("simhash_dedup", distinct), ("packing", packed)]

#: SQL can express neither the models nor the fingerprints; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage stages for itself is deleted when its own table is written; that table stays for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        with scratch(spark):
            docs = stage(step(spark, docs, sf_dir), name, new_path(spark, f"pipeline-{name}"))
    return docs
