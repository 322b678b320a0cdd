"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coder import LibraryCoder, text_slices
from .shared import map_rows, new_path, path_exists, stage, text_or_empty

BLANKS, UPPER = "\t\n\r\f\v", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: counts of one version are never read for another."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    """Text that has the same count: letter case and the kind of white space go where the tokenizer itself drops them.

    Texts that may hold a special string keep their case, since such strings are matched before the tokenizer's own folding.
    """
    with open(path, encoding="utf-8") as f:
        steps = [x["type"] for x in (json.load(f)["normalizer"] or {}).get("normalizers", [])]
    if steps != ["NFC", "Replace", "Lowercase"]:
        return text
    folded = F.translate(text, UPPER + BLANKS, UPPER.lower() + " " * len(BLANKS))
    return F.when(F.contains(text, F.lit("<|")), text).otherwise(folded)


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, cache: str | None = None) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit), digest.

    cache is a Parquet folder (digest, tokenizer, n_tokens) that is read if it exists and appended to; without it the call
    gets one of its own in the shared folder. Each distinct normalised text that the cache lacks is encoded once, however many
    documents hold it: copies meet by digest, first within map tasks. Null texts count as empty (0 bytes, 0 tokens); empty
    tables give empty results; repeated rows each keep their row; texts of any length are encoded whole; other columns are not
    read. What the call stages stays in the shared folder, since the result reads it (see shared.scratch).
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    cache = cache or new_path(spark, "token-cache")
    text = text_or_empty(docs, text_col)
    rows = docs.select(docs[id_col].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(normalised(text, tokenizer), 256)).alias("digest"))
    wanted = docs.select(normalised(text, tokenizer).alias("text")).select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")

    def known() -> DataFrame:
        stored = spark.read.schema("digest binary, tokenizer string, n_tokens long").parquet(cache)
        return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    if path_exists(spark, cache):
        wanted = wanted.join(known(), "digest", "left_anti")
    misses = wanted.groupBy("digest").agg(F.any_value("text").alias("text"))

    def make():
        coder = LibraryCoder(tokenizer)
        return lambda part: {"digest": part["digest"], "n_tokens": coder.count(part["text"])}

    fresh = map_rows(misses, make, "digest binary, n_tokens long", text_slices).select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
    fresh.write.mode("append").option("compression", "zstd").parquet(cache)
    # staged, so that both sides of the join are plain exchanges: Spark splits a digest that many documents share
    return rows.join(stage(known(), "token-counts"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.hex("digest").alias("digest"))
