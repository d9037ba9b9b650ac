"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm.common import digest_of, query, table, texts
from terrapulse.llm.tokens import encoder
from terrapulse.session import checkpoint_root

CACHE = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """A digest of the vocabulary file and the library that reads it: counts of another version are never reused."""
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


def normalised(text):
    """White-space runs as one space, none at the ends: these vocabularies drop white space, so counts are the same."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``cache`` is a folder that all executors reach; it holds the count of each normalised content and tokenizer
    version seen so far. Only distinct contents that are missing are encoded, and their counts appended, before
    documents are joined to them. A null text counts as the empty one (0 tokens), repeated rows and null ids keep
    their rows, an empty table gives no rows, other columns are ignored.
    """
    spark, version = docs.sparkSession, tokenizer_version(vocabulary)
    rows = texts(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), normalised(F.col("text")).alias("content"))
    rows = rows.withColumn("digest", digest_of(F.col("content")))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        kept = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
        return kept.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may append the same content

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(vocabulary)
        for batch in batches:
            counts = [len(words.ids(text)) // 4 for text in batch["content"]]
            yield pd.DataFrame({"version": version, "digest": batch["digest"], "n_tokens": counts})

    missing = rows.groupBy("digest").agg(F.first("content").alias("content")).join(stored(), "digest", "left_anti")
    missing.mapInPandas(encode, CACHE).write.mode("append").parquet(cache)
    counted = rows.select("doc_id", "n_bytes", "digest").join(stored(), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = f"{checkpoint_root(spark)}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)
