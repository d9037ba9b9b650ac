"""The corpus pipeline: documents to packed sequences, each stage one operator of the text subpackage.

A stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns what the next one reads; all but the
last return the columns of documents. A null text counts as an empty one in every stage: neither toxic nor leaked, a
near copy of the other empty ones (the smallest id of them stays), one piece of one token. An empty table goes through
as one; columns besides those of documents come along, whatever their names. The folder of ``run`` holds what it
returns; the stages before the last are deleted when the last one is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm.common import query, table
from terrapulse.llm.leaks import without_leaks
from terrapulse.llm.near_copies import near_copies
from terrapulse.llm.packing import pack
from terrapulse.llm.secrets import redact
from terrapulse.llm.simhash import near_duplicates
from terrapulse.llm.toxicity import fit, scorer
from terrapulse.session import checkpoint_root

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own value of that setting, and the one of the stages.
SPARKS_BATCH, OWN_BATCH = "67108864b", "4m"


def small_batches(stage: Callable) -> Callable:
    """Texts go to Python in batches of a few megabytes: each is held by the executor, the worker and as strings at once.

    A setting of the session, since batches are cut when a stage is written; another value than Spark's own stays.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_BYTES) == SPARKS_BATCH:
            spark.conf.set(BATCH_BYTES, OWN_BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Repeated rows and null ids are judged by their text, long texts as a whole; without labels nothing goes.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(scorer(spark, model)("text") < 0.5)


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Groups are those of op5's prints (four or fewer differing bits), and those of five-word shingles (Jaccard similarity
    0.8 or more), which hold the near copies that such prints miss: a document goes if either has a smaller id in its group.
    Of rows of one id all stay or go. Rows without an id stand for no group: of a group of such rows alone, all stay.
    """
    groups = near_duplicates(docs).select("doc_id", "component_id").unionByName(near_copies(docs))
    late = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(late, docs["doc_id"] == late["doc_id"], "left_anti")


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that tell a passage of the benchmark go, whether one item or several; without items nothing goes."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets replaced by a mark."""
    return redact(docs)


@small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", packing),
]

#: No stage is expressible in SQL: each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    for number, (name, _) in enumerate(STAGES[:-1]):
        _delete(spark, f"{folder}/{number}-{name}")
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of this run from whatever store the checkpoints are in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


query("pipeline")(run)
