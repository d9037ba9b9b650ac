"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.session import checkpointed

__all__ = ["checkpointed", "digest_of", "query", "ship", "table", "texts", "QUERIES", "ORACLE"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query of the subpackage under ``name``."""

    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLE[name] = oracle
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"terrapulse-{context.applicationId}.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for part in sorted(root.glob("terrapulse/**/*.py")):
                archive.write(part, part.relative_to(root))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)


def texts(docs: DataFrame) -> DataFrame:
    """The id and the whole text, a null text as the empty one; other columns, whatever their names, stay behind."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))
