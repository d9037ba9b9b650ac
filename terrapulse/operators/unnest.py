"""Row generation from computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column, name: str) -> DataFrame:
    """One row per array element.

    A plain ``explode`` makes the optimiser infer ``size(array) > 0`` and push it to the scan with
    the whole array expression inlined, so a costly array is built twice or more. The outer form
    has no such inferred filter; empty arrays are dropped afterwards.
    """
    return df.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())
