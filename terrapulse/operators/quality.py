"""Assertions run after the siting job, each a one-row aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.functions import scoring as S


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each id, without a global distinct set."""
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))


def violations(df: DataFrame, broken: Column) -> DataFrame:
    return df.agg(F.count_if(broken).alias("violations"))


def score_out_of_range(score: Column) -> Column:
    return (score < 0) | (score > S.TOTAL_MAX)


def class_mismatch(label: Column, score: Column) -> Column:
    return (
        ((label == "Premium") & (score < S.PREMIUM_MIN))
        | ((label == "Bon") & ((score < S.GOOD_MIN) | (score >= S.PREMIUM_MIN)))
        | ((label == "Moyen") & (score >= S.GOOD_MIN))
    )


def funnel_counts(audit: DataFrame, passes: list[str]) -> DataFrame:
    """One row: the base count and the survivors of each step."""
    steps = [F.count_if(F.col(p)).alias(f"n_{p}") for p in passes]
    return audit.agg(F.count(F.lit(1)).alias("n_base"), *steps)


def funnel_is_decreasing(counts: DataFrame) -> DataFrame:
    names = counts.columns
    tests = [F.col(a) >= F.col(b) for a, b in zip(names, names[1:])]
    return counts.select(reduce(lambda a, b: a & b, tests).alias("ok"))


def heatmap_gap(heatmap: DataFrame, eligible: DataFrame) -> DataFrame:
    """Difference between the heat-map total and the number of eligible rows."""
    total = heatmap.agg(F.coalesce(F.sum("count_eligibles"), F.lit(0)).alias("n"))
    rows = eligible.agg(F.count(F.lit(1)).alias("n"))
    return total.select((F.col("n") - rows.scalar()).alias("violations"))


def at_least_one(df: DataFrame) -> DataFrame:
    return df.agg((F.count(F.lit(1)) > 0).alias("ok"))


def department_coverage(df: DataFrame) -> DataFrame:
    """Per department: rows, passing rows and rows whose free area exceeds their area."""
    return df.groupBy("dept").agg(
        F.count(F.lit(1)).alias("n_parcels"),
        F.count_if("eligible").alias("n_passing"),
        F.count_if(F.col("surface_libre_m2") > F.col("surface_m2")).alias("n_free_above_area"),
    )
