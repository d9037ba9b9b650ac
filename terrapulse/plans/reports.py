"""Report tables: rankings, histograms, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_ranking(df: DataFrame, label: str, score: str, alias: str) -> DataFrame:
    """Count and rounded mean score per class, best first."""
    per_class = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 1).alias(alias)
    )
    return per_class.orderBy(F.col(alias).desc(), label)


def rejection_histogram(df: DataFrame, reason: str) -> DataFrame:
    """Count and share per reason; the window sees one row per reason."""
    counts = df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.lit(100.0) * F.col("n") / total)


def top_report(df: DataFrame, score: str, key: str, limit: int = 20) -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(key)).limit(limit)


def funnel_retention(counts: DataFrame) -> DataFrame:
    """The one-row funnel counts as rows ``(step, n, pct)``."""
    steps = counts.columns
    pairs = F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("n")) for s in steps])
    base = F.nullif(F.col(steps[0]).cast("double"), F.lit(0.0))
    rows = counts.select(base.alias("_base"), F.explode(pairs).alias("p"))
    pct = F.coalesce(F.lit(100.0) * F.col("p.n") / F.col("_base"), F.lit(0.0))
    return rows.select("p.step", "p.n", pct.alias("pct"))
