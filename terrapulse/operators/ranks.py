"""Percentile rank of a score without a single-task sort of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.operators.quantiles import coarse_bucket


def percentile_of_score(df: DataFrame, score: str, alias: str = "percentile_score") -> DataFrame:
    """Adds ``100 * percent_rank`` of ``score``, whatever its values.

    Rows are counted per distinct score; a score falls into an order-preserving bucket and a bucket
    into a stretch of 4096. The counts before a score are those of the stretches, of the buckets of
    its stretch and of the scores of its bucket before it: only the window over the stretches, at
    most a few thousand rows (one per sign and binary exponent), is not partitioned.
    """
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_bucket", coarse_bucket(F.col(score).cast("double")))
    counts = counts.withColumn("_stretch", F.floor(F.col("_bucket") / 4096))

    def before(rows: DataFrame, keys: list[str], order: str, alias: str) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(alias, F.coalesce(F.sum("_n").over(upto), F.lit(0)))

    buckets = counts.groupBy("_stretch", "_bucket").agg(F.sum("_n").alias("_n"))
    stretches = buckets.groupBy("_stretch").agg(F.sum("_n").alias("_n"))
    total = stretches.agg(F.sum("_n")).scalar()
    lower = before(stretches, [], "_stretch", "_s").select("_stretch", "_s")
    middle = before(buckets, ["_stretch"], "_bucket", "_b").select("_stretch", "_bucket", "_b")
    ranked = before(counts, ["_bucket"], score, "_v").join(middle, ["_stretch", "_bucket"]).join(lower, "_stretch")
    rank = (F.col("_s") + F.col("_b") + F.col("_v")) / F.nullif((total - 1).cast("double"), F.lit(0.0))
    return df.join(ranked.select(score, (F.lit(100.0) * F.coalesce(rank, F.lit(0.0))).alias(alias)), score)
