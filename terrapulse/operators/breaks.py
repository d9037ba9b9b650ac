"""Pettitt change point per pixel, as rank and running-sum windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def break_table(
    monthly: DataFrame, min_valid: int = 8, pixel: str = "pixel_id", value: str = "v"
) -> DataFrame:
    """``(pixel, break_index, break_pvalue, break_direction)``.

    The rank sum of a value is (values below) - (values above) within its series; its running sum
    along the months is the statistic, and missing months add 0. Index and p-value are NULL and the
    direction 0 below ``min_valid`` values.
    """
    v = F.col(value)
    whole = Window.partitionBy(pixel)
    by_value = Window.partitionBy(pixel, F.col("v").isNull()).orderBy("v")
    along = Window.partitionBy(pixel).orderBy("mi").rowsBetween(Window.unboundedPreceding, 0)
    ranked = monthly.select(pixel, "mi", v.alias("v")).withColumns(
        {
            "n": F.count("v").over(whole),
            "below": F.rank().over(by_value) - 1,
            "upto": F.count(F.lit(1)).over(
                by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        }
    )
    above = F.col("n") - F.col("upto")
    lead = F.when(F.col("v").isNotNull(), F.col("below") - above).otherwise(0)
    summed = ranked.withColumn("u", F.sum(lead).over(along))
    best = F.min(F.struct((-F.abs("u")).alias("size"), F.col("mi").alias("k"))).over(whole)
    located = summed.withColumn("best", best)
    stats = located.groupBy(pixel).agg(
        F.first("n").alias("n"),
        F.first("best.k").alias("k"),
        F.first(-F.col("best.size")).cast("double").alias("size"),
        F.avg(F.when(F.col("mi") <= F.col("best.k"), F.col("v"))).alias("mean_before"),
        F.avg(F.when(F.col("mi") > F.col("best.k"), F.col("v"))).alias("mean_after"),
    )
    n = F.col("n").cast("double")
    p = F.lit(2.0) * F.exp(
        F.lit(-6.0) * F.col("size") * F.col("size") / F.nullif(n * n * n + n * n, F.lit(0.0))
    )
    enough = F.col("n") >= min_valid
    direction = F.signum(F.col("mean_after") - F.col("mean_before"))
    return stats.select(
        pixel,
        F.when(enough, F.col("k")).cast("int").alias("break_index"),
        F.when(enough, F.least(p, F.lit(1.0))).alias("break_pvalue"),
        F.coalesce(F.when(enough, direction), F.lit(0.0)).alias("break_direction"),
    )


def break_year(breaks: DataFrame, axis, alpha: float = 0.05) -> DataFrame:
    """Adds ``break_year``: the calendar year of a significant break, else NULL.

    ``axis`` is the scalar month array; the index is clipped to it.
    """
    last = F.size(axis) - 1
    position = F.least(F.greatest(F.col("break_index"), F.lit(0)), last)
    year = F.year(F.element_at(axis, position + 1))
    significant = F.col("break_index").isNotNull() & (F.col("break_pvalue") < alpha)
    return breaks.withColumn("break_year", F.when(significant, year))
