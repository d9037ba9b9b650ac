"""Activity statistics over dated events and byte shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_of(ts: Column) -> Column:
    """Monday of the ISO week."""
    return F.trunc(ts.cast("date"), "week")


def weekly_series(events: DataFrame, ts: str, weeks: int = 26, today: Column | None = None) -> DataFrame:
    """Event count of each of the last ``weeks`` weeks, empty weeks 0.

    ``today`` defaults to the current date.
    """
    spark = events.sparkSession
    last = week_of(today if today is not None else F.current_date())
    axis = spark.range(weeks).select(F.date_sub(last, (F.col("id") * 7).cast("int")).alias("week"))
    counts = events.groupBy(week_of(F.col(ts)).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return axis.join(counts, "week", "left").select(
        "week", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def weekday_histogram(events: DataFrame, ts: str) -> DataFrame:
    """Seven rows, Monday 0, zero-filled, with the first busiest day flagged."""
    days = events.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    counts = events.groupBy(F.weekday(F.col(ts)).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    filled = days.join(counts, "weekday", "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )
    best = filled.agg(F.min_by("weekday", F.struct(-F.col("n"), F.col("weekday"))).alias("w"))
    is_peak = (F.col("weekday") == best.scalar()) & (F.col("n") > 0)
    return filled.withColumn("is_peak", is_peak)


def top_shares(df: DataFrame, category: str, size: str, keep: int = 5, rest: str = "Autres") -> DataFrame:
    """Sizes of the ``keep`` largest categories plus one row for the rest, with shares in percent.

    Only the ``keep`` names of the top list are broadcast.
    """
    sums = df.groupBy(category).agg(F.sum(size).alias("bytes"))
    top = sums.orderBy(F.col("bytes").desc(), category).limit(keep)
    named = sums.join(
        F.broadcast(top.select(category, F.lit(True).alias("_top"))), category, "left"
    ).withColumn(category, F.when(F.col("_top"), F.col(category)).otherwise(F.lit(rest)))
    folded = named.groupBy(category).agg(F.sum("bytes").alias("bytes"))
    total = sums.agg(F.sum("bytes").alias("t")).scalar()
    return folded.withColumn("share_pct", F.lit(100.0) * F.col("bytes") / total)


def activity_totals(events: DataFrame, ts: str) -> DataFrame:
    """Event count and number of distinct active days."""
    daily = events.groupBy(F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("active_days"))
