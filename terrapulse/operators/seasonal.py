"""Calendar-month statistics of dense monthly series: climatology, anomaly, VCI, deseasonalising.

All windows are keyed by pixel and calendar month on data already partitioned by pixel, so they
share the exchange that built the dense axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monthly_climatology(monthly: DataFrame, pixel: str = "pixel_id", value: str = "v") -> DataFrame:
    return monthly.groupBy(pixel, F.month("month").alias("moy")).agg(
        F.avg(value).alias("clim_mean"),
        F.stddev_pop(value).alias("clim_std"),
        F.min(value).alias("clim_min"),
        F.max(value).alias("clim_max"),
    )


def _season(pixel: str):
    return Window.partitionBy(pixel, F.month("month"))


def _difference(pixel: str, value: str = "v") -> Column:
    """Rounded to eight decimals: equal differences tie whatever the order in which their means were summed up."""
    return F.round(F.col(value) - F.avg(value).over(_season(pixel)), 8)


def deseasonalize(monthly: DataFrame, pixel: str = "pixel_id", value: str = "v") -> DataFrame:
    return monthly.withColumn(value, _difference(pixel, value))


def has_multiple_years(monthly: DataFrame) -> bool:
    """True when the axis spans at least two calendar years (one small aggregate)."""
    span = monthly.agg((F.max(F.year("month")) - F.min(F.year("month"))).alias("years")).first()
    return (span["years"] or 0) >= 1


def series_for_trend(monthly: DataFrame, pixel: str = "pixel_id", obs: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Deseasonalised when the axis spans several years, else the raw series.

    The span is a subquery over the dates of ``obs``, the observations behind the composite (without them over the
    months), so nothing is computed while the plan is made.
    """
    year = F.year(ts) if obs is not None else F.year("month")
    span = (monthly if obs is None else obs).agg((F.max(year) - F.min(year)).alias("years")).scalar()
    return monthly.withColumn("v", F.when(span >= 1, _difference(pixel)).otherwise(F.col("v")))


def drought(monthly: DataFrame, pixel: str = "pixel_id", value: str = "v") -> DataFrame:
    """Adds ``anomaly`` (z-score, NULL when the history is constant) and ``vci`` (0..100)."""
    season = _season(pixel)
    v = F.col(value)
    spread = F.nullif(F.stddev_pop(v).over(season), F.lit(0.0))
    low, high = F.min(v).over(season), F.max(v).over(season)
    vci = F.lit(100.0) * (v - low) / F.nullif(high - low, F.lit(0.0))
    clipped = F.when(vci.isNotNull(), F.least(F.greatest(vci, F.lit(0.0)), F.lit(100.0)))
    return monthly.withColumns(
        {"anomaly": (v - F.avg(v).over(season)) / spread, "vci": clipped}
    )


def drought_per_pixel(droughts: DataFrame, pixel: str = "pixel_id") -> DataFrame:
    return droughts.groupBy(pixel).agg(
        F.avg("anomaly").alias("mean_anomaly"), F.min("vci").alias("min_vci")
    )


def drought_timeline(droughts: DataFrame) -> DataFrame:
    return droughts.groupBy("month").agg(F.avg("anomaly").alias("anomaly_mean"))


def driest_month(timeline: DataFrame) -> DataFrame:
    key = F.when(F.col("anomaly_mean").isNotNull(), F.struct("anomaly_mean", "month"))
    return timeline.agg(
        F.min_by("month", key).alias("month"), F.min("anomaly_mean").alias("anomaly_mean")
    )
