"""Monthly composites on a dense month axis, and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.operators.quantiles import grouped_quantile


def month_of(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def month_axis(obs: DataFrame, ts: str = "ts") -> Column:
    """Scalar array of month starts from the first to the last observation of the cube."""
    months = obs.agg(F.min(month_of(F.col(ts))).alias("lo"), F.max(month_of(F.col(ts))).alias("hi"))
    return months.select(F.expr("sequence(lo, hi, interval 1 month)").alias("axis")).scalar()


def densify(monthly: DataFrame, axis: Column, pixel: str, columns: list[str]) -> DataFrame:
    """One row per pixel and month of ``axis``; absent months get NULL.

    The values of a pixel are packed into one map (bounded by the calendar, not by the data) and
    unpacked along the axis, so the pixel axis is shuffled once and stays partitioned by pixel. As many partitions as
    the session has for shuffles are named, since Spark would put packed ones together by their size, which tells
    little of the rows that a task unpacks and sorts.
    """
    entry = F.struct("month", F.struct(*columns))
    count = int(monthly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = monthly.repartition(count, pixel).groupBy(pixel).agg(F.map_from_entries(F.collect_list(entry)).alias("by_month"))
    rows = packed.select(pixel, "by_month", F.posexplode(axis).alias("mi", "month"))
    found = F.try_element_at(F.col("by_month"), F.col("month"))
    return rows.select(pixel, "month", "mi", *[found.getField(c).alias(c) for c in columns])


def monthly_median(
    obs: DataFrame,
    pixel: str = "pixel_id",
    ts: str = "ts",
    value: str = "v",
) -> DataFrame:
    """Median and valid count per pixel and month: ``(pixel, month, mi, v, valid_count)``.

    Months without a valid value are NULL with count 0, and the axis is dense between the first and
    last month of the whole cube.
    """
    named = obs.select(
        F.col(pixel), month_of(F.col(ts)).alias("month"), F.col(value).cast("double").alias("v")
    )
    valid = F.count("v").alias("valid_count")
    joined = grouped_quantile(named, [pixel, "month"], "v", 0.5, "v_median", [valid])
    joined = joined.withColumnRenamed("v_median", "v")
    dense = densify(joined, month_axis(obs, ts), pixel, ["v", "valid_count"])
    return dense.withColumn("valid_count", F.coalesce("valid_count", F.lit(0).cast("bigint")))


def valid_count_per_month(
    obs: DataFrame, pixel: str = "pixel_id", ts: str = "ts", value: str = "v"
) -> DataFrame:
    counts = obs.groupBy(pixel, month_of(F.col(ts)).alias("month")).agg(
        F.count(value).alias("valid_count")
    )
    dense = densify(counts, month_axis(obs, ts), pixel, ["valid_count"])
    return dense.withColumn("valid_count", F.coalesce("valid_count", F.lit(0).cast("bigint")))


def fill_temporal_gaps(
    monthly: DataFrame, max_gap: int = 1, pixel: str = "pixel_id", value: str = "v"
) -> DataFrame:
    """Linear interpolation of interior runs of at most ``max_gap`` missing months."""
    if max_gap <= 0:
        return monthly
    order = Window.partitionBy(pixel).orderBy("mi")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("mi").alias("i"), F.col(value).alias("y")))
    bracketed = monthly.withColumns(
        {
            "_prev": F.last(known, ignorenulls=True).over(before),
            "_next": F.first(known, ignorenulls=True).over(after),
        }
    )
    width = F.col("_next.i") - F.col("_prev.i")
    line = F.col("_prev.y") + (F.col("_next.y") - F.col("_prev.y")) * (
        F.col("mi") - F.col("_prev.i")
    ) / F.nullif(width.cast("double"), F.lit(0.0))
    filled = F.coalesce(F.col(value), F.when(width <= max_gap + 1, line))
    return bracketed.withColumn(value, filled).drop("_prev", "_next")


def build_monthly(obs: DataFrame, fill_max_gap: int = 0, pixel: str = "pixel_id") -> DataFrame:
    """Monthly median, optionally with short gaps filled."""
    return fill_temporal_gaps(monthly_median(obs, pixel), fill_max_gap, pixel)


def fuse_solar_day(
    obs: DataFrame, pixel: str = "pixel_id", ts: str = "ts", lon: str = "lon", value: str = "v",
    scene: str = "scene",
) -> DataFrame:
    """One value per pixel and solar day: the first valid one in scene order."""
    shift = F.make_dt_interval(secs=(F.col(lon) / F.lit(15.0) * 3600.0).cast("bigint"))
    day = F.to_date(F.col(ts) + shift)
    order = F.when(F.col(value).isNotNull(), F.struct(ts, scene))
    return obs.groupBy(pixel, day.alias("day")).agg(F.min_by(value, order).alias(value))
