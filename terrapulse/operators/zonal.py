"""Zone statistics and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The named rankings (metric, ascending).
RANKINGS = {
    "top_greening": ("mean_sen_slope", False),
    "top_browning": ("mean_sen_slope", True),
    "driest": ("mean_anomaly", True),
}
REDUCERS = {"mean": F.avg, "min": F.min, "max": F.max}


def class_fraction(label: Column, target: int) -> Column:
    """Share in percent of the valid classes equal to ``target``; NULL without a valid class."""
    return F.lit(100.0) * F.count_if(label == target) / F.nullif(F.count(label), F.lit(0))


def zonal(pixels: DataFrame, pixel_zone: DataFrame, zones: DataFrame, zone: str, **stats: Column):
    """Aggregates of the pixels of each zone, every zone present.

    Pixel values meet their zone on the pixel key, aggregate by zone with map-side combine, and the
    zone table is joined last, on a result no larger than itself.
    """
    pixel = next(c for c in pixel_zone.columns if c != zone)
    reduced = pixels.join(pixel_zone, pixel).groupBy(zone).agg(*[c.alias(n) for n, c in stats.items()])
    return zones.join(reduced, zone, "left")


def zonal_reduce(pixels, pixel_zone, zones, zone, value: str, reducer: str) -> DataFrame:
    return zonal(pixels, pixel_zone, zones, zone, **{value: REDUCERS[reducer](value)})


def zone_statistics(
    pixels: DataFrame, pixel_zone: DataFrame, zones: DataFrame, zone: str
) -> DataFrame:
    """Mean slope, greening and browning shares and, when present, drought statistics."""
    stats = {
        "mean_sen_slope": F.avg("sen_slope"),
        "pct_greening": class_fraction(F.col("trend_class"), 1),
        "pct_browning": class_fraction(F.col("trend_class"), -1),
    }
    if "mean_anomaly" in pixels.columns:
        stats["mean_anomaly"] = F.avg("mean_anomaly")
    if "min_vci" in pixels.columns:
        stats["min_vci"] = F.min("min_vci")
    return zonal(pixels, pixel_zone, zones, zone, **stats)


def rank_zones(
    stats: DataFrame, metric: str, zone: str, ascending: bool = False, limit: int = 10
) -> DataFrame:
    """Top zones by a metric (a ranking report), NULLs left out, ties broken by the zone id."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return stats.where(F.col(metric).isNotNull()).orderBy(order, F.col(zone)).limit(limit)


def rank_zones_within(
    stats: DataFrame, within: str, metric: str, zone: str, ascending: bool = False, limit: int = 10
) -> DataFrame:
    """The top zones of each ``within`` (a year), with their ``rank``; zones of one year are one group."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    place = F.row_number().over(Window.partitionBy(within).orderBy(order, F.col(zone)))
    ranked = stats.where(F.col(metric).isNotNull()).withColumn("rank", place)
    return ranked.where(F.col("rank") <= limit)


def named_ranking(stats: DataFrame, name: str, zone: str, limit: int = 10) -> DataFrame:
    metric, ascending = RANKINGS[name]
    return rank_zones(stats, metric, zone, ascending, limit)


def slope_signs(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count_if(F.col("mean_sen_slope") > 0).alias("n_greening"),
        F.count_if(F.col("mean_sen_slope") < 0).alias("n_browning"),
    )


def class_distribution(df: DataFrame, column: str, labels: dict[int, str]) -> DataFrame:
    """Row count per class label (fixed label map)."""
    named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.groupBy(F.try_element_at(named, F.col(column)).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
