"""Vegetation watch: composites, trend, break year, drought, zone statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from terrapulse.functions import indices as I
from terrapulse.operators import breaks as B
from terrapulse.operators import composite as C
from terrapulse.operators import raster as R
from terrapulse.operators import seasonal as SE
from terrapulse.operators import trend as T
from terrapulse.operators import zonal as Z
from terrapulse.session import bucketed


@dataclass
class VegetationProducts:
    """Tables of one run; ``breaks`` exists for multi-year cubes, ``zone_stats`` when zones are given."""

    monthly: DataFrame
    trend: DataFrame
    breaks: DataFrame | None
    drought: DataFrame
    timeline: DataFrame
    zone_stats: DataFrame | None


def scene_values(cube: DataFrame) -> DataFrame:
    """``(pixel_id, ts, v)`` from raw bands: reflectance, scene mask, index; ``lon`` and ``scene`` come along."""
    scaled = I.harmonize_reflectance(cube)
    masked = I.masked_ndvi(scaled["red"], scaled["nir"], scaled["scl"])
    return scaled.select("pixel_id", "ts", *[c for c in ("lon", "scene") if c in cube.columns], masked.alias("v"))


def pixel_zones(pixels: DataFrame, zones: DataFrame, step: float, zone: str = "zone") -> DataFrame:
    """``(pixel_id, zone)`` of the pixels that a zone's polygon touches; of several zones the higher one."""
    burned = R.rasterize_zones(zones, zone, "geom", step)
    return pixels.select("pixel_id", "col", "row").join(burned, ["col", "row"]).select("pixel_id", zone)


def run_scenes(
    scenes: DataFrame,
    pixels: DataFrame | None = None,
    zones: DataFrame | None = None,
    step: float = 1.0,
    zone: str = "zone",
    **options,
) -> VegetationProducts:
    """Every product from raw bands ``(pixel_id, ts, lon, scene, red, nir, scl)``.

    Scenes of one solar day are fused. ``pixels`` places the pixels on the grid (``pixel_id, col, row``), onto which
    the polygons of ``zones`` (``zone, nom, geom``) are burned.
    """
    fused = C.fuse_solar_day(scene_values(scenes)).withColumnRenamed("day", "ts")
    placed = pixel_zones(pixels, zones, step, zone) if pixels is not None and zones is not None else None
    return run(fused, placed, None if placed is None else zones.drop("geom"), zone, **options)


def run(
    obs: DataFrame,
    pixel_zone: DataFrame | None = None,
    zones: DataFrame | None = None,
    zone: str = "zone",
    fill_max_gap: int = 0,
    alpha: float = 0.05,
    min_valid: int = 6,
) -> VegetationProducts:
    """Every product of a cube ``(pixel_id, ts, v)``.

    The dense monthly table is stored once, in buckets of pixels: the trend, break and drought
    branches all read it and exchange nothing by pixel. Single-year cubes are neither deseasonalised
    nor searched for breaks.
    """
    monthly = bucketed(C.build_monthly(obs, fill_max_gap), "pixel_id")
    several = SE.has_multiple_years(monthly)
    series = SE.deseasonalize(monthly) if several else monthly
    trend = T.trend_table(series, alpha, min_valid)
    breaks = None
    if several:
        found = B.break_table(series, min_valid)
        breaks = B.break_year(found, C.month_axis(obs), alpha)
    droughts = SE.drought(monthly)
    per_pixel = SE.drought_per_pixel(droughts)
    stats = None
    if zones is not None and pixel_zone is not None:
        stats = Z.zone_statistics(trend.join(per_pixel, "pixel_id"), pixel_zone, zones, zone)
    return VegetationProducts(
        monthly, trend, breaks, per_pixel, SE.drought_timeline(droughts), stats
    )
