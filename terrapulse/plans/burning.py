"""Prescribed-burning aptitude on a grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.functions import scoring as S
from terrapulse.operators import raster as R
from terrapulse.session import checkpointed

# Criterion weights; an absent criterion drops out of the weighted mean.
WEIGHTS = {"combustible": 25.0, "embroussaillement": 25.0, "slope": 20.0, "access": 15.0}
#: How each criterion's raster becomes a share of 1.
CRITERIA = {
    "slope": lambda v: S.band(v, 15.0, 40.0, 10.0),
    "access": lambda v: v,
    "embroussaillement": lambda v: S.rescale(v, 0.0, 0.01),
    "combustible": lambda v: S.rescale(v, 0.0, -2.0),
}


@dataclass
class AptitudeProducts:
    cells: DataFrame
    summary: DataFrame
    criteria: list[str]


def class_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.count_if(F.col("classe") == 2).alias("n_prioritaire"),
        F.count_if(F.col("classe") == 1).alias("n_a_etudier"),
        F.count_if(F.col("classe") == 0).alias("n_a_exclure"),
    )


def run(
    cells: DataFrame,
    slope: DataFrame,
    roads: DataFrame,
    buildings: DataFrame,
    step: float,
    trend: DataFrame | None = None,
    drought: DataFrame | None = None,
    exclusion_m: float = 100.0,
    access_max_m: float = 500.0,
    weights: dict[str, float] | None = None,
) -> AptitudeProducts:
    """Aptitude 0..100 and class of every cell.

    ``cells`` holds ``(col, row)``; ``slope`` adds a slope in percent, ``trend`` and ``drought``
    (optional) a value, all on the same grid. ``roads`` and ``buildings`` carry ``geom``. Cells near
    a building score 0; a missing raster value counts as 0.
    """
    w = {**WEIGHTS, **(weights or {})}
    road_cells = R.presence_mask(roads, "geom", step, lines=True)
    scored = R.access_from_cells(cells, road_cells, step, access_max_m)
    scored = scored.join(slope.select("col", "row", "slope"), ["col", "row"], "left")
    near = R.exclusion_cells(buildings, "geom", step, exclusion_m).withColumn("_x", F.lit(True))
    scored = scored.join(near, ["col", "row"], "left")
    for name, raster in (("embroussaillement", trend), ("combustible", drought)):
        if raster is not None:
            scored = scored.join(raster.select("col", "row", F.col("value").alias(name)), ["col", "row"], "left")
    present = {name: measure for name, measure in CRITERIA.items() if name in scored.columns}
    criteria = [(measure(F.coalesce(name, F.lit(0.0))), w[name]) for name, measure in present.items()]
    score = S.aptitude(criteria, F.coalesce("_x", F.lit(False)))
    out = scored.withColumn("score", score).withColumn("classe", S.three_classes(F.col("score")))
    out = out.drop("_x")
    return AptitudeProducts(out, class_summary(out), list(present))


def run_rasters(
    spark: SparkSession,
    box: tuple[float, float, float, float],
    elevation: DataFrame,
    elevation_step: float,
    roads: DataFrame,
    buildings: DataFrame,
    step: float,
    **options,
) -> AptitudeProducts:
    """Aptitude of a box from raw layers: the grid is laid, the elevation resampled to it and its slope taken.

    ``elevation`` is ``(col, row, z)`` with cells of ``elevation_step`` from the origin of the coordinates.
    """
    minx, miny, maxx, maxy = box
    low = [math.floor(v / step) for v in (minx, miny)]
    size = [max(1, math.ceil(high / step) - at) for high, at in zip((maxx, maxy), low)]
    cell = spark.range(size[0] * size[1]).select((F.col("id") % size[0] + low[0]).alias("col"), (F.floor(F.col("id") / size[0]) + low[1]).alias("row"))
    placed = cell.withColumns({a: (F.col(c) + 0.5) * step for a, c in (("x", "col"), ("y", "row"))})
    heights = checkpointed(R.resample_bilinear(elevation, placed, elevation_step))
    slope = R.slope_percent(heights.select("col", "row", "z"), step)
    return run(heights.select("col", "row"), slope, roads, buildings, step, **options)
