"""Hexagon mesh: coverage, protected share, proximity and priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import hexgrid as H
from terrapulse.functions import scoring as S
from terrapulse.operators import raster as R
from terrapulse.operators.spatial import nearest, point_box
from terrapulse.operators.unnest import unnest


def hex_grid(aoi: DataFrame, key: str, geom: str, edge: float) -> DataFrame:
    """``(key, cell, cx, cy)`` of the hexagons whose centre lies in each area.

    An area too small to hold a centre gets the one cell of its centroid.
    """
    b = G.bounds(geom)
    height = F.lit(edge * 1.5)
    width = F.lit(edge * H.SQRT3)
    rows = unnest(
        aoi.select(key, geom, b["minx"].alias("minx"), b["maxx"].alias("maxx")),
        F.sequence(F.floor(b["miny"] / height), F.ceil(b["maxy"] / height)),
        "r",
    )
    half = F.col("r") / F.lit(2.0)
    cells = unnest(
        rows,
        F.sequence(F.floor(F.col("minx") / width - half), F.ceil(F.col("maxx") / width - half)),
        "q",
    )
    cell = F.struct(F.col("q").cast("bigint").alias("q"), F.col("r").cast("bigint").alias("r"))
    cx, cy = H.cell_center(cell, edge)
    inside = (
        cells.select(key, geom, cell.alias("cell"), cx.alias("cx"), cy.alias("cy"))
        .where(G.contains_point(geom, "cx", "cy"))
        .drop(geom)
    )
    tiny = aoi.join(inside.select(key).distinct(), key, "left_anti")
    only = H.cell_of("_c.x", "_c.y", edge)
    ox, oy = H.cell_center(F.col("cell"), edge)
    fallback = tiny.withColumn("_c", G.center(geom)).select(key, only.alias("cell")).select(
        key, "cell", ox.alias("cx"), oy.alias("cy")
    )
    return inside.unionByName(fallback)


def protected_share(mesh: DataFrame, areas: DataFrame, geom: str, edge: float, step: float) -> DataFrame:
    """Adds ``enjeu``: share of each hexagon covered by the union of the protected areas.

    The union is sampled at points every ``step`` metres (a point under several areas counts once),
    and points are binned to hexagons by a key expression; an absent layer gives 0.
    """
    points = R.presence_mask(areas, geom, step)
    x, y = (f"({axis} + 0.5D) * {G.num(step)}" for axis in ("col", "row"))
    per_cell = points.groupBy(H.cell_of(x, y, edge).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    hexagon_m2 = 1.5 * H.SQRT3 * edge * edge
    share = S.clip01(F.col("n") * F.lit(step * step / hexagon_m2))
    return (
        mesh.join(per_cell, "cell", "left")
        .withColumn("enjeu", F.coalesce(share, F.lit(0.0)))
        .drop("n")
    )


def proximity(
    mesh: DataFrame, features: DataFrame, geom: str, fid: str, max_m: float, name: str
) -> DataFrame:
    """Adds ``name = clip(1 - d/max_m, 0, 1)`` from the cell centre to the nearest feature."""
    keyed = mesh.select(F.col("cell"), "cx", "cy").distinct()
    targets = features.select(F.col(fid).alias("_fid"), F.col(geom).alias("_fgeom"))
    b = G.bounds("_fgeom")
    found = nearest(
        keyed,
        targets,
        point_box("cx", "cy"),
        (b["minx"], b["miny"], b["maxx"], b["maxy"]),
        G.point_distance("_fgeom", "cx", "cy"),
        "cell",
        "_fid",
        first_radius=max_m / 16.0,
        max_radius=max_m,
    )
    score = S.clip01(F.lit(1.0) - F.col("d") / F.lit(float(max_m)))
    return (
        mesh.join(found.select("cell", "d"), "cell", "left")
        .withColumn(name, F.coalesce(score, F.lit(0.0)))
        .drop("d")
    )


def browning_by_cell(pixels: DataFrame, cell: Column, scale: float = 0.01) -> DataFrame:
    """``(cell, degradation)`` from the mean slope of the valid pixels in each hexagon."""
    mean = pixels.groupBy(cell.alias("cell")).agg(F.avg("sen_slope").alias("mean_slope"))
    return mean.select("cell", S.degradation(F.col("mean_slope"), scale).alias("degradation"))


def score_mesh(mesh: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Adds ``score`` (geometric mean of the axes) and ``classe``; a missing axis value counts 0."""
    filled = mesh.withColumns({a: F.coalesce(F.col(a), F.lit(0.0)) for a in axes})
    scored = filled.withColumn("score", S.priority_score([F.col(a) for a in axes]))
    return scored.withColumn("classe", S.three_classes(F.col("score")))


def mesh_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("n_hexagons"),
        F.count_if(F.col("classe") == 2).alias("n_prioritaire"),
        F.count_if(F.col("classe") == 1).alias("n_a_etudier"),
    )
