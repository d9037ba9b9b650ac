"""Areas of interest: registry rows, commune layer, outline."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.functions import crs as P
from terrapulse.functions import geometry as G
from terrapulse.operators import overlay as O
from terrapulse.operators.spatial import in_box, touching
from terrapulse.sources.layers import stack_layers

Box = tuple[float, float, float, float]


def area_id(kind: str, name: str, geom: str) -> Column:
    """Stable identifier: code for a commune or department, corners for a box, stem for a file,
    outline digest otherwise."""
    kind, name, b = F.col(kind), F.col(name), G.bounds(geom)
    corners = F.format_string("%.4f_%.4f_%.4f_%.4f", b["minx"], b["miny"], b["maxx"], b["maxy"])
    digest = F.substring(F.md5(F.to_json(F.struct(F.col(geom).alias("g")))), 1, 10)
    part = F.when(kind == "bbox", corners).when(kind == "gdf", digest).otherwise(name)
    return F.concat(kind, F.lit("-"), part)


def register(areas: DataFrame, projected: bool = False) -> DataFrame:
    """``(aoi_id, label, kind, geom, bbox_wgs84)`` rows; the box is in degrees, rounded to 6 decimals.

    Outlines are in degrees, or ``projected`` in metres. The corners of the latter are turned into degrees one by
    one: in a conic projection the box of an outline isn't the box of two of its corners.
    """

    def ends(x: str, y: str) -> Column:
        def spot(e: Column) -> Column:
            x_y = P.l93_to_wgs84(e[x], e[y]) if projected else (e[x], e[y])
            return F.struct(*[c.alias(n) for c, n in zip(x_y, "xy")])

        return F.transform("geom", spot)

    corners = F.concat(ends("x1", "y1"), ends("x2", "y2"))
    along = {n: F.transform(corners, lambda p: p[n]) for n in "xy"}
    picks = [pick(along[n]) for pick in (F.array_min, F.array_max) for n in "xy"]
    box = F.array(*[F.round(p, 6) for p in picks])
    return areas.select(
        area_id("kind", "name", "geom").alias("aoi_id"),
        F.col("name").alias("label"),
        "kind",
        "geom",
        box.alias("bbox_wgs84"),
    )


def communes_in_area(
    departments: Mapping[str, DataFrame], area: DataFrame, cell: float = 5_000.0
) -> DataFrame:
    """Communes of several departments that meet the area; possibly none."""
    communes = stack_layers(departments, ["code", "nom", "geom"]).drop("kind")
    return communes.join(touching(communes, area, "code", "geom", "geom", cell), "code", "left_semi")


def build_area(communes: DataFrame, box: Box | None = None, cell: float = 100.0) -> DataFrame:
    """Whole communes meeting the box, or without a box the outline pieces of their union."""
    if box is not None:
        return communes.where(in_box("geom", *box))
    return O.dissolve_outline(communes, "code", cell=cell)
