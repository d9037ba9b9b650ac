"""Forest to built-up interface: frontier length, band area, built area."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.operators import overlay as O
from terrapulse.operators.spatial import keep_matched, touching
from terrapulse.session import checkpointed


@dataclass
class InterfaceProducts:
    line: DataFrame
    metrics: DataFrame


def restrict(features: DataFrame, fid: str, aoi: DataFrame, cell: float = 1_000.0) -> DataFrame:
    """Whole features that meet the area."""
    return keep_matched(features, touching(features, aoi, fid, "geom", "geom", cell), fid)


def clipped_outline(features: DataFrame, fid: str, aoi: DataFrame | None, cell: float) -> DataFrame:
    """Outline of the union of the features, cut exactly at the area.

    Inside the area it is the dissolved outline; where a feature crosses the border, the border
    stretch inside the feature closes it.
    """
    outline = O.dissolve_outline(features, fid, cell=cell)
    if aoi is None:
        return outline
    border = O.edge_table(aoi.select(F.lit("aoi").alias("_aid"), "geom"), "_aid")
    inner = O.clip_edges(outline, aoi, "geom", cell)
    closing = O.clip_edges(O.split_long_edges(border, cell), features, "geom", cell)
    return inner.select(F.col("fid").cast("string").alias("fid"), "eid", "e").unionByName(closing)


def run(
    forest: DataFrame,
    built: DataFrame,
    contact_m: float = 50.0,
    aoi: DataFrame | None = None,
    step: float = 1.0,
    cell: float = 100.0,
) -> InterfaceProducts:
    """Interface line and its metrics; everything is 0 when the layers never come in contact.

    ``forest`` and ``built`` carry ``fid`` and ``geom``; ``aoi`` carries ``geom``.
    """
    if aoi is not None:
        forest, built = restrict(forest, "fid", aoi), restrict(built, "fid", aoi)
    wooded = checkpointed(clipped_outline(forest, "fid", aoi, cell))
    houses = clipped_outline(built, "fid", aoi, cell)
    line = checkpointed(O.interface_line(wooded, built, contact_m))
    length = line.agg(F.coalesce(F.sum("length_m"), F.lit(0.0)).alias("interface_length_m"))
    band = O.interface_band_ha(forest, built, contact_m, step, aoi)
    area = O.outline_area(houses)
    any_side = F.lit(forest.isEmpty() or built.isEmpty())
    zero = F.lit(0.0)
    metrics = length.select(
        F.when(any_side, zero).otherwise(F.lit(float(contact_m))).alias("contact_m"),
        "interface_length_m",
        F.when(any_side, zero).otherwise(band.scalar()).alias("interface_zone_ha"),
        F.when(any_side, zero).otherwise(area.scalar() / F.lit(10_000.0)).alias("bati_area_ha"),
    )
    return InterfaceProducts(line, metrics)
