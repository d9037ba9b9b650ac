"""Ecological priority mesh of an area."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.functions import hexgrid as H
from terrapulse.operators import mesh as M


@dataclass
class MeshProducts:
    mesh: DataFrame
    summary: DataFrame
    axes: list[str]
    connectivity_source: str


def run(
    aoi: DataFrame,
    reservoirs: DataFrame,
    key: str,
    grain: int = 8,
    corridors: DataFrame | None = None,
    trend_pixels: DataFrame | None = None,
    corridor_max_m: float = 2000.0,
    browning_scale: float = 0.01,
    step: float = 25.0,
) -> MeshProducts:
    """Stake, connectivity and (optional) degradation axes, score and class per hexagon.

    ``aoi`` carries ``key`` and ``geom``, ``reservoirs`` and ``corridors`` ``fid`` and ``geom``,
    ``trend_pixels`` ``x``, ``y`` and ``sen_slope``. Without corridors the nearest reservoir stands
    in for connectivity.
    """
    edge = H.edge_of(grain)
    cells = M.hex_grid(aoi, key, "geom", edge)
    cells = M.protected_share(cells, reservoirs, "geom", edge, step)
    use_corridors = corridors is not None and not corridors.isEmpty()
    targets = corridors if use_corridors else reservoirs
    cells = M.proximity(cells, targets, "geom", "fid", corridor_max_m, "connectivite")
    axes = ["enjeu", "connectivite"]
    if trend_pixels is not None:
        cell = H.cell_of("x", "y", edge)
        worn = M.browning_by_cell(trend_pixels, cell, browning_scale)
        cells = cells.join(worn, "cell", "left")
        axes.append("degradation")
    scored = M.score_mesh(cells, axes)
    source = "tvb_corridors" if use_corridors else "reservoir_proximity_proxy"
    summary = M.mesh_summary(scored).withColumn(
        "n_reservoirs", reservoirs.agg(F.count(F.lit(1)).alias("n")).scalar()
    ).withColumn("connectivity_source", F.lit(source))
    return MeshProducts(scored, summary, axes, source)
