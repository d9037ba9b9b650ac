"""Professional buildings without an active establishment nearby."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import scoring as S
from terrapulse.functions.text import PROFESSIONAL_USES, is_professional
from terrapulse.operators.cover import points_in, points_near_edges
from terrapulse.operators.spatial import (
    containing_pairs,
    geom_box,
    keep_matched,
    nearest,
    point_box,
    within_pairs,
)
from terrapulse.session import checkpointed

# Output columns, absent ones NULL, and the buffers of the sensitivity table.
OUTPUT = (
    "id_bati", "usage_1", "usage_2", "surface_bati_m2", "hauteur", "nb_etab_actifs",
    "statut_occupation", "code_insee", "commune", "nature", "geom",
)
BUFFERS_M = (15.0, 25.0, 50.0, 100.0)


@dataclass
class VacancyProducts:
    """``attachments`` is the list of establishments: one row per building and establishment."""

    result: DataFrame
    attachments: DataFrame
    summary: DataFrame


def clip_by_point(buildings: DataFrame, mask: DataFrame, cell: float = 1_000.0) -> DataFrame:
    """Buildings whose representative point lies inside the mask."""
    x, y = G.representative_point("geom")
    spots = buildings.select("id_bati", x.alias("_rx"), y.alias("_ry"))
    zones = mask.select(F.xxhash64("geom").alias("_mkey"), F.col("geom").alias("_mgeom"))
    inside = containing_pairs(spots, zones, "_rx", "_ry", "_mgeom", cell, ("id_bati", "_mkey"))
    return keep_matched(buildings, inside, "id_bati")


def points_near(points: DataFrame, mask: DataFrame, buffer_m: float, key: str = "siret") -> DataFrame:
    """Points inside the mask enlarged by the buffer."""
    zones = mask.select(F.xxhash64("geom").alias("_mkey"), F.col("geom").alias("_mgeom"))
    inside = points_in(points, zones, key, "_mkey", "px", "py", "_mgeom", max(1_000.0, buffer_m)).select(key)
    beside = points_near_edges(points, zones, key, "px", "py", "_mgeom", buffer_m)
    return keep_matched(points, inside.unionByName(beside), key)


def attach(buildings: DataFrame, points: DataFrame, buffer_m: float) -> DataFrame:
    """Distinct ``(id_bati, siret)`` of the establishments in the building or its buffer."""
    d = G.point_distance("geom", "px", "py")
    pairs = within_pairs(
        buildings.select("id_bati", "geom"), points.select("siret", "px", "py"),
        geom_box("geom"), point_box("px", "py"), d, buffer_m,
    )
    return pairs.select("id_bati", "siret").distinct()


def count_establishments(buildings: DataFrame, attachments: DataFrame) -> DataFrame:
    """Adds ``nb_etab_actifs``; the establishments themselves are the rows of ``attachments``."""
    counts = attachments.groupBy("id_bati").agg(F.count(F.lit(1)).alias("nb_etab_actifs"))
    joined = buildings.join(counts, "id_bati", "left")
    return joined.withColumn("nb_etab_actifs", F.coalesce("nb_etab_actifs", F.lit(0).cast("bigint")))


def build_result(counted: DataFrame, code_insee: str = "", commune: str = "") -> DataFrame:
    """Deliverable columns; the area is rounded half to even at one decimal."""
    full = counted.withColumns(
        {
            "surface_bati_m2": F.bround(G.area("geom"), 1),
            "statut_occupation": S.occupation_status(F.col("nb_etab_actifs")),
            "code_insee": F.lit(code_insee),
            "commune": F.lit(commune),
        }
    )
    absent = {c: F.lit(None).cast("string") for c in OUTPUT if c not in full.columns}
    return full.withColumns(absent).select(*OUTPUT) if absent else full.select(*OUTPUT)


def summarize(result: DataFrame) -> DataFrame:
    vacant = F.col("statut_occupation") == "VACANT_CANDIDAT"
    n, n_vacant = F.count(F.lit(1)), F.count_if(vacant)
    rate = F.coalesce(n_vacant / F.nullif(n.cast("double"), F.lit(0.0)) * F.lit(100.0), F.lit(0.0))
    area = F.coalesce(F.sum(F.when(vacant, F.col("surface_bati_m2"))), F.lit(0.0))
    return result.agg(
        n.alias("nb_batiments_pro"),
        n_vacant.alias("nb_candidats_vacants"),
        F.round(rate, 1).alias("taux_apparent_pct"),
        F.round(area, 1).alias("surface_vacante_m2"),
    )


def nearest_distance(buildings: DataFrame, points: DataFrame, max_m: float) -> DataFrame:
    """``(id_bati, area, d)``; ``d`` is NULL when nothing lies within ``max_m``."""
    left = buildings.select("id_bati", "geom")
    d = G.point_distance("geom", "px", "py")
    found = nearest(
        left, points.select("siret", "px", "py"), geom_box("geom"), point_box("px", "py"), d,
        "id_bati", "siret", first_radius=max_m / 4.0, max_radius=max_m,
    ).select("id_bati", "d")
    sized = buildings.select("id_bati", G.area("geom").alias("area"))
    return sized.join(found, "id_bati", "left")


def buffer_sensitivity(
    distances: DataFrame, buffers: Sequence[float] = BUFFERS_M, large_m2: float = 200.0
) -> DataFrame:
    """Candidates, rate and large candidates per buffer, from one pass over the distances."""
    aggregates = []
    for i, b in enumerate(buffers):
        vacant = F.col("d").isNull() | (F.col("d") > F.lit(float(b)))
        aggregates += [
            F.count_if(vacant).alias(f"n{i}"),
            F.count_if(vacant & (F.col("area") >= large_m2)).alias(f"l{i}"),
        ]
    row = distances.agg(F.count(F.lit(1)).alias("n"), *aggregates)
    per_buffer = F.array(
        *[
            F.struct(
                F.lit(float(b)).alias("buffer_m"),
                F.col(f"n{i}").alias("nb_candidats"),
                F.round(F.lit(100.0) * F.col(f"n{i}") / F.nullif("n", F.lit(0)), 1).alias("taux_pct"),
                F.col(f"l{i}").alias("nb_candidats_200m2"),
            )
            for i, b in enumerate(buffers)
        ]
    )
    return row.select(F.explode(per_buffer).alias("b")).select("b.*")


def vacancy_by_commune(result: DataFrame, commune: str) -> DataFrame:
    vacant = F.count_if(F.col("statut_occupation") == "VACANT_CANDIDAT")
    n = F.count(F.lit(1))
    return result.groupBy(commune).agg(
        n.alias("nb_batiments"),
        vacant.alias("nb_candidats"),
        F.round(F.lit(100.0) * vacant / n, 1).alias("taux_pct"),
    )


def run(
    buildings: DataFrame,
    establishments: DataFrame,
    buffer_m: float = 15.0,
    mask: DataFrame | None = None,
    code_insee: str = "",
    commune: str = "",
    uses: Sequence[str] = PROFESSIONAL_USES,
) -> VacancyProducts:
    """Clip, keep professional uses, attach establishments, conclude.

    Points are restricted to the enlarged mask only for a custom area: with a commune code a
    geocoded address may fall just outside the border.
    """
    kept = clip_by_point(buildings, mask) if mask is not None else buildings
    pro = kept.where(is_professional(kept, uses))
    points = establishments
    if mask is not None and not code_insee:
        points = points_near(points, mask, buffer_m)
    attachments = checkpointed(attach(pro, points, buffer_m))
    result = build_result(count_establishments(pro, attachments), code_insee, commune)
    return VacancyProducts(result, attachments, summarize(result))
