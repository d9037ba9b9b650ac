"""Site-selection funnel over parcels: staging, footprints, five filters, score, heat-map, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import hexgrid as H
from terrapulse.functions import scoring as S
from terrapulse.operators.installable import installable_zone
from terrapulse.operators.spatial import (
    drop_matched,
    flag_matched,
    geom_box,
    intersecting_pairs,
    nearest,
    nearest_in_disk,
    point_box,
    touching,
    within_pairs,
)
from terrapulse.operators.unnest import unnest
from terrapulse.session import checkpointed, shuffled

# Search rings per layer, in hexagons of the join grain.
DISK_K = {"fibre": 6, "energie": 12}
RESIDENTIAL = "Résidentiel"
BLOCK_TYPES = ("Immeuble",)
STEPS = ("1-Foncier", "2-Nuisances", "3-Fibre", "4-Energie", "5-Reglementaire")
PAIR_CELL_M = 100.0
JOIN_EDGE = H.edge_of(H.JOIN_GRAIN)
MAP_EDGE = H.edge_of(H.MAP_GRAIN)


@dataclass
class Layers:
    """Input layers; polygons carry ``ring``, lines ``geom``, points ``px`` and ``py``."""

    parcelles: DataFrame
    batiments: DataFrame
    fibre: DataFrame
    energie: DataFrame
    bornes_ve: DataFrame
    pv: DataFrame
    abf: DataFrame
    ppri: DataFrame
    ebc: DataFrame
    voirie: DataFrame


@dataclass
class Funnel:
    """Tables of one run."""

    base: DataFrame
    filters: list[DataFrame]
    eligible: DataFrame
    heatmap: DataFrame
    audit: DataFrame


def stage_polygons(df: DataFrame) -> DataFrame:
    """Valid polygons with their edges, area and hexagons at both grains, stored.

    Everything downstream reads the staged table, so outlines are parsed once.
    """
    valid = df.where(G.is_valid("ring")).withColumn("geom", G.ring_edges("ring"))
    measured = valid.drop("ring").withColumns(
        {"surface_m2": G.area("geom"), "_c": G.center("geom")}
    )
    cells = {"cell": JOIN_EDGE, "h3_res8": MAP_EDGE}
    keyed = measured.withColumns({n: H.cell_of("_c.x", "_c.y", e) for n, e in cells.items()})
    return checkpointed(keyed.drop("_c"))


def stage_points(df: DataFrame) -> DataFrame:
    return df.withColumn("pcell", H.cell_of("px", "py", JOIN_EDGE))


def building_pairs(parcels: DataFrame, buildings: DataFrame, attributes: list[str]) -> DataFrame:
    """(parcel, building) pairs that meet, with the common footprint and its area."""
    left = parcels.select("id_parcelle", "geom")
    right = buildings.select("id_batiment", F.col("geom").alias("bgeom"), *attributes)
    met = intersecting_pairs(left, right, "geom", "bgeom", PAIR_CELL_M, ("id_parcelle", "id_batiment"))
    # Behind a generator the outline is built once, whatever later filters and measures read it.
    common = unnest(met, F.array(G.overlap("geom", "bgeom")), "footprint")
    return common.select(
        "id_parcelle",
        "id_batiment",
        *attributes,
        "footprint",
        G.footprint_area("footprint").alias("footprint_m2"),
    )


def free_surface(parcels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Parcels with building counts, the summed footprint and the free surface."""
    is_block = F.col("sous_type").isin(*BLOCK_TYPES)
    counts = pairs.groupBy("id_parcelle").agg(
        F.count(F.lit(1)).alias("count_batiments"),
        F.count_if((F.col("usage") == RESIDENTIAL) & ~is_block).alias("count_resid"),
        F.count_if(is_block).alias("count_immeuble"),
        F.sum("footprint_m2").alias("emprise_m2"),
    )
    built = F.coalesce("emprise_m2", F.lit(0.0))
    zero = F.lit(0).cast("bigint")
    return (
        parcels.join(shuffled(counts), "id_parcelle", "left")
        .withColumn("surface_libre_m2", F.col("surface_m2") - built)
        .withColumns(
            {
                "emprise_m2": built,
                "count_resid": F.coalesce("count_resid", zero),
                "count_immeuble": F.coalesce("count_immeuble", zero),
                "count_batiments": F.coalesce("count_batiments", zero),
            }
        )
    )


def install_measures(parcels: DataFrame, pairs: DataFrame, step: float) -> DataFrame:
    """``(id_parcelle, install_m2, dist_bati_m)``.

    The cable distance runs from the centroid of the installable zone to the nearest footprint, or
    to the parcel itself when nothing is built.
    """
    slim = parcels.select("id_parcelle", "geom")
    solid = pairs.where(F.size("footprint") > 0).select("id_parcelle", "footprint")
    kept = solid.join(shuffled(slim.select("id_parcelle")), "id_parcelle", "left_semi")
    zone = installable_zone(slim, kept, "id_parcelle", step=step, setback=S.SETBACK_M)
    to_built = (
        zone.join(shuffled(kept), "id_parcelle")
        .groupBy("id_parcelle")
        .agg(
            F.min(G.point_distance("footprint", "install_x", "install_y")).alias(
                "_built"
            ),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    to_parcel = G.point_distance("geom", "install_x", "install_y")
    return (
        slim.join(shuffled(zone), "id_parcelle")
        .join(shuffled(to_built), "id_parcelle", "left")
        .select(
            "id_parcelle",
            "install_m2",
            F.when(F.col("_n").isNotNull(), F.col("_built"))
            .otherwise(F.when(F.col("install_x").isNotNull(), to_parcel))
            .alias("dist_bati_m"),
        )
    )


def line_distance(parcels: DataFrame, lines: DataFrame, line_id: str, first_radius: float) -> DataFrame:
    """``(id_parcelle, d)``: distance to the nearest line, however far."""
    left = parcels.select("id_parcelle", "geom")
    right = lines.select(F.col(line_id).alias("_line"), F.col("geom").alias("_lgeom"))
    d = G.distance("geom", "_lgeom", True, False)
    return nearest(
        left, right, geom_box("geom"), geom_box("_lgeom"), d, "id_parcelle", "_line", first_radius
    ).select("id_parcelle", "d")


def regulatory_violations(
    parcels: DataFrame, abf: DataFrame, ppri: DataFrame, ebc: DataFrame
) -> DataFrame:
    """Distinct parcels within the ring of a monument or touching a flood zone or protected wood."""
    left = parcels.select("id_parcelle", "geom")
    monuments = abf.select("id_monument", "px", "py")
    d = G.point_distance("geom", "px", "py")
    ringed = within_pairs(
        left, monuments, geom_box("geom"), point_box("px", "py"), d, S.MONUMENT_RING_M
    ).select("id_parcelle")
    for layer in (ppri, ebc):
        ringed = ringed.unionByName(touching(left, layer.select("geom"), "id_parcelle", "geom", "geom", PAIR_CELL_M))
    return ringed.distinct()


def near_flag(parcels: DataFrame, points: DataFrame, radius: float, name: str) -> DataFrame:
    """Adds a boolean: some point lies within ``radius`` of the parcel."""
    left = parcels.select("id_parcelle", "geom")
    spots = points.select("px", "py").distinct()
    d = G.point_distance("geom", "px", "py")
    pairs = within_pairs(left, spots, geom_box("geom"), point_box("px", "py"), d, radius)
    return flag_matched(parcels, pairs, "id_parcelle", name)


def score_sites(sites: DataFrame) -> DataFrame:
    """Stored scores, capped total and class; the class uses the unrounded total."""
    bonus = lambda flag: F.when(flag, F.lit(S.BONUS)).otherwise(F.lit(0.0))
    withed = sites.withColumns(
        {
            "bonus_pv": bonus(F.col("near_pv")),
            "bonus_ve": bonus(F.col("near_ve")),
            "bonus_poste": bonus(F.col("dist_poste_m") <= S.BONUS_RADIUS_M["poste"]),
        }
    )
    axes = ["foncier", "nuisances", "fibre", "energie", "environnement"]
    parts = [F.col(f"score_{a}") for a in axes] + [
        F.col(b) for b in ("bonus_pv", "bonus_ve", "bonus_poste")
    ]
    rounded = ["surface_m2", "surface_libre_m2", "puissance_dispo_kva", "dist_poste_m"]
    return withed.withColumns(
        {"score_total": S.total_score(parts), "classe": S.total_class(parts)}
    ).withColumns({c: F.round(c, 1) for c in [*[f"score_{a}" for a in axes], *rounded]})


def heatmap(eligible: DataFrame) -> DataFrame:
    """Class counts, mean and best score and roll-out tier per map cell."""
    n_premium = F.count_if(F.col("classe") == "Premium")
    n = F.count(F.lit(1))
    cells = eligible.groupBy("h3_res8").agg(
        n.alias("count_eligibles"),
        n_premium.alias("count_premium"),
        F.count_if(F.col("classe") == "Bon").alias("count_bon"),
        F.count_if(F.col("classe") == "Moyen").alias("count_moyen"),
        F.round(F.avg("score_total"), 1).alias("avg_score"),
        F.round(F.max("score_total"), 1).alias("max_score"),
        F.round(F.lit(100.0) * n_premium / n, 1).alias("pct_premium"),
    )
    tier = (
        F.when(F.col("count_premium") >= 5, "Tier1")
        .when(F.col("count_eligibles") >= 5, "Tier2")
        .otherwise("Tier3")
    )
    return cells.withColumn("priorite_deploiement", tier)


def audit_layer(base: DataFrame, filters: list[DataFrame], eligible: DataFrame) -> DataFrame:
    """Every parcel with its passes, its first failed step and, if eligible, its score."""
    out = base.select(
        "id_parcelle", "surface_m2", "surface_libre_m2", "count_resid", "count_immeuble"
    )
    names = [f"pass_0{i + 1}" for i in range(len(filters))]
    for name, kept in zip(names, filters):
        out = out.join(
            shuffled(kept.select("id_parcelle", F.lit(True).alias(name))), "id_parcelle", "left"
        ).withColumn(name, F.coalesce(name, F.lit(False)))
    scored = eligible.select("id_parcelle", "classe", "score_total")
    out = out.join(shuffled(scored), "id_parcelle", "left")
    failed = F.when(~F.col(names[0]), STEPS[0])
    for name, step in zip(names[1:], STEPS[1:]):
        failed = failed.when(~F.col(name), step)
    return out.withColumn("etape_rejet", failed.otherwise("0-Eligible")).withColumn(
        "eligible", F.col("classe").isNotNull()
    )


def run(layers: Layers, step: float = 1.0) -> Funnel:
    """The whole funnel; each filter reads only the survivors of the one before."""
    parcels = stage_polygons(layers.parcelles)
    buildings = stage_polygons(layers.batiments)
    # The overlay is the dearest step and both tables feed several steps and the audit.
    pairs = checkpointed(building_pairs(parcels, buildings, ["usage", "sous_type"]))
    base = checkpointed(free_surface(parcels, pairs))
    gate = S.land_gate(F.col("count_resid"), F.col("count_immeuble"), F.col("surface_libre_m2"))
    f1 = checkpointed(
        base.where(gate).withColumn("score_foncier", S.land_score(F.col("surface_libre_m2")))
    )
    solid = checkpointed(pairs.join(shuffled(f1.select("id_parcelle")), "id_parcelle", "left_semi"))
    measured = f1.join(shuffled(install_measures(f1, solid, step)), "id_parcelle")
    gated = checkpointed(measured.where(S.nuisance_gate(F.col("install_m2"), F.col("dist_bati_m"))))
    roads = line_distance(gated, layers.voirie, "id_troncon", S.ROAD_ACCESS_M / 3.0)
    f2 = checkpointed(
        gated.join(shuffled(roads.withColumnRenamed("d", "dist_voirie_m")), "id_parcelle", "left").withColumn(
            "score_nuisances",
            S.nuisance_score(F.col("install_m2"), F.col("dist_bati_m"), F.col("dist_voirie_m")),
        )
    )
    fibre = nearest_in_disk(
        f2, stage_points(layers.fibre), "id_parcelle", "id_locale", ["statut_deploiement"],
        DISK_K["fibre"], JOIN_EDGE,
    )
    f3 = (
        f2.join(
            shuffled(
                fibre.select(
                    "id_parcelle",
                    F.col("statut_deploiement").alias("fibre_statut"),
                    F.col("d").alias("dist_fibre_m"),
                )
            ),
            "id_parcelle",
        )
        .where(S.fibre_gate(F.col("fibre_statut")))
        .withColumn("score_fibre", S.fibre_score(F.col("fibre_statut")))
    )
    f3 = checkpointed(f3)
    energy = nearest_in_disk(
        f3, stage_points(layers.energie), "id_parcelle", "id_poste_source",
        ["puissance_disponible_kva"], DISK_K["energie"], JOIN_EDGE, first_radius=JOIN_EDGE,
    )
    f4 = checkpointed(
        f3.join(
            shuffled(
                energy.select(
                    "id_parcelle",
                    F.col("puissance_disponible_kva").alias("puissance_dispo_kva"),
                    F.col("d").alias("dist_poste_m"),
                )
            ),
            "id_parcelle",
        )
        .where(S.energy_gate(F.col("puissance_dispo_kva")))
        .withColumn("score_energie", S.energy_score(F.col("puissance_dispo_kva")))
    )
    broken = regulatory_violations(
        f4, layers.abf, stage_polygons(layers.ppri), stage_polygons(layers.ebc)
    )
    f5 = drop_matched(f4, broken, "id_parcelle").withColumn("score_environnement", F.lit(S.AXIS_MAX))
    flagged = near_flag(f5, layers.pv, S.BONUS_RADIUS_M["pv"], "near_pv")
    flagged = near_flag(flagged, layers.bornes_ve, S.BONUS_RADIUS_M["borne_ve"], "near_ve")
    eligible = checkpointed(score_sites(flagged))
    filters = [f1, f2, f3, f4, eligible]
    return Funnel(base, filters, eligible, heatmap(eligible), audit_layer(base, filters, eligible))
