"""Multi-axis analysis of one commune: all parcels are scored, none is dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.functions import scoring as S
from terrapulse.operators.spatial import flag_matched, nearest_in_disk, touching
from terrapulse.plans import siting as SI
from terrapulse.session import checkpointed, shuffled

AXES = ("foncier", "nuisances", "fibre", "energie", "reglement")
LABELS = ("1-Foncier", "2-Nuisances", "3-Fibre", "4-Energie (HTA)", "5-EBC")


def parcel_id(commune: Column, section: Column, number: Column) -> Column:
    return F.concat_ws("-", commune, section, number)


def stage_building_flags(df: DataFrame) -> DataFrame:
    """In-service buildings with ``est_residentiel`` and ``est_immeuble`` (over 4 homes or 4 floors)."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return df.where(F.col("ETAT") == "En service").withColumns(
        {
            "est_residentiel": F.col("USAGE1") == SI.RESIDENTIAL,
            "est_immeuble": (number("NB_LOGTS") > 4) | (number("NB_ETAGES") >= 4),
        }
    )


def evaluate(rows: DataFrame) -> DataFrame:
    """Five gates and five 0..20 scores.

    Three-valued logic is kept: a parcel without fibre candidate has a NULL gate, neither passed
    nor failed.
    """
    libre, install = F.col("surface_libre_m2"), F.col("install_m2")
    built, grid = F.col("dist_bati_m"), F.col("dist_hta_m")
    axis, one, zero = F.lit(S.AXIS_MAX), F.lit(1.0), F.lit(0.0)
    space = F.lit(10.0) * F.least(install / F.lit(S.INSTALL_REF_M2), one)
    cable = F.when(built <= S.BUILT_MAX_M, F.lit(10.0)).otherwise(zero)
    return rows.withColumns(
        {
            "pass_foncier": S.land_gate(F.col("n_resid_indiv"), F.col("n_immeuble"), libre),
            "pass_nuisances": S.nuisance_gate(install, built),
            "pass_fibre": S.fibre_gate(F.col("fibre_statut")),
            "pass_energie": grid <= S.GRID_MAX_M,
            "pass_reglement": ~F.col("dans_ebc"),
            "score_foncier": axis * F.least(libre / F.lit(S.LAND_REF_M2), one),
            "score_nuisances": F.least(space + cable, axis),
            "score_fibre": S.fibre_score(F.col("fibre_statut")),
            "score_energie": axis
            * F.greatest((F.lit(S.GRID_MAX_M) - grid) / F.lit(S.GRID_MAX_M), zero),
            "score_reglement": F.when(F.col("dans_ebc"), zero).otherwise(axis),
        }
    )


def conclude(evaluated: DataFrame) -> DataFrame:
    """Eligibility, capped index, first failed step and class.

    A NULL gate makes the parcel not eligible without naming a failed step, and leaves its class.
    """
    gates = [F.col(f"pass_{a}") for a in AXES]
    eligible = reduce(lambda a, b: a & b, gates)
    total = reduce(lambda a, b: a + b, [F.col(f"score_{a}") for a in AXES])
    rejected = F.when(~gates[0], LABELS[0])
    for gate, label in zip(gates[1:], LABELS[1:]):
        rejected = rejected.when(~gate, label)
    label = (
        F.when(~eligible, F.lit(None).cast("string"))
        .when(total >= S.COMMUNE_PREMIUM_MIN, "Premium")
        .when(total >= S.COMMUNE_GOOD_MIN, "Bon")
        .otherwise("Moyen")
    )
    return evaluated.withColumns(
        {
            "eligible": eligible,
            "indice": F.least(F.round(total, 1), F.lit(S.TOTAL_MAX)),
            "etape_rejet": rejected.otherwise("0-Candidate"),
            "classe": label,
        }
    )


def candidate_heatmap(concluded: DataFrame) -> DataFrame:
    """Cells with at least one candidate: candidates, premium count and mean index."""
    cells = concluded.groupBy("h3_res8").agg(
        F.count_if("eligible").alias("nb_candidats"),
        F.count_if(F.col("classe") == "Premium").alias("nb_premium"),
        F.round(F.avg(F.when(F.col("eligible"), F.col("indice"))), 1).alias("indice_moyen"),
    )
    return cells.where(F.col("nb_candidats") > 0)


def base_table(
    parcels: DataFrame,
    buildings: DataFrame,
    fibre: DataFrame,
    power_lines: DataFrame,
    woods: DataFrame,
    step: float = 1.0,
    disk_k: int = 12,
) -> DataFrame:
    """Parcels enriched with everything the five axes read; absent matches get their defaults."""
    pairs = checkpointed(
        SI.building_pairs(parcels, buildings, ["est_residentiel", "est_immeuble"])
    )
    counts = pairs.groupBy("id_parcelle").agg(
        F.count_if(F.col("est_residentiel") & ~F.col("est_immeuble")).alias("n_resid_indiv"),
        F.count_if(F.col("est_residentiel") & F.col("est_immeuble")).alias("n_immeuble"),
        F.sum("footprint_m2").alias("emprise_m2"),
    )
    zero = F.lit(0).cast("bigint")
    measured = SI.install_measures(parcels, pairs, step)
    near = nearest_in_disk(
        parcels, SI.stage_points(fibre), "id_parcelle", "id_locale", ["statut_deploiement"],
        disk_k, SI.JOIN_EDGE,
    ).select("id_parcelle", F.col("statut_deploiement").alias("fibre_statut"))
    grid = SI.line_distance(parcels, power_lines, "id_hta", S.GRID_MAX_M)
    touched = touching(parcels, woods, "id_parcelle", "geom", "geom", SI.PAIR_CELL_M)
    joined = (
        parcels.join(shuffled(counts), "id_parcelle", "left")
        .join(shuffled(measured), "id_parcelle", "left")
        .join(shuffled(near), "id_parcelle", "left")
        .join(shuffled(grid.withColumnRenamed("d", "dist_hta_m")), "id_parcelle", "left")
    )
    flagged = flag_matched(joined, touched, "id_parcelle", "dans_ebc")
    built = F.coalesce("emprise_m2", F.lit(0.0))
    return flagged.withColumn("surface_libre_m2", F.col("surface_m2") - built).withColumns(
        {
            "emprise_m2": built,
            "n_resid_indiv": F.coalesce("n_resid_indiv", zero),
            "n_immeuble": F.coalesce("n_immeuble", zero),
        }
    )


def run(parcels, buildings, fibre, power_lines, woods, aoi=None, step: float = 1.0) -> DataFrame:
    """Every parcel of the commune with its gates, scores, index, class and first failed step.

    ``parcels`` and ``woods`` carry ``ring``; ``buildings`` also the two flags. With ``aoi`` (a
    polygon layer) only the parcels that meet it are analysed.
    """
    staged = SI.stage_polygons(parcels)
    if aoi is not None:
        met = touching(staged, aoi, "id_parcelle", "geom", "geom", 1_000.0)
        staged = staged.join(shuffled(met), "id_parcelle", "left_semi")
    rows = base_table(
        staged, SI.stage_polygons(buildings), fibre, power_lines,
        SI.stage_polygons(woods), step,
    )
    return conclude(evaluate(rows))
