"""Fibre layer of one commune from the building base and the eligibility file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapulse.functions import crs as P


def fibre_layer(buildings: DataFrame, eligibility: DataFrame, insee: str, order: str) -> DataFrame:
    """``(id_locale, statut_deploiement, operateur, imb_type, nb_logements, px, py)``.

    A building is deployed when any eligible technology is fibre; the operator is the first fibre
    operator in file order, empty when none.
    """
    local = buildings.where(F.col("imb_code_insee") == insee)
    fibre = (
        eligibility.where(F.col("code_techno") == "FO")
        .join(local.select("imb_id"), "imb_id", "left_semi")
        .groupBy("imb_id")
        .agg(F.min_by("code_operateur", order).alias("_op"), F.lit(True).alias("_fo"))
    )
    number = lambda c: F.col(c).try_cast(T.DoubleType())
    x, y = P.mercator_to_l93(number("imb_x"), number("imb_y"))
    kind = F.col("imb_type") if "imb_type" in buildings.columns else F.lit(None).cast("string")
    return local.join(fibre, "imb_id", "left").select(
        F.col("imb_id").alias("id_locale"),
        F.when(F.col("_fo"), "Déployé").otherwise("Non desservi").alias("statut_deploiement"),
        F.coalesce("_op", F.lit("")).alias("operateur"),
        kind.alias("imb_type"),
        number("imb_nbr_logloc").alias("nb_logements"),
        x.alias("px"),
        y.alias("py"),
    )
