"""Adapters from open layers to the fixed column contract of the siting job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.functions.text import find_column


@dataclass(frozen=True)
class Contract:
    """Columns of a layer: candidates per column, numeric columns and defaults when absent."""

    columns: Mapping[str, Sequence[str]]
    numeric: Sequence[str] = ()
    defaults: Mapping[str, object] = field(default_factory=dict)


# Candidate names and defaults per layer.
CONTRACTS = {
    "batiments": Contract(
        {
            "id_batiment": ("cleabs", "id", "fid"),
            "usage": ("usage_1", "usage"),
            "sous_type": ("nature", "type"),
        },
        defaults={"usage": "Résidentiel", "sous_type": "Maison"},
    ),
    "fibre": Contract(
        {
            "id_locale": ("id", "id_immeuble", "code", "imb_id"),
            "statut_deploiement": ("statut_deploiement", "statut", "etat", "eligibilite_fibre"),
            "operateur": ("operateur", "op"),
        },
        defaults={"statut_deploiement": "Déployé"},
    ),
    "energie": Contract(
        {
            "id_poste_source": ("code", "id", "nom", "poste"),
            "puissance_max_kva": ("capacite_max_kva", "puissance_max_kva", "s_max_kva"),
            "puissance_disponible_kva": (
                "capacite_dispo_kva", "puissance_disponible_kva", "capacite_reservee_kva",
            ),
        },
        numeric=("puissance_max_kva", "puissance_disponible_kva"),
        defaults={"puissance_max_kva": 0.0, "puissance_disponible_kva": 0.0},
    ),
    "bornes_ve": Contract({"id_borne": ("id_pdc_local", "id", "id_station")}),
    "pv": Contract({"id_pv": ("id", "code")}),
    "abf": Contract(
        {"id_monument": ("id", "ref", "reference"), "nom": ("nom", "appellation", "titre", "name")},
        defaults={"nom": "Monument historique"},
    ),
    "ppri": Contract(
        {"id_ppri": ("id", "code", "gid"), "niveau_risque": ("niveau_risque", "niveau", "alea", "classe")},
        defaults={"niveau_risque": "Inconnu"},
    ),
    "ebc": Contract({"id_ebc": ("id", "code", "gid")}),
    "voirie": Contract({"id_troncon": ("cleabs", "id", "gid")}),
}
SPATIAL = ("geom", "ring", "px", "py")


def normalize_layer(df: DataFrame, contract: Contract, dept: str | None = None) -> DataFrame:
    """Project a layer onto its contract; the spatial columns present are kept.

    The identifier falls back to the first column, an absent optional column to its default.
    """
    identifier = next(iter(contract.columns))
    out = []
    for name, candidates in contract.columns.items():
        found = find_column(df.columns, candidates)
        if found is None and name == identifier:
            found = df.columns[0]
        if name == "operateur" and found is None:
            out.append(out[0].alias(name))
            continue
        kind = "double" if name in contract.numeric else "string"
        value = F.lit(contract.defaults.get(name)).cast(kind)
        if found is not None:
            value = F.col(f"`{found}`").try_cast(kind)
        out.append(value.alias(name))
    if dept is not None:
        out.append(F.lit(dept).alias("dept"))
    return df.select(*out, *[c for c in SPATIAL if c in df.columns])


def adapt_parcels(df: DataFrame, commune: str) -> DataFrame:
    """Cadastre layer: identifier, five-digit commune code and department from its prefix."""
    idu = find_column(df.columns, ("idu", "id", "numero"))
    code = find_column(df.columns, ("commune", "code_insee", "insee", "idu"))
    insee = F.substring(F.col(f"`{code}`").cast("string"), 1, 5)
    return df.select(
        F.col(f"`{idu}`").cast("string").alias("id_parcelle"),
        F.substring(insee, 1, 2).alias("dept"),
        F.lit(commune).alias("commune"),
        insee.alias("commune_insee"),
        *[c for c in SPATIAL if c in df.columns],
    )


def adapt_all(sources: Mapping[str, DataFrame], dept: str, commune: str) -> dict[str, DataFrame]:
    """Every layer given, by contract; an absent layer is simply left out."""
    out = {}
    for name, df in sources.items():
        if name == "parcelles":
            out[name] = adapt_parcels(df, commune)
        else:
            out[name] = normalize_layer(df, CONTRACTS[name], dept)
    return out


def stack_layers(layers: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Layers under one another with a ``kind`` label; a missing column is NULL, and without a layer there is no row."""
    if not layers:
        session = SparkSession.active()
        return session.createDataFrame([], ", ".join(f"{c} string" for c in ("kind", *columns)))
    present = [
        df.select(F.lit(kind).alias("kind"), *[c for c in columns if c in df.columns])
        for kind, df in layers.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)
