"""Establishment files, code expansion and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default column names of the geocoded establishment file.
GEOFILE_COLUMNS = {
    "siret": "siret",
    "denomination": "denominationUsuelleEtablissement",
    "activite_principale": "activitePrincipaleEtablissement",
    "etat": "etatAdministratifEtablissement",
    "latitude": "latitude",
    "longitude": "longitude",
    "code_commune": "codeCommuneEtablissement",
}
# First and last two-digit division of each activity section.
SECTION_DIVISIONS = {
    "A": (1, 3), "B": (5, 9), "C": (10, 33), "D": (35, 35), "E": (36, 39), "F": (41, 43),
    "G": (45, 47), "H": (49, 53), "I": (55, 56), "J": (58, 63), "K": (64, 66), "L": (68, 68),
    "M": (69, 75), "N": (77, 82), "O": (84, 84), "P": (85, 85), "Q": (86, 88), "R": (90, 93),
    "S": (94, 96), "T": (97, 98), "U": (99, 99),
}
# Cities split into districts, with the district code prefix and number range.
DISTRICTS = {"75056": ("751", 1, 20), "13055": ("132", 1, 16), "69123": ("693", 81, 89)}


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, as an aggregate with map-side combine."""
    others = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(first).select(key, "_row.*")


def normalize_geofile(
    raw: DataFrame,
    columns: dict[str, str] | None = None,
    commune: str | None = None,
    order: str | None = None,
) -> DataFrame:
    """Geocoded establishment file to ``(siret, denomination, activite_principale, lat, lon)``.

    Keeps active rows when a state column exists, the commune when asked and known, rows with both
    coordinates, and the first row per establishment.
    """
    names = {**GEOFILE_COLUMNS, **(columns or {})}
    missing = [names[k] for k in ("siret", "latitude", "longitude") if names[k] not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rows = raw
    if names["etat"] in raw.columns:
        rows = rows.where(F.col(names["etat"]) == "A")
    if commune and names["code_commune"] in raw.columns:
        rows = rows.where(F.col(names["code_commune"]) == commune)

    def optional(key: str) -> Column:
        known = names[key] in raw.columns
        return F.col(names[key]) if known else F.lit(None).cast("string")

    kept = rows.select(
        F.col(names["siret"]).alias("siret"),
        optional("denomination").alias("denomination"),
        optional("activite_principale").alias("activite_principale"),
        F.col(names["latitude"]).try_cast(T.DoubleType()).alias("latitude"),
        F.col(names["longitude"]).try_cast(T.DoubleType()).alias("longitude"),
        (F.col(order) if order else F.monotonically_increasing_id()).alias("_order"),
    ).dropna(subset=["latitude", "longitude"])
    return first_per_key(kept, "siret", ["_order"]).drop("_order")


def read_geofile(spark, path: str, **options) -> DataFrame:
    """Parquet by suffix, else CSV with a header; every CSV column stays text until normalised."""
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    return normalize_geofile(in_file_order(raw), order="_place", **options)


def in_file_order(raw: DataFrame) -> DataFrame:
    """A file scan with ``_place``, which sorts its rows as the files hold them, whatever the splits."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    return raw.select("*", place.alias("_place"))


def normalize_wkt_points(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Mass file whose position is the text ``POINT(lon lat)``; of an establishment's rows the first in ``order``.

    Without ``order`` it is the order of the frame; give ``in_file_order`` and its column for that of the files.
    """
    for name in ("siret", "the_geom", "activitenaf"):
        if name not in raw.columns:
            raise ValueError(f"missing column: {name}")
    pattern = r"POINT\s*\(\s*(\S+)\s+(\S+?)\s*\)"

    def part(i: int) -> Column:
        return F.regexp_extract("the_geom", pattern, i).try_cast(T.DoubleType())

    optional = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    kept = raw.select(
        "siret",
        optional("denomination").alias("denomination"),
        F.col("activitenaf").alias("activite_principale"),
        optional("insee").alias("insee"),
        part(2).alias("latitude"),
        part(1).alias("longitude"),
        (F.col(order) if order else F.monotonically_increasing_id()).alias("_order"),
    ).dropna(subset=["latitude", "longitude"])
    return first_per_key(kept, "siret", ["_order"]).drop("_order")


def establishments_from_pages(pages: DataFrame) -> DataFrame:
    """Landed API pages (``page``, ``results``) to active, located, distinct establishments.

    The first occurrence in page, company and establishment order wins.
    """
    companies = pages.select("page", F.posexplode("results").alias("_i", "_company"))
    rows = companies.select(
        "page", "_i",
        F.coalesce("_company.nom_complet", "_company.nom_raison_sociale").alias("denomination"),
        F.posexplode("_company.matching_etablissements").alias("_j", "_e"),
    )
    number = lambda c: F.col(f"_e.{c}").cast("string").try_cast(T.DoubleType())
    kept = rows.where(
        (F.col("_e.etat_administratif") == "A") & (F.coalesce("_e.siret", F.lit("")) != "")
    ).select(
        F.col("_e.siret").alias("siret"),
        "denomination",
        F.col("_e.activite_principale").alias("activite_principale"),
        number("latitude").alias("latitude"),
        number("longitude").alias("longitude"),
        "page", "_i", "_j",
    ).dropna(subset=["latitude", "longitude"])
    return first_per_key(kept, "siret", ["page", "_i", "_j"]).drop("page", "_i", "_j")


def merge_establishments(frames: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Union of the per-commune tables, one row per establishment."""
    return first_per_key(reduce(lambda a, b: a.unionByName(b), frames), "siret", order)


def expand_districts(df: DataFrame, insee: str, alias: str = "code") -> DataFrame:
    """One row per code to query: a split city becomes its districts, any other code itself."""
    code = F.array(F.col(insee))
    for city, (prefix, first, last) in DISTRICTS.items():
        codes = F.array(*[F.lit(f"{prefix}{i:02d}") for i in range(first, last + 1)])
        code = F.when(F.col(insee) == city, codes).otherwise(code)
    return df.withColumn(alias, F.explode(code))


def section_of(code: Column) -> Column:
    """Activity section of a full code from its two-digit division (NULL when unknown)."""
    division = F.substring(code, 1, 2).try_cast(T.IntegerType())
    out = F.lit(None).cast("string")
    for section, (first, last) in SECTION_DIVISIONS.items():
        out = F.when(division.between(first, last), section).otherwise(out)
    return out


def codes_by_section(codes: DataFrame, code: str) -> DataFrame:
    """``(section, codes)``; codes without a section are dropped.

    The list is over distinct codes of a fixed nomenclature (about 732), not over data rows.
    """
    known = codes.select(section_of(F.col(code)).alias("section"), F.col(code).alias("code"))
    grouped = known.where(F.col("section").isNotNull()).groupBy("section")
    return grouped.agg(F.array_sort(F.collect_set("code")).alias("codes"))
