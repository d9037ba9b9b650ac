"""Supplier CSV intake."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapulse.functions import text as X
from terrapulse.session import checkpointed

# Accepted header names.
LATITUDE_NAMES = (
    "latitude", "lat", "supplier_latitude", "supplier_lat", "farm_latitude", "farm_lat",
    "site_latitude", "site_lat", "y",
)
LONGITUDE_NAMES = (
    "longitude", "long", "lon", "lng", "supplier_longitude", "supplier_long", "supplier_lon",
    "supplier_lng", "farm_longitude", "farm_lon", "site_longitude", "site_lon", "x",
)
SUPPLIER_NAMES = (
    "supplier_id", "supplier", "id", "identifier", "farm_id", "site_id", "producer_id", "name",
    "supplier_name",
)
COMMODITY_NAMES = ("commodity", "raw_material", "material", "product", "supply_chain")


def numbered(df: DataFrame, split: Sequence[Column] = ()) -> DataFrame:
    """Adds ``source_row``, the 1-based position, without a single-task sort.

    The rows before a split are a running sum over the table of splits, joined back. ``split`` names the split of a
    file that a row is from, in order (its path and where it begins); without it splits are the partitions of ``df``.
    """
    marks = [c.alias(f"_split{i}") for i, c in enumerate(split)]
    tagged = checkpointed(df.select("*", *marks, F.monotonically_increasing_id().alias("_id")))
    names = [f"_split{i}" for i in range(len(marks))]
    if not names:
        names, tagged = ["_split"], tagged.withColumn("_split", F.shiftright("_id", 33))
    sizes = tagged.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # One row for each split of the input.
    upto = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*names, "_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    placed = tagged.join(starts, names).withColumn("source_row", F.col("_id") - F.col("_first") + F.col("_before") + 1)
    return placed.drop("_id", "_first", "_before", *names)


#: The split of a file scan that a row is from.
FILE_SPLIT = ("_metadata.file_path", "_metadata.file_block_start")


def normalize_suppliers(raw: DataFrame) -> DataFrame:
    """``(source_row, supplier_id, source_commodity, latitude, longitude, error)``."""
    names = raw.columns
    lat, lon = X.find_column(names, LATITUDE_NAMES), X.find_column(names, LONGITUDE_NAMES)
    if lat is None or lon is None:
        raise ValueError("latitude / longitude columns not found")
    ident, commodity = X.find_column(names, SUPPLIER_NAMES), X.find_column(names, COMMODITY_NAMES)
    rows = raw if "source_row" in names else numbered(raw)
    text = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    return rows.select(
        "source_row",
        X.supplier_id(text(ident), F.col("source_row")).alias("supplier_id"),
        X.blank_to_null(text(commodity)).alias("source_commodity"),
        X.parse_coordinate(text(lat)).alias("latitude"),
        X.parse_coordinate(text(lon)).alias("longitude"),
        F.coalesce(
            X.coordinate_error(text(lat), "latitude"), X.coordinate_error(text(lon), "longitude")
        ).alias("error"),
    )


def read_suppliers(spark: SparkSession, path: str) -> DataFrame:
    """Valid supplier rows; fails when the file is empty or a row has a bad coordinate."""
    raw = spark.read.csv(path, header=True, schema=None)
    rows = normalize_suppliers(numbered(raw, [F.col(c) for c in FILE_SPLIT]))
    state = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("source_row", "error"), F.when(F.col("error").isNotNull(), F.col("source_row"))).alias("bad"),
    ).first()
    if state["n"] == 0:
        raise ValueError("the file contains no supplier row")
    if state["bad"] is not None:
        raise ValueError(f"{state['bad']['error']} on row {state['bad']['source_row']}")
    return rows.drop("error")


