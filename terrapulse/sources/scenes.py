"""Scene catalogue: landed item lists and the search predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.sources.elements import read_elements

ITEM_SCHEMA = (
    "id string, bbox array<double>, properties struct<datetime:string,"
    "`eo:cloud_cover`:double, `s2:mgrs_tile`:string, `grid:code`:string>"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """``{params, items}`` documents to ``(id, datetime, cloud_cover, tile, minx, miny, maxx, maxy)``."""
    items = read_elements(spark, path, "Feature", "items", ITEM_SCHEMA)
    items = items.select(F.struct("id", "bbox", "properties").alias("i"))
    props = F.col("i.properties")
    tile = F.coalesce(
        F.nullif(props.getField("s2:mgrs_tile"), F.lit("")), props.getField("grid:code")
    )
    box = F.col("i.bbox")
    return items.select(
        F.col("i.id").alias("id"),
        props.getField("datetime").alias("datetime"),
        props.getField("eo:cloud_cover").alias("cloud_cover"),
        tile.alias("tile"),
        *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("minx", "miny", "maxx", "maxy"))],
    )


def search_scenes(
    scenes: DataFrame,
    bbox: tuple[float, float, float, float],
    start_year: int,
    end_year: int,
    max_cloud_cover: float,
) -> DataFrame:
    """Scenes overlapping the box, within the whole years, below the cloud ceiling.

    Plain comparisons on stored columns, so they reach the file scan.
    """
    minx, miny, maxx, maxy = bbox
    return scenes.where(
        (F.col("minx") <= maxx) & (F.col("maxx") >= minx)
        & (F.col("miny") <= maxy) & (F.col("maxy") >= miny)
        & (F.col("datetime") >= F.lit(f"{start_year}-01-01 00:00:00").cast("timestamp_ntz"))
        & (F.col("datetime") < F.lit(f"{end_year + 1}-01-01 00:00:00").cast("timestamp_ntz"))
        & (F.col("cloud_cover") < float(max_cloud_cover))
    )
