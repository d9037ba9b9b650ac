"""Vector layers: Parquet with edge arrays, GeoJSON feature collections, OSM elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.functions import crs as P
from terrapulse.functions import geometry as G
from terrapulse.functions import interchange as I
from terrapulse.functions.text import find_column
from terrapulse.operators.cover import points_in
from terrapulse.operators.spatial import in_box, intersecting_pairs
from terrapulse.operators.unnest import unnest
from terrapulse.session import checkpointed, ship, shuffled
from terrapulse.sources.elements import read_elements

Box = tuple[float, float, float, float]


#: Names under which layers hold their geometry.
GEOMETRY_COLUMNS = ("geometry", "geom", "wkb_geometry", "wkb", "wkt")


def read_vector(spark: SparkSession, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """Parquet by suffix, else a GeoJSON feature collection; the geometry is the edge array ``geom``.

    A binary geometry column of a Parquet layer is read as WKB, one of text as WKT, an edge array is taken as it is.
    """
    if path.rstrip("/").endswith(".parquet"):
        return with_edges(spark.read.parquet(path))
    return read_geojson(spark, path, keep)


def with_edges(layer: DataFrame) -> DataFrame:
    """``layer`` with its geometry column read into ``geom``, in the column's place; without one as it is."""
    kinds = dict(layer.dtypes)
    name = next((c for c in GEOMETRY_COLUMNS if kinds.get(c) in ("binary", "string")), None)
    if name is None:
        return layer
    ship(layer.sparkSession)
    geom = I.wkb_edges(F.col(name)) if kinds[name] == "binary" else I.wkt_edges(f"`{name}`")
    return layer.select(*[geom.alias("geom") if c == name else c for c in layer.columns if c == name or c != "geom"])


def write_vector(layer: DataFrame, path: str, encoding: str = "wkb") -> None:
    """A layer as Parquet with its geometry as WKB (the encoding of GeoParquet) or WKT, under the usual column name."""
    if encoding not in ("wkb", "wkt"):
        raise ValueError(f"unknown geometry encoding {encoding!r}")
    ship(layer.sparkSession)
    geometry = (I.edges_wkb if encoding == "wkb" else I.edges_wkt)(F.col("geom"))
    # Behind a generator the outline is a column: Python functions can't take an expression with lambdas.
    layer = layer.withColumn("geom", F.explode_outer(F.array("geom")))
    layer.select(*[geometry.alias("geometry") if c == "geom" else c for c in layer.columns]).write.mode("overwrite").parquet(path, compression="zstd")


def read_geojson(
    spark: SparkSession,
    path: str,
    keep: Sequence[str] = (),
    clip: Box | None = None,
    area: DataFrame | None = None,
) -> DataFrame:
    """Features as rows: the existing columns of ``keep`` and ``geom`` in two dimensions.

    Polygons and multi-polygons become one edge array. A collection of any size is read by many tasks. With ``clip``
    whole features meeting the box are kept; with ``area``, a layer of polygons, features are cut at it.
    """
    features = read_elements(
        spark, path, "Feature", "features",
        "geometry struct<type:string, coordinates:string>, properties map<string,string>",
    )
    features = features.select(F.struct("geometry", "properties").alias("f"))
    kind = F.col("f.geometry.type")
    text = F.col("f.geometry.coordinates")
    polygon = F.from_json(text, "array<array<array<double>>>")
    multi = F.from_json(text, "array<array<array<array<double>>>>")
    line = F.from_json(text, "array<array<double>>")
    rings = (
        F.when(kind == "Polygon", polygon)
        .when(kind == "MultiPolygon", F.flatten(multi))
        .when(kind == "MultiLineString", polygon)
        .when(kind == "LineString", F.array(line))
    )
    columns = [F.try_element_at("f.properties", F.lit(c)).alias(c) for c in keep]
    rows = features.select(*columns, rings.alias("_rings")).withColumn(
        "geom", G.rings_edges(f"transform(_rings, p_gj -> {G.drop_z.sql('p_gj')})")
    )
    rows = rows.drop("_rings")
    rows = rows.where(in_box("geom", *clip)) if clip else rows
    return cut_at(rows, area) if area is not None else rows


def cut_at(features: DataFrame, area: DataFrame) -> DataFrame:
    """``features`` cut at the polygons of ``area``; what lies outside goes.

    A feature in several polygons of the area has one row for each. Their outlines are rings again: the parts of either
    outline within the other are walked from end to end. Lines keep their parts inside.
    """
    ship(features.sparkSession)
    named = features.withColumn("_fid", F.monotonically_increasing_id())
    named = checkpointed(named.where(F.size("geom") > 0))
    zones = checkpointed(area.select(F.monotonically_increasing_id().alias("_zid"), F.col("geom").alias("_zone")))
    met = intersecting_pairs(named.select("_fid", "geom"), zones, "geom", "_zone", 1_000.0, ("_fid", "_zid"))
    parts = unnest(met.select("_fid", "geom", "_zone"), F.array(G.clipped("geom", "_zone")), "_cut").where(F.size("_cut") > 0)
    # Walking the outlines is the dear step and their bytes are few: dealt anew, it keeps the session's shuffle partitions.
    count = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = parts.select("_fid", "_cut").repartition(count, "_fid").select("_fid", I.ordered_edges(F.col("_cut")).alias("_walk"))
    # Behind a generator: a filter on the outline would be pushed below and walk it a second time.
    cut = unnest(walked, F.array("_walk"), "_cut").drop("_walk")
    joined = named.join(shuffled(cut), "_fid")
    return joined.select(*[F.col("_cut").alias("geom") if c == "geom" else c for c in features.columns])


def read_osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """OSM elements to lines ``(osm_id, geom)``; ways need two vertices."""
    ways = read_elements(spark, path, "way", "elements", "id bigint, geometry array<struct<lat:double, lon:double>>")
    ways = ways.select(F.struct("id", "geometry").alias("w")).where(F.size("w.geometry") >= 2)
    points = F.expr("transform(w.geometry, p -> named_struct('x', p.lon, 'y', p.lat))")
    paths = ways.select(F.col("w.id").alias("osm_id"), points.alias("_path"))
    return paths.select("osm_id", G.ring_edges("_path").alias("geom"))


def read_points_csv(
    spark: SparkSession,
    path: str,
    lon_names: Sequence[str],
    lat_names: Sequence[str],
    sep: str = ";",
    area: DataFrame | None = None,
) -> DataFrame:
    """CSV points with their projected position ``px``, ``py``; with ``area`` those inside its polygons."""
    raw = spark.read.csv(path, header=True, sep=sep)
    lon, lat = find_column(raw.columns, lon_names), find_column(raw.columns, lat_names)
    if lon is None or lat is None:
        raise ValueError("longitude or latitude column not found")
    x, y = P.wgs84_to_l93(F.col(lon).try_cast("double"), F.col(lat).try_cast("double"))
    rows = raw.withColumns({"px": x, "py": y})
    if area is None:
        return rows
    rows = checkpointed(rows.withColumn("_spot", F.monotonically_increasing_id()))
    zones = area.select(F.xxhash64("geom").alias("_zid"), F.col("geom").alias("_zone"))
    inside = points_in(rows, zones, "_spot", "_zid", "px", "py", "_zone", 1_000.0).select("_spot").distinct()
    return rows.join(inside, "_spot", "left_semi").drop("_spot")


def read_protected_woods(
    spark: SparkSession, path: str, aoi: Box | None = None, area: DataFrame | None = None
) -> DataFrame:
    """Wooded protection zones (type 01) as ``(id_ebc, geom)``.

    The identifier is the first known one; a zone without any gets one from its outline, numbered
    where several have the same, so it doesn't depend on how the file was split.
    """
    rows = read_geojson(spark, path, ["typepsc", "idpsc", "id", "gid"], aoi, area)
    woods = rows.where(F.col("typepsc") == "01")
    named = woods.withColumn("_known", F.coalesce("idpsc", "id", "gid")).withColumn("_outline", F.md5(F.to_json(F.struct("geom"))))
    unknown = named.where(F.col("_known").isNull())
    # Zones of one outline are copies of each other: any of them may have any of their numbers.
    again = unknown.groupBy("_outline").agg(F.count("*").alias("_n"), F.first("geom").alias("geom"))
    made = again.withColumn("_at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    made = made.select(F.concat(F.lit("EBC"), "_outline", F.lit("-"), F.col("_at")).alias("id_ebc"), "geom")
    return named.where(F.col("_known").isNotNull()).select(F.col("_known").alias("id_ebc"), "geom").unionByName(made)
