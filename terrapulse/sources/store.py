"""Table store: schema, idempotent partition writes, product registry, exports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.functions.geometry import EDGES_TYPE
from terrapulse.session import checkpointed

# Registry and product tables, with the columns that name a partition.
TABLES = {
    "aoi": (
        "label string, kind string, geom edges, bbox_wgs84 array<double>, created_at timestamp, "
        "aoi_id string",
        ["aoi_id"],
    ),
    "product_runs": (
        "run_id string, pilier string, produit string, params string, path string, "
        "created_at timestamp, aoi_id string",
        ["aoi_id"],
    ),
    "vegetation_zone_stats": (
        "insee string, nom string, mean_sen_slope double, pct_greening double, pct_browning double, "
        "mean_anomaly double, min_vci double, geom edges, aoi_id string, y0 int, y1 int",
        ["aoi_id", "y0", "y1"],
    ),
    "vegetation_timeline": (
        "month date, anomaly_mean double, aoi_id string, y0 int, y1 int",
        ["aoi_id", "y0", "y1"],
    ),
    "interface_stats": (
        "contact_m double, interface_length_m double, interface_zone_ha double, "
        "bati_area_ha double, aoi_id string",
        ["aoi_id"],
    ),
    "site_parcels": (
        "id_parcelle string, insee string, score_foncier double, score_nuisances double, "
        "score_fibre double, score_energie double, score_environnement double, score_total double, "
        "classe string, h3_res8 string, geom edges, aoi_id string",
        ["aoi_id"],
    ),
    "site_heatmap": (
        "h3_res8 string, count_eligibles int, count_premium int, avg_score double, geom edges, "
        "aoi_id string",
        ["aoi_id"],
    ),
    "vacancy_buildings": (
        "id_bati string, usage_1 string, surface_bati_m2 double, nb_etab_actifs int, "
        "statut_occupation string, geom edges, aoi_id string",
        ["aoi_id"],
    ),
}
LOADABLE = ("geojson", "tif", "tiff", "gpkg", "parquet")


def apply_schema(spark: SparkSession) -> None:
    """Create the tables that do not exist yet, partitioned by area, in the current database."""
    for name, (columns, partitions) in TABLES.items():
        columns = columns.replace("geom edges", f"geom {EDGES_TYPE}")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"PARTITIONED BY ({', '.join(partitions)})"
        )


def replace_partition(
    df: DataFrame, table: str, aoi_id: str, extra_keys: Mapping[str, object] | None = None
) -> int:
    """Replace the rows of one area (narrowed by ``extra_keys``) and return the row count.

    A static partition overwrite replaces everything under the given keys, also when the input is
    empty, and leaves the other partitions as they are.
    """
    spark = df.sparkSession
    keys = {"aoi_id": aoi_id, **(extra_keys or {})}
    columns = spark.catalog.listColumns(table)
    partitions = [c.name for c in columns if c.isPartition]
    unknown = [k for k in keys if k not in partitions]
    if unknown:
        raise ValueError(f"not partition columns of {table}: {unknown}")
    dynamic = [p for p in partitions if p not in keys]
    spec = ", ".join([f"{k} = {v!r}" for k, v in keys.items()] + dynamic)
    data = [c.name for c in columns if not c.isPartition] + dynamic
    shown = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in data]
    view = f"incoming_{uuid.uuid4().hex}"
    df.select(*shown).createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({spec}) SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
    written = spark.table(table)
    for k, v in keys.items():
        written = written.where(F.col(k) == F.lit(v))
    return written.count()


def write_product(
    df: DataFrame, root: str, pillar: str, aoi_id: str, product: str, window: str | None = None
) -> str:
    """Write one product under the common layout and return its folder; a geometry is written as WKB."""
    from terrapulse.sources.vectors import write_vector

    folder = product_path(root, pillar, aoi_id, product, window)
    if "geom" in df.columns:
        write_vector(df, folder)
    else:
        df.write.mode("overwrite").parquet(folder, compression="zstd")
    return folder


def product_path(
    root: str, pillar: str, aoi_id: str, product: str, window: str | None = None
) -> str:
    parts = [root, f"pillar={pillar}", f"aoi={aoi_id}", f"product={product}"]
    return "/".join(parts + ([f"window={window}"] if window else []))


def write_attributes(df: DataFrame, table: str) -> None:
    """Replace a table by the geometry-free columns."""
    df.drop("geom", "geometry", "ring").write.mode("overwrite").saveAsTable(table)


def stage(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Persist a stage; an existing one is reused unless forced."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_embeddings(df: DataFrame, root: str, version: str, partitions: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """Write the areas and years in ``df`` as a new run and return its provenance.

    The rows go to a folder of their own, which nobody reads yet. The provenance, counted over the rows as written, is
    then appended to ``{root}/embedding_runs`` by one file: it names the run's folder, so data and provenance appear
    together and what fails before leaves the former state. ``partitions`` (area, year) that ``df`` has no rows of
    become empty. Runs that another one has replaced keep their rows until ``drop_replaced`` is called.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    folder = f"{root}/embeddings/run={run}"
    df.write.partitionBy("aoi_id", "year").parquet(folder, compression="zstd")
    stored = spark.read.schema(df.schema).parquet(folder)
    found = _provenance(stored, version)
    if partitions:
        asked = spark.createDataFrame([(a, y) for a, y in partitions], "aoi_id string, year int")
        found = asked.join(found.withColumn("year", F.col("year").cast("int")), ["aoi_id", "year"], "full")
        found = found.withColumns({"n_pixels": F.coalesce("n_pixels", F.lit(0)), "dataset_version": F.lit(version)})
    order = 1 + (_runs(spark, root).agg(F.max("run_order")).first()[0] or 0)
    runs = found.select(
        F.col("aoi_id").cast("string"), F.col("year").cast("int"), "n_pixels", "bbox_wgs84", "dataset_version",
        F.lit(run).alias("run"), F.lit(order).cast("long").alias("run_order"),
    )
    # A row for each area and year: one file, whose appearance is the commit.
    runs = checkpointed(runs)
    runs.coalesce(1).write.mode("append").parquet(f"{root}/embedding_runs", compression="zstd")
    return runs


RUNS = "aoi_id string, year int, n_pixels long, bbox_wgs84 array<double>, dataset_version string, run string, run_order long"


def _runs(spark: SparkSession, root: str) -> DataFrame:
    """All runs; no folder yet means none."""
    spark.createDataFrame([], RUNS).write.mode("append").parquet(f"{root}/embedding_runs")
    return spark.read.schema(RUNS).parquet(f"{root}/embedding_runs")


def current_runs(spark: SparkSession, root: str) -> DataFrame:
    """The latest run of each area and year."""
    last = F.max_by(F.struct("n_pixels", "bbox_wgs84", "dataset_version", "run"), F.struct("run_order", "run")).alias("last")
    return _runs(spark, root).groupBy("aoi_id", "year").agg(last).select("aoi_id", "year", "last.*")


def clear_embeddings(spark: SparkSession, root: str, aoi_id: str, year: int) -> None:
    """Leave one area and year without rows, also where a run has found nothing for it."""
    order = 1 + (_runs(spark, root).agg(F.max("run_order")).first()[0] or 0)
    empty = spark.createDataFrame([(aoi_id, year, 0, None, None, "", order)], RUNS)
    empty.write.mode("append").parquet(f"{root}/embedding_runs", compression="zstd")


def _provenance(df: DataFrame, version: str) -> DataFrame:
    return df.groupBy("aoi_id", "year").agg(
        F.count(F.lit(1)).alias("n_pixels"),
        F.array(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).alias("bbox_wgs84"),
        F.lit(version).alias("dataset_version"),
    )


def read_embeddings(spark: SparkSession, root: str, aoi_id: str, year: int) -> DataFrame:
    """The rows of one area and year in their latest run."""
    same = (F.col("aoi_id") == aoi_id) & (F.col("year") == year)
    last = current_runs(spark, root).where(same).first()
    if last is None or not last.n_pixels:
        return spark.read.parquet(f"{root}/embeddings").where(F.lit(False)).drop("run")
    return spark.read.option("basePath", f"{root}/embeddings/run={last.run}").parquet(f"{root}/embeddings/run={last.run}").where(same)


def drop_replaced(spark: SparkSession, root: str) -> int:
    """Delete the folders of runs that no area and year points to any more; returns how many."""
    kept = current_runs(spark, root).select("run").distinct()
    old = [r.run for r in _runs(spark, root).select("run").distinct().join(kept, "run", "left_anti").where("run <> ''").collect()]
    for run in old:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/embeddings/run={run}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(old)


def _suffix(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def loadable_products(runs: DataFrame, aoi_id: str) -> DataFrame:
    """Registered map layers of an area; a Parquet file yields to its GeoJSON twin."""
    path = F.col("path")
    hits = runs.where((F.col("aoi_id") == aoi_id) & _suffix(path).isin(*LOADABLE)).withColumn(
        "_stem", _stem(path)
    )
    twins = hits.where(_suffix(path) == "geojson").select("_stem").distinct()
    others = hits.where(_suffix(path) != "parquet")
    alone = hits.where(_suffix(path) == "parquet").join(twins, "_stem", "left_anti")
    return others.unionByName(alone).drop("_stem")


def latest_products(runs: DataFrame, product: str = "produit", path: str = "path") -> DataFrame:
    """The lexically last path of each product."""
    return runs.groupBy(product).agg(F.max(path).alias(path))


def export_ranked(
    df: DataFrame, folder: str, score: str, key: str, top: int = 20, features: Sequence[str] = ()
) -> dict[str, str]:
    """Ranked table as Parquet, attributes as CSV, the short list as CSV and features as JSON."""
    order = [F.col(score).desc(), F.col(key)]
    flat = df.drop("geom", "ring", "cell", "h3_res8")
    out = {n: f"{folder}/{n}" for n in ("ranked.parquet", "ranked.csv", "top.csv", "features.json")}
    df.orderBy(*order).write.mode("overwrite").parquet(out["ranked.parquet"])
    flat.orderBy(*order).write.mode("overwrite").csv(out["ranked.csv"], header=True)
    flat.orderBy(*order).limit(top).write.mode("overwrite").csv(out["top.csv"], header=True)
    as_features(df, features or flat.columns).write.mode("overwrite").json(out["features.json"])
    return out


def as_features(df: DataFrame, properties: Sequence[str], geom: str = "geom") -> DataFrame:
    """GeoJSON-like features in degrees: the path of each outline from its edges."""
    from terrapulse.functions import crs as P

    def position(x: Column, y: Column) -> Column:
        return F.array(*P.l93_to_wgs84(x, y))

    starts = F.transform(geom, lambda e: position(e.getField("x1"), e.getField("y1")))
    last = F.element_at(geom, -1)
    ring = F.concat(starts, F.array(position(last.getField("x2"), last.getField("y2"))))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return df.select(
        F.lit("Feature").alias("type"),
        geometry.alias("geometry"),
        F.struct(*properties).alias("properties"),
    )


def export_layers(layers: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Control layers, one folder each."""
    out = {}
    for name, df in layers.items():
        out[name] = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(out[name])
    return out


def extract_region(
    source: DataFrame, communes: DataFrame, path: str, key: str, source_geom: str = "geom"
) -> DataFrame:
    """Features meeting any commune of the region, written once; ``key`` identifies a feature."""
    from terrapulse.operators.spatial import touching

    return stage(source.join(touching(source, communes, key, source_geom, "geom", 5_000.0), key, "left_semi"), path)
