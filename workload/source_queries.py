"""Readers and stores over documents and tables that Spark writes from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import interchange as I
from terrapulse.session import checkpoint_root, checkpointed
from terrapulse.sources import establishments as ES
from terrapulse.sources import store as ST
from terrapulse.sources import suppliers as SU
from terrapulse.sources import vectors as VE
from terrapulse.sources.scenes import read_items
from workload import standins as D
from workload.job_queries import slanted
from workload.registry import query, r
from workload.standins import meets, with_

#: Elements of one document; a document is one row of text while it is written.
ELEMENTS = 2000


def scratch(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_documents(elements, key: str, head: str, tail: str, path: str) -> str:
    """Collections of the JSON texts in ``element``, each a file of one line in a folder of its own; returns their glob."""
    number = F.floor(F.col(key) / ELEMENTS)
    listed = elements.groupBy(number.alias("document")).agg(F.sort_array(F.collect_list(F.struct(key, "element"))).alias("own"))
    text = F.concat(F.lit(head), F.array_join(F.transform("own", lambda e: e["element"]), ", "), F.lit(tail))
    listed.select("document", text.alias("value")).write.partitionBy("document").text(path)
    return f"{path}/document=*"


def feature(properties, geometry_type, coordinates):
    """JSON text of a feature, its type first."""
    geometry = F.to_json(F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")))
    return F.concat(F.lit('{"type": "Feature", "properties": '), F.to_json(properties), F.lit(', "geometry": '), geometry, F.lit("}"))


def outline(*spots):
    return F.array(F.array(*[F.array(x.cast("double"), y.cast("double"), F.lit(9.0)) for x, y in spots]))


COLLECTION = '{"type": "FeatureCollection", "features": ['


def building_features(spark, sf, kind):
    b = D.buildings(spark, sf)
    c = {n: F.col(n) for n in ("minx", "miny", "maxx", "maxy")}
    ring = outline(*[(c[x], c[y]) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])
    return b.select("id_batiment", feature(kind, "Polygon", ring).alias("element"))


@query(
    "src06_geojson_features",
    with_("buildings") + """SELECT id_batiment::VARCHAR AS id, usage, round((maxx - minx) * (maxy - miny), 6) AS area FROM buildings""",
)
def geojson_features(spark, sf):
    kind = F.struct(F.col("id_batiment").alias("id"), F.col("usage"))
    path = write_documents(building_features(spark, sf, kind), "id_batiment", COLLECTION, "]}", scratch(spark, "geojson"))
    return VE.read_geojson(spark, path, ["id", "usage"]).select("id", "usage", r(G.area("geom")).alias("area"))


CLIP = {
    "zone": "SELECT min(minx) + 100 AS x0, min(miny) + 30 AS y0, max(maxx) - 150 AS x1, (min(miny) + max(maxy)) / 2 AS y1 FROM buildings",
    "cut": """SELECT id_batiment, greatest(least(maxx, x1) - greatest(minx, x0), 0) * greatest(least(maxy, y1) - greatest(miny, y0), 0) AS area
        FROM buildings, zone""",
}


@query("src06_clip_at_area", with_("buildings", **CLIP) + "SELECT id_batiment::VARCHAR AS id, round(area, 6) AS area FROM cut WHERE area > 1e-9")
def clip_at_area(spark, sf):
    b = D.buildings(spark, sf)
    kind = F.struct(F.col("id_batiment").alias("id"))
    path = write_documents(building_features(spark, sf, kind), "id_batiment", COLLECTION, "]}", scratch(spark, "geojson"))
    ends = b.agg(
        (F.min("minx") + 100).alias("x0"), (F.min("miny") + 30).alias("y0"),
        (F.max("maxx") - 150).alias("x1"), ((F.min("miny") + F.max("maxy")) / 2).alias("y1"),
    )
    area = ends.select(G.box_edges("x0", "y0", "x1", "y1").alias("geom"))
    return VE.read_geojson(spark, path, ["id"], area=area).select("id", r(G.area("geom")).alias("area")).where("area > 1e-9")


@query(
    "src07_osm_ways",
    """SELECT s_suppkey AS osm_id, round(sqrt(pow(0.25 + (s_suppkey % 3) / 8, 2) + pow(0.5, 2)) + 0.125, 6) AS length FROM supplier
        WHERE s_suppkey % 5 > 0""",
)
def osm_ways(spark, sf):
    k = F.col("s_suppkey")
    spots = [(4 + k % 7, 45 + k % 9), (4 + k % 7 + F.lit(0.25) + (k % 3) / 8, 45 + k % 9 + F.lit(0.5)), (4 + k % 7 + F.lit(0.375) + (k % 3) / 8, 45 + k % 9 + F.lit(0.5))]
    path = F.array(*[F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lon")) for x, y in spots])
    nodes = F.when(k % 5 > 0, path).otherwise(F.slice(path, 1, 1))
    way = F.concat(F.lit('{"type": "way", "id": '), k.cast("string"), F.lit(', "geometry": '), F.to_json(nodes), F.lit(', "tags": {"highway": "way out"}}'))
    elements = D.read(spark, sf, "supplier").select(k, way.alias("element"))
    found = VE.read_osm_ways(spark, write_documents(elements, "s_suppkey", '{"version": 0.6, "elements": [', "]}", scratch(spark, "osm")))
    return found.select("osm_id", r(G.length("geom")).alias("length"))


@query(
    "src08_scene_items",
    """SELECT 'S' || p_partkey AS id, (p_size * 2)::DOUBLE AS cloud_cover, CASE WHEN p_partkey % 3 = 0 THEN 'G' ELSE 'T' END || p_partkey % 50 AS tile,
        (p_partkey % 90)::DOUBLE AS minx, (p_partkey % 90 + 1)::DOUBLE AS maxx FROM part""",
)
def scene_items(spark, sf):
    k = F.col("p_partkey")
    box = F.array(*[(v).cast("double") for v in (k % 90, k % 40, k % 90 + 1, k % 40 + 1)])
    tile = F.struct(
        F.lit("2024-05-01T10:00:00Z").alias("datetime"), (F.col("p_size") * 2).cast("double").alias("eo:cloud_cover"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("T"), k % 50)).alias("s2:mgrs_tile"), F.concat(F.lit("G"), k % 50).alias("grid:code"),
    )
    item = F.concat(F.lit('{"type": "Feature", "id": "S'), k.cast("string"), F.lit('", "bbox": '), F.to_json(box), F.lit(', "properties": '), F.to_json(tile), F.lit("}"))
    elements = D.read(spark, sf, "part").select(k, item.alias("element"))
    path = write_documents(elements, "p_partkey", '{"params": {"max": 1}, "items": [', "]}", scratch(spark, "items"))
    return read_items(spark, path).select("id", "cloud_cover", "tile", "minx", "maxx")


@query(
    "src10_mass_file",
    """SELECT siret, arg_min(activite, k) AS activite_principale, arg_min(lat, k) AS latitude, arg_min(lon, k) AS longitude FROM (
        SELECT o_orderkey AS k, lpad((o_custkey % 700)::VARCHAR, 14, '0') AS siret, o_orderpriority AS activite,
        4 + (o_orderkey % 1000) / 1000.0::DOUBLE AS lon, 45 + (o_orderkey % 500) / 1000.0::DOUBLE AS lat FROM orders WHERE o_orderkey % 11 > 0)
        GROUP BY 1""",
)
def mass_file(spark, sf):
    k = F.col("o_orderkey")
    point = F.concat(F.lit("POINT ("), 4 + (k % 1000) / F.lit(1000.0), F.lit(" "), 45 + (k % 500) / F.lit(1000.0), F.lit(")"))
    raw = D.read(spark, sf, "orders").select(
        F.lpad((F.col("o_custkey") % 700).cast("string"), 14, "0").alias("siret"),
        F.col("o_orderpriority").alias("activitenaf"), F.when(k % 11 > 0, point).otherwise("POINT EMPTY").alias("the_geom"), k,
    )
    path = scratch(spark, "mass")
    raw.orderBy("o_orderkey").drop("o_orderkey").write.csv(path, header=True)
    found = ES.normalize_wkt_points(ES.in_file_order(spark.read.csv(path, header=True)), "_place")
    return found.select("siret", "activite_principale", "latitude", "longitude")


@query(
    "src11_api_pages",
    """SELECT siret, arg_min(name, (page, i)) AS denomination, arg_min(lat, (page, i)) AS latitude FROM (
        SELECT o_orderkey // 500 AS page, o_orderkey AS i, 'E' || o_custkey % 300 AS siret, 'C' || o_orderkey AS name,
        45 + (o_orderkey % 500) / 1000.0::DOUBLE AS lat FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 13 > 0) GROUP BY 1""",
)
def api_pages(spark, sf):
    k = F.col("o_orderkey")
    own = F.struct(
        F.concat(F.lit("E"), F.col("o_custkey") % 300).alias("siret"), F.col("o_orderpriority").alias("activite_principale"),
        F.when(F.col("o_orderstatus") == "P", "F").otherwise("A").alias("etat_administratif"),
        F.when(k % 13 > 0, (45 + (k % 500) / F.lit(1000.0)).cast("string")).alias("latitude"), F.lit("4.5").alias("longitude"),
    )
    company = F.struct(k.alias("k"), F.concat(F.lit("C"), k).alias("nom_complet"), F.lit(None).cast("string").alias("nom_raison_sociale"), F.array(own).alias("matching_etablissements"))
    pages = D.read(spark, sf, "orders").groupBy(F.floor(k / 500).alias("page")).agg(F.sort_array(F.collect_list(company)).alias("results"))
    return ES.establishments_from_pages(pages).select("siret", "denomination", "latitude")


@query(
    "src13_protected_woods",
    with_("woods")
    + """SELECT CASE WHEN id_ebc % 4 = 0 THEN 'made' ELSE 'K' || id_ebc END AS id_ebc, count(*) AS n, round(sum((maxx - minx) * (maxy - miny)), 4) AS area
        FROM woods WHERE id_ebc % 3 > 0 GROUP BY 1""",
)
def protected_woods(spark, sf):
    w = D.woods(spark, sf)
    k = F.col("id_ebc")
    properties = F.struct(F.when(k % 3 > 0, "01").otherwise("07").alias("typepsc"), F.when(k % 4 > 0, F.concat(F.lit("K"), k)).alias("idpsc"))
    c = {n: F.col(n) for n in ("minx", "miny", "maxx", "maxy")}
    ring = outline(*[(c[x], c[y]) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])
    elements = w.select("id_ebc", feature(properties, "Polygon", ring).alias("element"))
    found = VE.read_protected_woods(spark, write_documents(elements, "id_ebc", COLLECTION, "]}", scratch(spark, "woods")))
    named = F.when(F.col("id_ebc").startswith("EBC"), "made").otherwise(F.col("id_ebc"))
    # Every zone has an id of its own.
    ids = found.groupBy(named.alias("id_ebc")).agg(F.countDistinct("id_ebc").alias("n"), F.sum(G.area("geom")).alias("area"))
    return ids.select("id_ebc", "n", r("area", 4).alias("area"))


@query(
    "src14_points_in_area",
    """SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_custkey % 10 BETWEEN 3 AND 6 AND c_custkey % 7 BETWEEN 2 AND 4""",
)
def points_in_area(spark, sf):
    """Places in whole hundredths of a degree; the area's border runs between them."""
    k = F.col("c_custkey")
    rows = D.read(spark, sf, "customer").select(k.alias("id"), (4 + (k % 10) / F.lit(100.0)).alias("LON"), (45 + (k % 7) / F.lit(100.0)).alias("Lat"))
    path = scratch(spark, "points")
    rows.write.csv(path, header=True, sep=";")
    from terrapulse.functions import crs as P

    spots = [(4.025, 45.015), (4.065, 45.015), (4.065, 45.045), (4.025, 45.045), (4.025, 45.015)]
    ring = F.array(*[F.struct(*[c.alias(n) for c, n in zip(P.wgs84_to_l93(F.lit(x), F.lit(y)), "xy", strict=True)]) for x, y in spots])
    area = spark.range(1).select(ring.alias("ring")).select(G.ring_edges("ring").alias("geom"))
    return VE.read_points_csv(spark, path, ["lon"], ["lat"], area=area).select("id")


@query(
    "src16_supplier_rows",
    """SELECT row_number() OVER (ORDER BY s_suppkey) AS source_row, 'F' || s_suppkey AS supplier_id, s_name AS source_commodity,
        45 + (s_suppkey % 100) / 100.0::DOUBLE AS latitude FROM supplier""",
)
def supplier_rows(spark, sf):
    k = F.col("s_suppkey")
    rows = D.read(spark, sf, "supplier").select(
        k, F.concat(F.lit("F"), k).alias("farm_id"), F.col("s_name").alias("product"),
        F.translate((45 + (k % 100) / F.lit(100.0)).cast("string"), ".", ",").alias("lat"), (k % 10).alias("lon"),
    )
    path = scratch(spark, "suppliers")
    rows.orderBy("s_suppkey").drop("s_suppkey").write.csv(path, header=True)
    return SU.read_suppliers(spark, path).select("source_row", "supplier_id", "source_commodity", "latitude")


@query(
    "src17_embedding_store",
    """SELECT 'a' || label AS aoi_id, CASE WHEN label % 2 = 0 THEN 'v2' ELSE 'v1' END AS version,
        CASE WHEN label = 4 THEN 0 ELSE count(*) FILTER (label % 2 = 1 OR vec_id % 3 = 0) END AS n_pixels FROM embeddings GROUP BY label""",
)
def embedding_store(spark, sf):
    root = scratch(spark, "embedding-store")
    rows = D.read(spark, sf, "embeddings").select(
        F.concat(F.lit("a"), "label").alias("aoi_id"), F.lit(2020).alias("year"), F.col("vec_id").alias("pixel_id"), "label",
        (F.col("vec_id") % 10).cast("double").alias("lon"), F.lit(45.0).alias("lat"), "embedding",
    )
    ST.write_embeddings(rows, root, "v1")
    again = rows.where("label % 2 = 0 and label <> 4 and pixel_id % 3 = 0")
    ST.write_embeddings(again, root, "v2", [(f"a{k}", 2020) for k in (0, 2, 4, 6, 8)])
    runs = ST.current_runs(spark, root)
    stored = spark.read.parquet(f"{root}/embeddings").groupBy("aoi_id", "run").agg(F.count("*").alias("held"))
    met = runs.join(stored, ["aoi_id", "run"], "left")
    return met.select("aoi_id", F.col("dataset_version").alias("version"), F.when(F.coalesce("held", F.lit(0)) == F.col("n_pixels"), F.col("n_pixels")).alias("n_pixels"))


@query(
    "src18_product_layout",
    with_("parcels", "buildings")
    + """SELECT 'lots' AS product, 'none' AS "window", count(*) AS n, round(sum((maxx - minx) * (maxy - miny)), 4) AS area FROM parcels
        UNION ALL SELECT 'bati', '2020_2024', count(*), round(sum((maxx - minx) * (maxy - miny)), 4) FROM buildings""",
)
def product_layout(spark, sf):
    root = scratch(spark, "products")
    ST.write_product(D.parcels(spark, sf).select("id_parcelle", "geom"), root, "siting", "a1", "lots")
    ST.write_product(D.buildings(spark, sf).select("id_batiment", "geom"), root, "siting", "a1", "bati", "2020_2024")
    paths = [(p, w, ST.product_path(root, "siting", "a1", p, None if w == "none" else w)) for p, w in (("lots", "none"), ("bati", "2020_2024"))]
    found = None
    for product, window, path in paths:
        read = VE.with_edges(spark.read.parquet(path))
        row = read.agg(F.count("*").alias("n"), F.sum(G.area("geom")).alias("area"))
        row = row.select(F.lit(product).alias("product"), F.lit(window).alias("window"), "n", r("area", 4).alias("area"))
        found = row if found is None else found.unionByName(row)
    return found


@query(
    "src03_attribute_table",
    with_("buildings") + "SELECT usage, count(*) AS n, 0::BIGINT AS geometries FROM buildings GROUP BY 1",
)
def attribute_table(spark, sf):
    name = f"attributes_{uuid.uuid4().hex}"
    with_database(spark, lambda: ST.write_attributes(D.buildings(spark, sf).select("id_batiment", "usage", "geom", "ring"), name))
    read = spark.table(f"{database(spark)}.{name}")
    left = sum(c in ("geom", "geometry", "ring") for c in read.columns)
    return read.groupBy("usage").agg(F.count("*").alias("n"), F.lit(left).cast("bigint").alias("geometries"))


_DATABASES: dict[str, str] = {}


def database(spark) -> str:
    """A database of this application in the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _DATABASES:
        name = f"store_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch(spark, 'database')}'")
        _DATABASES[app] = name
    return _DATABASES[app]


def with_database(spark, work):
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(database(spark))
    try:
        return work()
    finally:
        spark.catalog.setCurrentDatabase(before)


@query(
    "src04_replaced_partition",
    with_("buildings")
    + """SELECT 'a' || commune % 3 AS aoi_id, count(*) AS n FROM buildings WHERE commune % 3 <> 1 OR id_batiment % 2 = 0 GROUP BY 1
        HAVING 'a' || commune % 3 <> 'a2'""",
)
def replaced_partition(spark, sf):
    b = D.buildings(spark, sf)
    rows = b.select(F.col("id_batiment").cast("string").alias("id_bati"), "usage_1", "geom", "commune", "id_batiment")

    def work():
        ST.apply_schema(spark)
        for k in range(3):
            ST.replace_partition(rows.where(F.col("commune") % 3 == k), "vacancy_buildings", f"a{k}")
        ST.replace_partition(rows.where("commune % 3 = 1 and id_batiment % 2 = 0"), "vacancy_buildings", "a1")
        ST.replace_partition(rows.limit(0), "vacancy_buildings", "a2")
        ST.apply_schema(spark)  # an existing table stays as it is
        return spark.table("vacancy_buildings").groupBy("aoi_id").agg(F.count("*").alias("n"))

    return with_database(spark, work)


@query(
    "src23_stage_product",
    with_("parcels") + "SELECT commune, count(*) AS n FROM parcels WHERE id_parcelle % 2 = 0 GROUP BY 1",
)
def stage_product(spark, sf):
    path, own = scratch(spark, "stage"), D.parcels(spark, sf).select("id_parcelle", "commune")
    ST.stage(own, path)
    ST.stage(own.where("id_parcelle % 2 = 0"), path, force=True)
    kept = ST.stage(own.limit(0), path)  # what is there is used
    return kept.groupBy("commune").agg(F.count("*").alias("n"))


@query(
    "src24_region_extract",
    with_("parcels", "flood") + f"SELECT id_parcelle FROM parcels p WHERE EXISTS (SELECT 1 FROM flood f WHERE {meets('p', 'f')})",
)
def region_extract(spark, sf):
    kept = ST.extract_region(D.parcels(spark, sf), D.flood_zones(spark, sf), scratch(spark, "region"), "id_parcelle")
    return kept.select("id_parcelle")


@query(
    "geo06_drop_z",
    with_("buildings") + "SELECT id_batiment AS id, 2::BIGINT AS dimensions, round(minx + miny + maxx + miny, 6) AS total FROM buildings",
)
def drop_z(spark, sf):
    line = F.array(F.array("minx", "miny", F.lit(7.0)), F.array("maxx", "miny"))
    flat = D.buildings(spark, sf).select(F.col("id_batiment").alias("id"), line.alias("line")).withColumn("flat", G.drop_z("line"))
    dims = F.array_max(F.transform("flat", lambda p: F.lit(len(("x", "y")))))
    total = F.aggregate("flat", F.lit(0.0), lambda s, p: s + p["x"] + p["y"])
    return flat.select("id", dims.cast("bigint").alias("dimensions"), r(total).alias("total"))


@query(
    "src02_shuffled_edges",
    with_("buildings", slanted="""SELECT id_batiment AS id, (maxx - minx + 10) * (maxy - miny + 10) * 0.9 - 4
        + CASE WHEN id_batiment % 3 = 0 THEN 8 ELSE 0 END AS area FROM buildings""")
    + "SELECT id, round(area, 6) AS area, CASE WHEN id % 3 = 0 THEN 'MULTIPOLYGON' ELSE 'POLYGON' END AS kind FROM slanted",
)
def shuffled_edges(spark, sf):
    """Edges in another order make the same rings again."""
    layer = VE.with_edges(slanted(spark, sf))
    mixed = layer.withColumn("geom", F.expr("transform(array_sort(transform(geom, e -> struct(xxhash64(e) AS h, e AS e))), s -> s.e)"))
    mixed = mixed.withColumn("geom", F.explode_outer(F.array("geom")))
    text = checkpointed(mixed.select("id", I.edges_wkt(F.col("geom")).alias("wkt")))
    back = text.select("id", F.regexp_extract("wkt", "^[A-Z]+", 0).alias("kind"), I.wkt_edges("wkt").alias("geom"))
    return back.select("id", r(G.area("geom")).alias("area"), "kind")
