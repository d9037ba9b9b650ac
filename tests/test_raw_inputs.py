"""Jobs from raw layers: bands to zone statistics, elevation to aptitude."""

import datetime

from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.plans import burning as BU
from terrapulse.plans import vegetation as V


def box(x0, y0, x1, y1):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return [(*a, *b) for a, b in zip(ring, ring[1:])]


def test_aptitude_of_a_plane(spark):
    # Heights on a coarser grid rise a quarter of a metre a metre eastwards: a slope of 25 % everywhere.
    elevation = spark.range(-5, 40).select(F.col("id").alias("col")).join(spark.range(-5, 30).select(F.col("id").alias("row")), F.lit(True))
    elevation = elevation.withColumn("z", (F.col("col") + 0.5) * 75 * 0.25)
    roads = spark.createDataFrame([([(0.0, 305.0, 1000.0, 305.0)],)], f"geom {G.EDGES_TYPE}")
    buildings = spark.createDataFrame([(box(10.0, 10.0, 20.0, 20.0),)], f"geom {G.EDGES_TYPE}")
    run = BU.run_rasters(spark, (0.0, 0.0, 1000.0, 600.0), elevation, 75.0, roads, buildings, 50.0)
    assert run.criteria == ["slope", "access"]
    cells = {(r.col, r.row): r for r in run.cells.collect()}
    assert len(cells) == 20 * 12 and all(abs(r.slope - 25.0) < 1e-9 for r in cells.values())
    far = cells[10, 11]  # five rows of cells from the road
    assert abs(far.access - 0.5) < 1e-9 and abs(far.score - (20 + 15 * 0.5) / 35 * 100) < 1e-9 and far.classe == 2
    assert cells[0, 0].score == 0 and cells[0, 0].classe == 0  # beside a building
    summary = run.summary.first()
    assert summary.n_prioritaire + summary.n_a_etudier + summary.n_a_exclure == 240


def test_zones_from_bands(spark):
    """Two scenes of one solar day give its first valid value; polygons tell which pixels make a zone."""
    rows = []
    for pixel in range(4):
        for month in range(1, 13):
            at = datetime.datetime(2021, month, 5, 10, 0)
            nir = 5000.0 + 100 * pixel
            rows.append((pixel, at, 4.0, 1, 1200.0, nir, 9))  # a cloud
            rows.append((pixel, at + datetime.timedelta(seconds=20), 4.0, 2, 1200.0, nir, 4))
            rows.append((pixel, at + datetime.timedelta(seconds=40), 4.0, 3, 1200.0, 1300.0, 4))  # the day has a value already
    scenes = spark.createDataFrame(rows, "pixel_id long, ts timestamp, lon double, scene int, red double, nir double, scl int")
    pixels = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 0, 3), (3, 9, 9)], "pixel_id long, col long, row long")
    zones = spark.createDataFrame([(7, "south", box(1.0, 1.0, 19.0, 9.0)), (8, "north", box(1.0, 31.0, 9.0, 39.0))], f"zone int, nom string, geom {G.EDGES_TYPE}")
    placed = {(r.pixel_id, r.zone) for r in V.pixel_zones(pixels, zones, 10.0).collect()}
    assert placed == {(0, 7), (1, 7), (2, 8)}
    run = V.run_scenes(scenes, pixels, zones, 10.0)
    values = {(r.pixel_id, r.month.month): r.v for r in run.monthly.collect()}
    assert len(values) == 48
    for (pixel, _), v in values.items():
        red, nir = 0.02, (4000.0 + 100 * pixel) / 10000
        assert abs(v - (nir - red) / (nir + red)) < 1e-12
    stats = {r.zone: r for r in run.zone_stats.collect()}
    assert set(stats) == {7, 8} and stats[7].nom == "south" and abs(stats[7].mean_sen_slope) < 1e-12


def test_registry_in_degrees(spark):
    from terrapulse.plans import areas as AR

    area = spark.createDataFrame([("bbox", "x", box(699_000.0, 6_599_000.0, 701_000.0, 6_601_000.0))], f"kind string, name string, geom {G.EDGES_TYPE}")
    west, south, east, north = AR.register(area, projected=True).first().bbox_wgs84
    assert west < 3.0 < east and south < 46.5 < north and east - west < 0.03 and north - south < 0.02


def test_ids_without_a_name_do_not_depend_on_splits(spark, tmp_path):
    import json

    from terrapulse.sources import vectors as VE

    ring = lambda x: [[[x, 0], [x + 5, 0], [x + 5, 5], [x, 0]]]
    own = [{"type": "Feature", "properties": {"typepsc": "01"}, "geometry": {"type": "Polygon", "coordinates": ring(k % 7)}} for k in range(40)]
    path = f"{tmp_path}/woods.json"
    open(path, "w").write(json.dumps({"type": "FeatureCollection", "features": own}))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("1g", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append(sorted(r.id_ebc for r in VE.read_protected_woods(spark, path).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found[0] == found[1] and len(set(found[0])) == 40
