import math

from pyspark.sql import functions as F

from terrapulse.functions import crs as P
from terrapulse.functions import indices as I
from terrapulse.functions import scoring as S
from terrapulse.functions import text as T


def values(df, *cols):
    return [tuple(row[c] for c in cols) for row in df.collect()]


def test_ndvi_and_mask(spark):
    df = spark.createDataFrame(
        [(0.2, 0.6, 4), (0.5, 0.5, 9), (0.0, 0.0, 3)], "red double, nir double, scl int"
    )
    out = df.select(
        I.ndvi(df.red, df.nir).alias("n"),
        I.ndvi(df.red * 10000, df.nir * 10000).alias("scaled"),
        I.masked_ndvi(F.lit(0.2), F.lit(0.6), df.scl).alias("m"),
    )
    got = values(out, "n", "scaled", "m")
    assert [v is None or round(v, 9) for v, _, _ in got] == [0.5, 0.0, True]
    assert [v is None or round(v, 9) for _, v, _ in got] == [0.5, 0.0, True]
    assert [m for _, _, m in got][1:] == [None, None] and math.isclose(got[0][2], 0.5)


def test_reflectance(spark):
    cube = spark.createDataFrame([(1200, 5200, 4)], "red int, nir int, scl int")
    row = I.harmonize_reflectance(cube).first()
    assert math.isclose(row.red, 0.02) and math.isclose(row.nir, 0.42) and row.scl == 4


def test_aptitude_three_cells(spark):
    rows = [(0.9, 0.8, 25.0, 0.9, 0.6, False), (0.2, 0.1, 3.0, 0.5, 0.2, False), (0.8, 0.7, 30.0, 0.8, 0.6, True)]
    df = spark.createDataFrame(rows, "c double, e double, s double, a double, h double, x boolean")
    score = S.aptitude(
        [(df.c, 25), (df.e, 25), (S.band(df.s, 15, 40, 10), 20), (df.a, 15), (df.h, 15)], df.x
    )
    assert [r.k for r in df.select(S.three_classes(score).alias("k")).collect()] == [2, 0, 0]


def test_priority_score(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (0.5, 0.5)], "a double, b double")
    got = [round(r.s, 9) for r in df.select(S.priority_score([df.a, df.b]).alias("s")).collect()]
    assert got == [100.0, 0.0, 50.0]
    classes = spark.createDataFrame([(10.0,), (40.0,), (80.0,)], "s double")
    assert [r.k for r in classes.select(S.three_classes(classes.s).alias("k")).collect()] == [0, 1, 2]


def test_class_uses_unrounded_total(spark):
    df = spark.createDataFrame([(89.96,)], "t double")
    row = df.select(S.total_score([df.t]).alias("s"), S.total_class([df.t]).alias("k")).first()
    assert (row.s, row.k) == (90.0, "Bon")


def test_forest_and_header_matching(spark):
    df = spark.createDataFrame([("Forêt fermée",), ("Bois",), ("Vigne",), (None,)], "nature string")
    assert [r.f for r in df.select(T.is_forest(df.nature).alias("f")).collect()] == [True, True, False, False]
    assert T.find_column([" Supplier-Lat ", "y"], ["latitude", "supplier_lat"]) == " Supplier-Lat "


def test_projection_origin_and_round_trips(spark):
    df = spark.createDataFrame([(3.0, 46.5), (-1.3, 43.2), (7.6, 49.1)], "lon double, lat double")
    lon, lat = F.col("lon"), F.col("lat")
    x, y = P.wgs84_to_l93(lon, lat)
    mx, my = P.wgs84_to_mercator(lon, lat)
    ux, uy = P.wgs84_to_utm31(lon, lat)
    there = df.select("lon", "lat", *[c.alias(n) for c, n in zip((x, y, mx, my, ux, uy), ("x", "y", "mx", "my", "ux", "uy"))])
    first = there.first()
    assert abs(first.x - 700000) < 1e-6 and abs(first.y - 6600000) < 1e-4
    for transform, a, b in ((P.l93_to_wgs84, "x", "y"), (P.mercator_to_wgs84, "mx", "my"), (P.utm31_to_wgs84, "ux", "uy")):
        blon, blat = transform(F.col(a), F.col(b))
        worst = there.agg(
            F.max(F.abs(blon - F.col("lon"))).alias("dx"), F.max(F.abs(blat - F.col("lat"))).alias("dy")
        ).first()
        assert worst.dx < 1e-8 and worst.dy < 1e-8
    assert abs(there.where("lon = 3.0").first().ux - 500000) < 1e-6


def test_bbox_reprojection(spark):
    b = P.reproject_bbox(F.lit(4.0), F.lit(44.0), F.lit(5.0), F.lit(45.0), P.wgs84_to_l93)
    row = spark.range(1).select(*[c.alias(n) for n, c in b.items()]).first()
    assert row.minx < row.maxx and row.miny < row.maxy and 770000 < row.minx < 800000
