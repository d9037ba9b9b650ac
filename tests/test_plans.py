"""Plans of joins whose sides grow with the data."""

from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import hexgrid as H
from terrapulse.operators import pyramid as PY
from terrapulse.operators import spatial as SP
from terrapulse.operators.installable import installable_zone
from terrapulse.plans import siting as SI
from terrapulse.session import checkpointed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_layer_is_broadcast(spark):
    """Stored tables are far smaller in bytes than in rows: none may be taken for a small side."""
    k = F.col("id") * 50
    corners = {"minx": k + 0.5, "miny": k + 0.5, "maxx": k + 20.5, "maxy": k + 20.5}
    boxes = spark.range(300).withColumns(corners).select("id", G.box_edges(*corners).alias("geom"))
    left = checkpointed(boxes.withColumn("_c", G.center("geom")).withColumn("cell", H.cell_of("_c.x", "_c.y", 100.0)).drop("_c"))
    right = checkpointed(boxes.select(F.col("id").alias("other"), F.col("geom").alias("shape")))
    spots = spark.range(300).select(F.col("id").alias("spot"), (k + 30.0).alias("px"), (k + 30.0).alias("py"))
    points = checkpointed(spots.withColumn("pcell", H.cell_of("px", "py", 100.0)))
    d = G.distance("geom", "shape", True, False)
    ends = (SP.geom_box("geom"), SP.geom_box("shape"))
    joins = {
        "cells": SP.cell_join(left, right, *ends, 100.0),
        "hexagons": SP.hex_disk_pairs(left, points, "cell", "pcell", 3),
        "disk": SP.nearest_in_disk(left, points, "id", "spot", [], 3, 100.0),
        "nearest": SP.nearest(left.select("id", "geom"), right, *ends, d, "id", "other", 5.0),
        "matched": SP.drop_matched(left, points.withColumnRenamed("spot", "id"), "id"),
        "flagged": SP.flag_matched(left, points.withColumnRenamed("spot", "id"), "id", "near"),
        "zone": installable_zone(left, right.select(F.col("other").alias("id"), F.col("shape").alias("footprint")), "id"),
        "audit": SI.audit_layer(
            left.select("id", *[F.lit(0).alias(c) for c in ("surface_m2", "surface_libre_m2", "count_resid", "count_immeuble")]).withColumnRenamed("id", "id_parcelle"),
            [points.select(F.col("spot").alias("id_parcelle"))],
            points.select(F.col("spot").alias("id_parcelle"), F.lit("Bon").alias("classe"), F.lit(1.0).alias("score_total")),
        ),
    }
    assert [name for name, df in joins.items() if "BroadcastHashJoin" in plan(df)] == []


def test_a_wide_disk_meets_few_points(spark):
    """Rows away from a field of points: the nearest is found without the distance to all points of the disk."""
    k = F.col("id")
    points = spark.range(2500).select(k.alias("spot"), ((k % 50) * 40).cast("double").alias("px"), (F.floor(k / 50) * 40 + 900).cast("double").alias("py"))
    points = points.withColumn("pcell", H.cell_of("px", "py", 100.0))
    corners = {"minx": k * 190 + 0.3, "miny": k * 20 + 0.4, "maxx": k * 190 + 20.3, "maxy": k * 20 + 20.4}
    rows = spark.range(10).withColumns(corners).withColumn("geom", G.box_edges(*corners))
    rows = rows.withColumn("_c", G.center("geom")).withColumn("cell", H.cell_of("_c.x", "_c.y", 100.0))
    d = G.point_distance("geom", "px", "py")
    disk = SP.hex_disk_pairs(rows, points, "cell", "pcell", 12)
    expected = {r.id: (r.spot, r.d) for r in SP.best_pair(disk.withColumn("d", d), "id", "spot", []).collect()}
    found = SP.nearest_in_disk(rows, points, "id", "spot", [], 12, 100.0)
    assert {r.id: (r.spot, r.d) for r in found.collect()} == expected and len(expected) == 10
    asked = rows.select("id", "cell", PY._boxed("lbox", SP.geom_box("geom")))
    few = PY.candidates_in_disk(asked, points, "id", "spot", lambda a, b: SP.hex_disk_pairs(a, b, "cell", "pcell", 12))
    assert few.count() * 20 < disk.count()


def test_a_crowded_key_is_dealt(spark):
    many = spark.range(3 * PY.DEALT).select("id", F.lit(1).alias("at"))
    few = spark.createDataFrame([(1, "a"), (2, "b")], "at int, name string")
    met = PY.dealt_join(many, few, ["at"], "id")
    assert met.count() == met.select("id").distinct().count() == 3 * PY.DEALT
