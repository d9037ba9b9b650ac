import math
import random
import time

import pytest
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import hexgrid as H
from terrapulse.operators import mesh as M
from terrapulse.operators import overlay as OV
from terrapulse.operators import raster as R
from terrapulse.operators import spatial as SP
from terrapulse.operators.installable import installable_zone
from terrapulse.plans import burning as BU
from terrapulse.plans import interface as IF
from terrapulse.plans import vacancy as VA

RING = "array<struct<x:double,y:double>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def polygons(spark, named, key="fid"):
    rows = [(k, [(float(x), float(y)) for x, y in ring]) for k, ring in named.items()]
    df = spark.createDataFrame(rows, f"{key} string, ring {RING}")
    return df.withColumn("geom", G.ring_edges("ring"))


def one(spark, ring):
    return polygons(spark, {"a": ring})


def regular(n, cx, cy, r, turn):
    pts = [(cx + r * math.cos(turn + 2 * math.pi * i / n), cy + r * math.sin(turn + 2 * math.pi * i / n)) for i in range(n)]
    return pts + pts[:1]


def clip(subject, window):
    """Convex clipping, for checking."""
    out = subject[:-1]
    for (ax, ay), (bx, by) in zip(window, window[1:]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        kept = []
        for p, q in zip(out, out[1:] + out[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                kept.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = kept
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1]))) / 2 if len(out) > 2 else 0.0


def test_measures_of_a_concave_ring(spark):
    u = [(0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4), (0, 0)]
    far = [(x + 830000, y + 6390000) for x, y in u]
    cx, cy = G.centroid("geom")
    rx, ry = G.representative_point("geom")
    row = one(spark, far).select(
        G.area("geom").alias("a"), G.length("geom").alias("l"), cx.alias("cx"), cy.alias("cy"),
        rx.alias("rx"), ry.alias("ry"), G.contains_point("geom", "830002D", "6390000.5D").alias("in1"),
        G.contains_point("geom", "830002D", "6390002D").alias("in2"),
        G.point_distance("geom", "830002D", "6390003D").alias("d"),
    ).first()
    assert math.isclose(row.a, 10.0) and math.isclose(row.l, 22.0)
    assert abs(row.cx - 830002) < 1e-6 and abs(row.cy - 6390000 - (4 * 0.5 + 2 * 3 * 2.5) / 10) < 1e-6
    assert row.in1 and not row.in2 and math.isclose(row.d, 1.0)
    local = one(spark, far).select(G.contains_point("geom", f"double({row.rx!r})", f"double({row.ry!r})").alias("i"))
    assert local.first().i


def test_validity(spark):
    named = {"ok": box(0, 0, 1, 1), "bow": [(0, 0), (1, 0), (0, 1), (1, 1), (0, 0)], "open": [(0, 0), (1, 0), (1, 1), (0, 1)], "flat": [(0, 0), (1, 0), (2, 0), (0, 0)]}
    got = {r.fid: r.v for r in polygons(spark, named).select("fid", G.is_valid("ring").alias("v")).collect()}
    assert got == {"ok": True, "bow": False, "open": False, "flat": False}


def test_overlap_area_against_clipping(spark):
    rng = random.Random(5)
    a = {str(i): regular(5, rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0.5, 3), rng.random()) for i in range(25)}
    b = {str(i): regular(4, rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0.5, 3), rng.random()) for i in range(25)}
    left = polygons(spark, a).select("fid", "geom")
    right = polygons(spark, b).select("fid", F.col("geom").alias("bgeom"))
    got = left.join(right, "fid").select("fid", G.overlap_area("geom", "bgeom").alias("a"), G.intersects("geom", "bgeom").alias("i"))
    for r in got.collect():
        expected = clip(a[r.fid], b[r.fid])
        assert abs(r.a - expected) < 1e-9 and r.i == (expected > 0)


def test_overlap_with_shared_edges(spark):
    left = one(spark, box(0, 0, 4, 4)).select(F.col("geom"))
    for other, expected in ((box(0, 0, 2, 2), 4.0), (box(0, 0, 4, 4), 16.0), (box(4, 0, 6, 4), 0.0), (box(2, 0, 6, 4), 8.0), (box(-1, -1, 9, 9), 16.0)):
        right = one(spark, other).select(F.col("geom").alias("bgeom"))
        row = left.join(right).select(G.overlap_area("geom", "bgeom").alias("a"), G.intersects("geom", "bgeom").alias("i")).first()
        assert abs(row.a - expected) < 1e-9 and row.i


def test_hole_counts_as_outside(spark):
    rings = spark.createDataFrame([([[(float(x), float(y)) for x, y in box(0, 0, 10, 10)], [(float(x), float(y)) for x, y in reversed(box(4, 4, 6, 6))]],)], f"rings array<{RING}>")
    row = rings.select(G.rings_edges("rings").alias("geom")).select(
        G.area("geom").alias("a"), G.contains_point("geom", "5D", "5D").alias("hole"), G.contains_point("geom", "1D", "5D").alias("in")).first()
    assert (row.a, row.hole, row["in"]) == (96.0, False, True)


def test_near_span_against_sampling(spark):
    rng = random.Random(11)
    rows = [tuple(rng.uniform(0, 10) for _ in range(8)) for _ in range(60)] + [(0.0, 0.0, 10.0, 0.0, 2.0, 1.0, 5.0, 1.0), (0.0, 0.0, 10.0, 0.0, 3.0, 1.0, 3.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double, h double")
    segs = df.withColumns({"s": G.segment("a", "b", "c", "d"), "o": G.segment("e", "f", "g", "h")})
    got = segs.select("a", "b", "c", "d", "e", "f", "g", "h", G.near_span("s", "o", 1.5).alias("n")).collect()

    def dist(px, py, r):
        dx, dy = r.g - r.e, r.h - r.f
        t = max(0.0, min(1.0, ((px - r.e) * dx + (py - r.f) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - r.e - t * dx, py - r.f - t * dy)

    for r in got:
        ts = [i / 2000 for i in range(2001)]
        near = [t for t in ts if dist(r.a + t * (r.c - r.a), r.b + t * (r.d - r.b), r) <= 1.5]
        if not near:
            assert r.n is None or r.n.t1 - r.n.t0 < 2e-3
        else:
            assert abs(r.n.t0 - near[0]) < 1e-3 and abs(r.n.t1 - near[-1]) < 1e-3


def test_interface_fixture(spark):
    forest = polygons(spark, {"f": box(0, 0, 100, 100)}).select("fid", "geom")
    near = polygons(spark, {"b": box(120, 40, 140, 60)}).select("fid", "geom")
    row = IF.run(forest, near, 50.0, step=0.5).metrics.first()
    # Along x = 100 the reach is 50 m from the wall at 20 m: y from 40 - sqrt(2100) to 60 + sqrt(2100),
    # which the forest side [0, 100] cuts to its whole length; each of the other sides adds 10 m.
    assert abs(row.interface_length_m - 120.0) < 0.5 and abs(row.interface_zone_ha - 0.2518) < 0.01
    assert abs(row.bati_area_ha - 0.04) < 1e-9
    lower = polygons(spark, {"z": box(-10, -10, 200, 50)}).select("geom")
    half = IF.run(forest, near, 50.0, aoi=lower, step=0.5).metrics.first()
    assert 0 < half.interface_length_m < row.interface_length_m and half.interface_zone_ha < row.interface_zone_ha
    far = polygons(spark, {"b": box(300, 40, 320, 60)}).select("fid", "geom")
    none = IF.run(forest, far, 50.0, step=1.0).metrics.first()
    assert none.interface_length_m == 0.0 and none.interface_zone_ha == 0.0


def test_dissolve_drops_shared_borders(spark):
    tiles = polygons(spark, {"a": box(4, 44, 5, 45), "b": box(5, 44, 6, 45), "c": box(6, 44, 7, 45)}).select("fid", "geom")
    pieces = OV.dissolve_outline(tiles, "fid", cell=1.0)
    assert abs(OV.outline_area(pieces).first().area - 3.0) < 1e-9
    assert abs(OV.outline_length(pieces).first().length - 8.0) < 1e-9
    twice = polygons(spark, {"a": box(0, 0, 2, 2), "b": box(0, 0, 2, 2), "c": box(1, 1, 3, 3)}).select("fid", "geom")
    pieces = OV.dissolve_outline(twice, "fid", cell=1.0)
    assert abs(OV.outline_area(pieces).first().area - 7.0) < 1e-9


def test_installable_zone_of_a_rectangle(spark):
    lot = polygons(spark, {"p": box(0.3, 0.3, 30.3, 20.3)}, "pid").select("pid", "geom")
    none = lot.where("false").withColumnRenamed("geom", "footprint")
    row = installable_zone(lot, none, "pid", step=0.5).first()
    assert abs(row.install_m2 - 200.0) < 1e-6 and abs(row.install_x - 15.3) < 1e-6
    houses = polygons(spark, {"p": box(5.3, 5.3, 15.3, 15.3)}, "pid").select("pid", F.col("geom").alias("footprint"))
    doubled = houses.unionByName(houses)
    row = installable_zone(lot, doubled, "pid", step=0.5).first()
    assert abs(row.install_m2 - 100.0) < 1e-6 and abs(row.install_x - 20.3) < 1e-6


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(2)
    # A third of the points sit in one spot.
    pts = [(i, 500.0, 500.0) if i % 3 == 0 else (i, rng.uniform(0, 3000), rng.uniform(0, 3000)) for i in range(300)]
    lots = {f"L{i}": box(*(lambda x, y: (x, y, x + 20, y + 15))(rng.uniform(0, 3000), rng.uniform(0, 3000))) for i in range(60)}
    points = spark.createDataFrame(pts, "pid int, px double, py double")
    return points, pts, polygons(spark, lots, "lid").select("lid", "geom"), lots


def gap(ring, x, y):
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return math.hypot(max(min(xs) - x, x - max(xs), 0), max(min(ys) - y, y - max(ys), 0))


def test_joins_against_brute_force(spark, cloud):
    points, pts, lots, rings = cloud
    d = G.point_distance("geom", "px", "py")
    pairs = SP.within_pairs(lots, points, SP.geom_box("geom"), SP.point_box("px", "py"), d, 150.0)
    got = sorted((r.lid, r.pid) for r in pairs.select("lid", "pid").collect())
    expected = sorted((k, p[0]) for k, ring in rings.items() for p in pts if gap(ring, p[1], p[2]) <= 150)
    assert got == expected
    found = SP.nearest(lots, points, SP.geom_box("geom"), SP.point_box("px", "py"), d, "lid", "pid", 10.0)
    best = {k: min((gap(ring, p[1], p[2]), p[0]) for p in pts) for k, ring in rings.items()}
    rows = found.collect()
    assert len(rows) == len(best)
    for r in rows:
        assert abs(r.d - best[r.lid][0]) < 1e-9 and r.pid == best[r.lid][1]
    near = {r.lid for r in SP.nearest(lots, points, SP.geom_box("geom"), SP.point_box("px", "py"), d, "lid", "pid", 10.0, 60.0).collect()}
    assert near == {k for k, v in best.items() if v[0] <= 60}


def test_nearest_in_disk_against_brute_force(spark, cloud):
    points, pts, lots, rings = cloud
    edge, k = 120.0, 2
    c = lots.withColumn("_c", G.center("geom"))
    left = c.withColumn("cell", H.cell_of("_c.x", "_c.y", edge)).drop("_c")
    right = points.withColumn("pcell", H.cell_of("px", "py", edge))
    cells_l = {r.lid: (r.cell.q, r.cell.r) for r in left.select("lid", "cell").collect()}
    cells_p = {r.pid: (r.pcell.q, r.pcell.r) for r in right.select("pid", "pcell").collect()}
    apart = lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1]), abs(a[0] - b[0] + a[1] - b[1]))
    expected = {}
    for lid, ring in rings.items():
        cand = [(gap(ring, p[1], p[2]), p[0]) for p in pts if apart(cells_l[lid], cells_p[p[0]]) <= k]
        if cand:
            expected[lid] = min(cand)
    got = {r.lid: (r.d, r.pid) for r in SP.nearest_in_disk(left, right, "lid", "pid", [], k, edge).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[x][0] - expected[x][0]) < 1e-9 and got[x][1] == expected[x][1] for x in got)


def test_hexagons(spark):
    pts = spark.range(2000).select((F.rand(1) * 5000).alias("x"), (F.rand(2) * 5000).alias("y"))
    cell = pts.withColumn("c", H.cell_of("x", "y", 100.0))
    cx, cy = H.cell_center(F.col("c"), 100.0)
    assert cell.agg(F.max(F.hypot(cx - F.col("x"), cy - F.col("y"))).alias("m")).first().m <= 100.0 + 1e-9
    ring = spark.range(1).select(H.cell_boundary("named_struct('q', 3L, 'r', -2L)", 100.0).alias("ring"))
    area = ring.select(G.area(G.ring_edges.sql("ring")).alias("a")).first().a
    assert abs(area - 1.5 * math.sqrt(3) * 1e4) < 1e-6
    aoi = polygons(spark, {"big": box(0, 0, 2000, 2000), "tiny": box(1, 1, 2, 2)})
    grid = M.hex_grid(aoi, "fid", "geom", 150.0)
    counts = {r.fid: r["count"] for r in grid.groupBy("fid").count().collect()}
    assert counts["tiny"] == 1 and counts["big"] > 10
    assert M.hex_grid(aoi, "fid", "geom", 300.0).where("fid = 'big'").count() < counts["big"]


def test_slope_and_burning(spark):
    dem = spark.range(100).select((F.col("id") % 10).alias("col"), F.floor(F.col("id") / 10).alias("row"))
    dem = dem.withColumn("z", F.col("col") * 75.0 * 0.2)
    slope = R.slope_percent(dem, 75.0)
    assert slope.agg(F.min("slope").alias("a"), F.max("slope").alias("b")).first() == (20.0, 20.0)
    grid = R.grid(spark, 0.0, 0.0, 500.0, 500.0, 50.0)
    assert grid.count() == 100 and R.grid(spark, 0, 0, 1, 1, 50.0).count() == 1
    road = spark.range(1).select(G.line_edges("0D", "25D", "499D", "25D").alias("geom"))
    house = polygons(spark, {"h": box(200, 400, 220, 420)}).select("geom")
    cells = dem.select("col", "row")
    run = BU.run(cells, slope, road, house, 50.0)
    assert run.criteria == ["slope", "access"] and run.summary.first().n_a_exclure > 0
    with_trend = BU.run(cells, slope, road, house, 50.0, trend=cells.withColumn("value", F.lit(0.008)))
    assert "embroussaillement" in with_trend.criteria


def test_vacancy_fixture(spark):
    rows = polygons(spark, {"b-900000": box(900000, 6500000, 900020, 6500020), "b-900500": box(900500, 6500000, 900520, 6500020), "home": box(900100, 6500000, 900110, 6500010)}, "id_bati")
    usage = F.when(F.col("id_bati") == "home", "Résidentiel").otherwise("Industriel")
    rows = rows.withColumn("usage_1", usage).drop("ring")
    siret = spark.createDataFrame([("111", 900025.0, 6500010.0), ("111", 900025.0, 6500010.0), ("222", 900300.0, 6500000.0)], "siret string, px double, py double")
    run = VA.run(rows, siret, 15.0)
    got = {r.id_bati: (r.nb_etab_actifs, r.statut_occupation) for r in run.result.collect()}
    assert got == {"b-900000": (1, "OCCUPE"), "b-900500": (0, "VACANT_CANDIDAT")}
    assert [tuple(r) for r in run.attachments.collect()] == [("b-900000", "111")]
    s = run.summary.first()
    assert (s.nb_batiments_pro, s.nb_candidats_vacants, s.taux_apparent_pct, s.surface_vacante_m2) == (2, 1, 50.0, 400.0)
    mask = polygons(spark, {"m": box(899990, 6499990, 900050, 6500050)}).select("geom")
    assert [r.id_bati for r in VA.clip_by_point(rows, mask).collect()] == ["b-900000"]


def test_a_busy_building_keeps_all_its_establishments(spark):
    building = polygons(spark, {"b": box(900000, 6500000, 900020, 6500020)}, "id_bati").withColumn("usage_1", F.lit("Industriel")).drop("ring")
    points = spark.range(10_001).select(F.col("id").cast("string").alias("siret"), F.lit(900010.0).alias("px"), F.lit(6500010.0).alias("py"))
    run = VA.run(building, points, 15.0)
    assert run.result.first().nb_etab_actifs == 10_001
    assert run.attachments.select("siret").distinct().count() == 10_001


def test_band_ignores_far_buildings(spark):
    """A building of 400 million cells that no forest is near adds nothing, neither area nor rows; the rest stays as it was."""
    forest = polygons(spark, {"f": box(0, 0, 100, 100), "g": box(-90, -200, -30, -140)}).select("fid", "geom")
    near = {"a": box(105, 20, 140, 60), "b": box(-20, -150, -10, -120), "c": box(20, 40, 30, 70)}
    built = polygons(spark, near).select("geom")
    cells = R.cells_within(built, "geom", 20.0, 1.0).select("col", "row").distinct()
    expected = R.burn_centers(forest, "geom", 1.0).select("col", "row").distinct().join(cells, ["col", "row"]).count()
    far = polygons(spark, {**near, "d": box(100_000, 0, 120_000, 20_000)}).select("geom")
    start = time.monotonic()
    assert abs(OV.interface_band_ha(forest, far, 20.0, 1.0).first()[0] - expected / 10_000) < 1e-9
    assert expected > 1000 and time.monotonic() - start < 60


def test_cells_in_reach_are_intervals_of_rows(spark):
    """The same cells as by the distance of each, slanted and hollow outlines too."""
    rng = random.Random(9)
    shapes = {"t": [(3, 4), (61, 22), (17, 70), (3, 4)], "u": [(100, 0), (190, 0), (190, 90), (160, 90), (160, 30), (130, 30), (130, 90), (100, 90), (100, 0)]}
    for k in range(30):
        x, y = rng.uniform(-200, 200), rng.uniform(-200, 200)
        corners = sorted((rng.uniform(0, 6.28), rng.uniform(2, 9)) for _ in range(5))
        ring = [(x + r * math.cos(a), y + r * math.sin(a)) for a, r in corners]
        shapes[f"r{k}"] = [*ring, ring[0]]
    shapes["s"] = box(40, -60, 50, -50)  # with cells exactly at the radius
    built = polygons(spark, shapes).select("fid", "geom").cache()
    wanted = spark.range(-400, 400).selectExpr("id AS col").crossJoin(spark.range(-400, 400).selectExpr("id AS row"))
    for radius, step in ((0.0, 1.0), (2.5, 1.0), (7.5, 3.0), (80.0, 1.0)):
        plain, told = R.cells_within(built, "geom", radius, step), R.cells_within_of(built, "geom", radius, step, wanted)
        found = [{tuple(r) for r in cells.groupBy("fid", "row").agg(F.count("*"), F.sum("col"), F.min("col"), F.max("col")).collect()} for cells in (plain, told)]
        assert found[0] == found[1], (radius, step)


def test_near_reach_is_near_span_along_a_line(spark):
    rng = random.Random(5)
    rows = [tuple(rng.uniform(0, 10) for _ in range(5)) for _ in range(400)]
    rows += [(4.0, 1.0, 4.0, 9.0, 4.0), (4.0, 2.0, 4.0, 9.0, 2.0), (4.0, 2.0, 4.0, 2.0, 4.5), (5.0, 3.0, 3.0, 3.0, 7.0), (9.0, 3.0, 3.0, 3.0, 7.0), (4.0, 3.0, 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double, d double").withColumn("o", G.segment("a", "b", "c", "d"))
    df = df.withColumn("line", G.segment("-100D", "y", "100D", "y"))
    got = df.select(G.near_span("line", "o", 1.5).alias("n"), F.expr(G.near_reach.sql("y", "o", 1.5)).alias("own")).collect()
    assert any(r.n is None for r in got) and any(r.n is not None for r in got)
    for r in got:
        if r.n is None:
            assert r.own.a is None and r.own.b is None
        else:
            assert abs(200 * r.n.t0 - 100 - r.own.a) < 1e-6 and abs(200 * r.n.t1 - 100 - r.own.b) < 1e-6
