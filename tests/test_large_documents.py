"""Collections read by many tasks, row numbers over splits, clipping, and stores that appear at once."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import interchange as I
from terrapulse.sources import elements as E
from terrapulse.sources import establishments as ES
from terrapulse.sources import store as ST
from terrapulse.sources import suppliers as SU
from terrapulse.sources import vectors as VE
from terrapulse.sources.scenes import read_items


def features(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = round(rng.uniform(0, 1e5), 3), round(rng.uniform(0, 1e5), 3)
        ring = [[x, y, 5.0], [x + 9, y, 5.0], [x + 9, y + 7.5, 5.0], [x, y, 5.0]]
        odd = ['a "quoted" word', 'the \\"Feature\\" of it', "}, {", "é\n]", ""][i % 5]
        out.append({"type": "Feature", "properties": {"id": str(i), "note": odd, "n": i}, "geometry": {"type": "Polygon", "coordinates": [ring]}})
    return out


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(old, (str(size), "0"))]
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_collection_is_one_whatever_the_splits(spark, tmp_path, small_splits):
    listed = features(300)
    for name, text in {
        "one line": json.dumps({"type": "FeatureCollection", "features": listed}),
        "indented": json.dumps({"type": "FeatureCollection", "name": "x", "features": listed}, indent=2),
        "no spaces": json.dumps({"type": "FeatureCollection", "features": listed}, separators=(",", ":")),
    }.items():
        path = f"{tmp_path}/{name}.geojson"
        open(path, "w").write(text)
        assert E.splits_at(spark, path, "Feature")
        for size in (1 << 30, 40_000, 3000, 517):
            small_splits(size)
            rows = VE.read_geojson(spark, path, ["id", "note"])
            tasks = E.pieces(spark, path, "Feature").rdd.getNumPartitions()
            assert tasks >= min(200, len(text) // size)
            got = {r.id: (r.note, tuple(map(tuple, r.geom))) for r in rows.collect()}
            assert len(got) == 300
            for f in listed:
                ring = [tuple(p[:2]) for p in f["geometry"]["coordinates"][0]]
                assert got[f["properties"]["id"]] == (f["properties"]["note"], tuple((*a, *b) for a, b in zip(ring, ring[1:])))


def test_other_forms_are_read_as_a_whole(spark, tmp_path):
    listed = features(20)
    last = [{"geometry": f["geometry"], "properties": f["properties"], "type": "Feature"} for f in listed]
    value = [{**f, "properties": {**f["properties"], "kind": "Feature"}} for f in listed]
    for name, own in {"type last": last, "a value": value}.items():
        path = f"{tmp_path}/{name}.geojson"
        open(path, "w").write(json.dumps({"type": "FeatureCollection", "features": own}))
        assert not E.splits_at(spark, path, "Feature")
        assert sorted(int(r.id) for r in VE.read_geojson(spark, path, ["id"]).collect()) == list(range(20))
    path = f"{tmp_path}/none.geojson"
    open(path, "w").write('{"type": "FeatureCollection", "features": []}')
    assert VE.read_geojson(spark, path, ["id"]).count() == 0


def test_ways_and_items(spark, tmp_path, small_splits):
    ways = [{"type": "way", "id": i, "nodes": [1, 2], "geometry": [{"lat": 45.0 + i, "lon": 4.0}, {"lat": 45.5 + i, "lon": 4.5}][: 1 + (i % 4 > 0)], "tags": {"name": 'a "way" out'}} for i in range(100)]
    path = f"{tmp_path}/osm.json"
    open(path, "w").write(json.dumps({"version": 0.6, "elements": ways}))
    items = [{"type": "Feature", "id": f"S{i}", "bbox": [i, 0, i + 1, 1], "properties": {"datetime": "2024-01-01T00:00:00Z", "eo:cloud_cover": i / 2, "grid:code": "T"}} for i in range(50)]
    open(f"{tmp_path}/items.json", "w").write(json.dumps({"params": {"max": 3}, "items": items}))
    open(f"{tmp_path}/bare.json", "w").write(json.dumps({"params": {}, "items": [{k: v for k, v in i.items() if k != "type"} for i in items]}))
    for size in (1 << 30, 700):
        small_splits(size)
        got = VE.read_osm_ways(spark, path).collect()
        assert sorted(r.osm_id for r in got) == [i for i in range(100) if i % 4 > 0]
        assert all(r.geom[0].y1 == 45.0 + r.osm_id for r in got)
        for name in ("items", "bare"):
            assert sorted((r.id, r.cloud_cover, r.tile, r.minx) for r in read_items(spark, f"{tmp_path}/{name}.json").collect()) == sorted((f"S{i}", i / 2, "T", float(i)) for i in range(50))


def test_row_numbers_over_files_and_splits(spark, tmp_path, small_splits):
    lines = []
    for part, n in enumerate((400, 0, 3, 250)):
        rows = [f"F{part}-{i},{44 + i / 1000},{4}" for i in range(n)]
        lines += rows
        open(f"{tmp_path}/p{part}.csv", "w").write("\n".join(["supplier_id,lat,lon", *rows]) + "\n")
    want = {r.split(",")[0]: i + 1 for i, r in enumerate(lines)}
    for size in (1 << 30, 1000, 211):
        small_splits(size)
        got = {r.supplier_id: r.source_row for r in SU.read_suppliers(spark, str(tmp_path)).collect()}
        assert got == want
    frame = spark.range(0, 5000, 1, 7).withColumnRenamed("id", "n")
    assert [(r.n, r.source_row) for r in SU.numbered(frame).orderBy("n").collect()] == [(i, i + 1) for i in range(5000)]
    assert SU.numbered(frame.limit(0)).count() == 0


def test_the_first_row_of_the_file(spark, tmp_path, small_splits):
    rows = [f"{i % 50:014d},45.{i},4.0,{'zyx'[i % 3]}{i}" for i in range(600)]
    path = f"{tmp_path}/e.csv"
    open(path, "w").write("siret,latitude,longitude,activitePrincipaleEtablissement\n" + "\n".join(rows) + "\n")
    for size in (1 << 30, 900):
        small_splits(size)
        got = {r.siret: r.latitude for r in ES.read_geofile(spark, path).collect()}
        assert got == {f"{i:014d}": float(f"45.{i}") for i in range(50)}


def cut_convex(ring, clip):
    """One convex ring cuts another polygon, side by side; an independent way to the area."""
    out = ring[:-1]
    for (ax, ay), (bx, by) in zip(clip, clip[1:]):
        given, out = out, []
        inside = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) >= 0  # noqa: E731, B023
        for p, q in zip(given, given[1:] + given[:1]):
            if inside(p) != inside(q):
                d = [(bx - ax) * (s[1] - ay) - (by - ay) * (s[0] - ax) for s in (p, q)]
                t = d[0] / (d[0] - d[1])
                cross = (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))
                out += [cross, q] if inside(q) else [cross]
            elif inside(q):
                out.append(q)
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1]))) / 2 if out else 0.0


def star(cx, cy, inner, outer, n, turn):
    at = [(turn + math.pi * k / n, outer if k % 2 else inner) for k in range(2 * n)]
    ring = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in at]
    return [*ring, ring[0]]


def edges(*rings):
    return [tuple(map(float, (*a, *b))) for ring in rings for a, b in zip(ring, ring[1:])]


def test_clipping_gives_outlines(spark):
    rng = random.Random(4)
    clip = star(0, 0, 100, 101, 4, 0.2)  # nearly a circle of eight corners, convex
    shapes = {}
    for i in range(60):
        ring = star(rng.uniform(-120, 120), rng.uniform(-120, 120), rng.uniform(10, 30), rng.uniform(31, 90), rng.randint(3, 6), rng.random())
        cx = sum(p[0] for p in ring[:-1]) / (len(ring) - 1)
        cy = sum(p[1] for p in ring[:-1]) / (len(ring) - 1)
        hole = star(cx, cy, 3, 5, 3, rng.random())[::-1]
        shapes[i] = (ring, hole)
    layer = spark.createDataFrame([(i, edges(*s)) for i, s in shapes.items()], f"id int, geom {G.EDGES_TYPE}")
    area = spark.createDataFrame([(edges(clip),)], f"geom {G.EDGES_TYPE}")
    cut = VE.cut_at(layer, area)
    assert cut.columns == layer.columns
    got = {r.id: r for r in cut.select("id", "geom", G.area("geom").alias("area")).collect()}
    for i, (ring, hole) in shapes.items():
        want = cut_convex(ring, clip) - cut_convex(hole[::-1], clip)
        assert abs((got[i].area if i in got else 0.0) - want) < 1e-6, i
        if i in got:
            points, lines, polygons = I.shapes([e.asDict() for e in got[i].geom])
            assert not points and not lines and polygons  # closed rings only
    # A ring with a hole as the area, features over the hole's rim, within it and around it.
    holed = spark.createDataFrame([(edges(star(0, 0, 100, 101, 4, 0.2), star(0, 0, 30, 31, 4, 0.3)[::-1]),)], f"geom {G.EDGES_TYPE}")
    around, within = star(0, 0, 60, 61, 5, 0.1), star(0, 0, 5, 6, 4, 0.0)
    own = spark.createDataFrame([(1, edges(around)), (2, edges(within)), (3, [(-200.0, 0.5, 200.0, 0.25)])], f"id int, geom {G.EDGES_TYPE}")
    got = {r.id: (r.area, r.length) for r in VE.cut_at(own, holed).select("id", G.area("geom").alias("area"), G.length("geom").alias("length")).collect()}
    inner = star(0, 0, 30, 31, 4, 0.3)
    size = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2
    assert abs(got[1][0] - (size(around) - size(inner))) < 1e-6
    assert 2 not in got and 130 < got[3][1] < 145


def test_embeddings_appear_with_their_provenance(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = spark.createDataFrame([("a", 2020, i, 4.0 + i, 45.0) for i in range(5)], "aoi_id string, year int, pixel_id int, lon double, lat double")
    ST.write_embeddings(rows, root, "v1")
    stop = RuntimeError("lost between the two writes")

    def fail(*_):
        raise stop

    monkeypatch.setattr(ST, "_provenance", fail)
    with pytest.raises(RuntimeError):
        ST.write_embeddings(rows.where("pixel_id < 2"), root, "v2")
    monkeypatch.undo()
    assert ST.read_embeddings(spark, root, "a", 2020).count() == 5
    assert [r.dataset_version for r in ST.current_runs(spark, root).collect()] == ["v1"]
    runs = ST.write_embeddings(rows.where("pixel_id < 0"), root, "v3", [("a", 2020), ("b", 2021)]).collect()
    assert sorted((r.aoi_id, r.year, r.n_pixels) for r in runs) == [("a", 2020, 0), ("b", 2021, 0)]
    assert ST.read_embeddings(spark, root, "a", 2020).count() == 0
    ST.write_embeddings(rows, root, "v4")
    assert ST.read_embeddings(spark, root, "a", 2020).count() == 5 and ST.read_embeddings(spark, root, "c", 1).count() == 0
    assert ST.drop_replaced(spark, root) == 1 and ST.read_embeddings(spark, root, "a", 2020).count() == 5


def test_series_meet_no_exchange_by_pixel(spark):
    from terrapulse.operators import breaks as B
    from terrapulse.operators import seasonal as SE
    from terrapulse.operators import trend as T
    from terrapulse.session import bucketed

    rows = [(p, m, f"20{10 + m // 12}-{m % 12 + 1:02d}-01", float((p * m) % 7)) for p in range(30) for m in range(36)]
    monthly = spark.createDataFrame(rows, "pixel_id long, mi int, month string, v double").withColumn("month", F.col("month").cast("date"))
    stored = bucketed(monthly, "pixel_id")
    assert stored.count() == len(rows)
    series = SE.deseasonalize(stored)
    droughts = SE.drought_per_pixel(SE.drought(stored))
    trend = T.trend_table(series)
    for found in (series, trend, B.break_table(series), droughts, trend.join(droughts, "pixel_id").hint("merge")):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(pixel_id" not in plan, plan
    want = {r.pixel_id: r.sen_slope for r in T.trend_table(SE.deseasonalize(monthly)).collect()}
    assert {r.pixel_id: r.sen_slope for r in trend.collect()} == want


def test_distances_by_tiles(spark):
    from terrapulse.operators import raster as R

    rng = random.Random(7)
    for reach, span in ((30, 700), (3, 40)):
        cells = [(c, r) for c in range(70 if reach == 3 else 5) for r in range(-span // 2, span // 2)]
        roads = rng.sample(cells, 12)
        got = R.access_from_cells(spark.createDataFrame(cells, "col long, row long"), spark.createDataFrame(roads, "col long, row long"), 10.0, reach * 10.0)
        for x in got.collect():
            d = min(math.hypot(x.col - c, x.row - r) for c, r in roads) * 10
            assert abs(x.access - max(0.0, 1 - d / (reach * 10.0))) < 1e-12
    none = R.access_from_cells(spark.createDataFrame(cells, "col long, row long"), spark.createDataFrame([], "col long, row long"), 10.0, 300.0)
    assert none.agg(F.max("access")).first()[0] == 0.0


def test_cut_outlines_are_walked_once_by_many_tasks(spark):
    boxes = spark.createDataFrame([(i, float(i)) for i in range(1200)], "id long, x double")
    layer = boxes.select("id", G.box_edges("x", "0D", "x + 0.5D", "2D").alias("geom"))
    area = spark.createDataFrame([(0,)], "n int").select(G.box_edges("10D", "1D", "2000D", "9D").alias("geom"))
    cut = VE.cut_at(layer, area).select("id", G.area("geom").alias("area")).where("area > 0.1")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "REPARTITION_BY_NUM" in plan
    got = {r.id: r.area for r in cut.collect()}
    assert got.keys() == set(range(10, 1200)) and all(abs(a - 0.5) < 1e-9 for a in got.values())
