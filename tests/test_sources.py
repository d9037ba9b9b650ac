import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapulse.operators import activity as A
from terrapulse.operators import change as CH
from terrapulse.plans import areas as AR
from terrapulse.sources import establishments as ES
from terrapulse.sources import fibre as FI
from terrapulse.sources import layers as L
from terrapulse.sources import scenes as SC
from terrapulse.sources import store as ST
from terrapulse.sources import suppliers as SU
from terrapulse.sources import vectors as VE


def dump(path, data):
    path.write_text(json.dumps(data), encoding="utf-8")
    return str(path)


def ring3d(x, y):
    return [[[x, y, 9.0], [x + 1, y, 9.0], [x + 1, y + 1, 9.0], [x, y + 1, 9.0], [x, y, 9.0]]]


def test_geojson_drops_z_and_clips(spark, tmp_path):
    feats = [
        {"geometry": {"type": "Polygon", "coordinates": ring3d(0.0, 0.0)}, "properties": {"cleabs": "in", "nature": "Bois"}},
        {"geometry": {"type": "MultiPolygon", "coordinates": [ring3d(2.0, 0.0), ring3d(4.0, 0.0)]}, "properties": {"cleabs": "multi"}},
        {"geometry": {"type": "Polygon", "coordinates": ring3d(90.0, 90.0)}, "properties": {"cleabs": "out"}},
    ]
    path = dump(tmp_path / "a.geojson", {"type": "FeatureCollection", "features": feats})
    rows = {r.cleabs: r for r in VE.read_geojson(spark, path, ["cleabs", "nature"], (-1, -1, 10, 10)).collect()}
    assert set(rows) == {"in", "multi"} and len(rows["in"].geom) == 4 and len(rows["multi"].geom) == 8
    assert set(rows["in"].geom[0].asDict()) == {"x1", "y1", "x2", "y2"} and rows["multi"].nature is None


def test_osm_scenes_woods(spark, tmp_path):
    path = dump(tmp_path / "osm.json", {"elements": [
        {"id": 1, "geometry": [{"lat": 44.0, "lon": 4.0}, {"lat": 44.1, "lon": 4.1}]},
        {"id": 2, "geometry": [{"lat": 44.0, "lon": 4.0}]}]})
    ways = VE.read_osm_ways(spark, path).collect()
    assert [w.osm_id for w in ways] == [1] and (ways[0].geom[0].x1, ways[0].geom[0].y2) == (4.0, 44.1)
    item = {"id": "S2B_31TFJ_20200705", "bbox": [4, 44, 5, 45], "properties": {
        "datetime": "2020-07-05T10:26:00Z", "eo:cloud_cover": 3.2, "s2:mgrs_tile": "31TFJ"}}
    other = {"id": "x", "bbox": [4, 44, 5, 45], "properties": {"datetime": "2020-07-05T10:26:00Z", "grid:code": "G"}}
    rows = SC.read_items(spark, dump(tmp_path / "items.json", {"params": {}, "items": [item, other]})).collect()
    assert tuple(rows[0])[:4] == ("S2B_31TFJ_20200705", "2020-07-05T10:26:00Z", 3.2, "31TFJ") and rows[1].tile == "G"
    feats = [{"geometry": {"type": "Polygon", "coordinates": ring3d(0.0, 0.0)}, "properties": p}
             for p in ({"typepsc": "01", "gid": "7"}, {"typepsc": "01"}, {"typepsc": "02", "gid": "8"})]
    woods = VE.read_protected_woods(spark, dump(tmp_path / "w.json", {"features": feats})).collect()
    assert len(woods) == 2 and woods[0].id_ebc == "7" and woods[1].id_ebc.startswith("EBC")


def test_points_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Lon;LAT;v\n3.0;46.5;a\n", encoding="utf-8")
    row = VE.read_points_csv(spark, str(tmp_path / "p.csv"), ["x", "lon"], ["lat"]).first()
    assert abs(row.px - 700000) < 1e-3 and abs(row.py - 6600000) < 1e-3
    with pytest.raises(ValueError):
        VE.read_points_csv(spark, str(tmp_path / "p.csv"), ["x"], ["lat"])


def test_establishments(spark, tmp_path):
    (tmp_path / "e.csv").write_text(
        "siret,latitude,longitude,etatAdministratifEtablissement,codeCommuneEtablissement\n"
        "1,45.0,5.0,A,01053\n1,45.0,5.0,A,01053\n2,bad,5.0,A,01053\n3,45.0,5.0,F,01053\n4,45.0,5.0,A,07005\n")
    got = ES.read_geofile(spark, str(tmp_path / "e.csv"), commune="01053").collect()
    assert [(r.siret, r.latitude) for r in got] == [("1", 45.0)]
    with pytest.raises(ValueError):
        ES.normalize_geofile(spark.createDataFrame([("1",)], "siret string"))
    wkt = spark.createDataFrame([("1", "POINT(4.85 45.75)", "68.20A"), ("2", "", "x"), ("1", "POINT(4.85 45.75)", "68.20A")], "siret string, the_geom string, activitenaf string")
    assert [(r.siret, r.latitude, r.longitude) for r in ES.normalize_wkt_points(wkt).collect()] == [("1", 45.75, 4.85)]
    schema = ("page int, results array<struct<nom_complet:string, nom_raison_sociale:string, matching_etablissements:"
              "array<struct<siret:string, etat_administratif:string, latitude:string, longitude:string, activite_principale:string>>>>")
    pages = spark.createDataFrame([
        (1, [("Co", None, [("a", "A", "45", "5", "n"), ("b", "F", "45", "5", "n"), ("c", "A", "", "5", "n"), (None, "A", "1", "2", "n")])]),
        (2, [(None, "Rs", [("a", "A", "46", "6", "n"), ("d", "A", "46", "6", "n")]), ("No", None, None)])], schema)
    rows = sorted((r.siret, r.denomination, r.latitude) for r in ES.establishments_from_pages(pages).collect())
    assert rows == [("a", "Co", 45.0), ("d", "Rs", 46.0)]
    codes = spark.createDataFrame([("68.20A",), ("01.11Z",), ("34.00Z",)], "code string")
    assert {r.section: r.codes for r in ES.codes_by_section(codes, "code").collect()} == {"L": ["68.20A"], "A": ["01.11Z"]}


def test_fibre_and_layers(spark):
    imb = spark.createDataFrame([("i1", "07005", "520000", "5545000", "3"), ("i2", "07005", "520010", "5545000", "x"), ("i3", "26000", "1", "1", "1")],
                                "imb_id string, imb_code_insee string, imb_x string, imb_y string, imb_nbr_logloc string")
    elig = spark.createDataFrame([("i1", "FO", "B", 2), ("i1", "FO", "A", 1), ("i2", "CU", "A", 3)], "imb_id string, code_techno string, code_operateur string, line int")
    got = {r.id_locale: (r.statut_deploiement, r.operateur, r.nb_logements) for r in FI.fibre_layer(imb, elig, "07005", "line").collect()}
    assert got == {"i1": ("Déployé", "A", 3.0), "i2": ("Non desservi", "", None)}
    posts = spark.createDataFrame([("P1", "63,5", 1.0, 2.0)], "Nom string, `Capacite dispo kVA` string, px double, py double")
    row = L.normalize_layer(posts, L.CONTRACTS["energie"], "07").first()
    assert (row.id_poste_source, row.puissance_max_kva, row.puissance_disponible_kva, row.dept, row.px) == ("P1", 0.0, None, "07", 1.0)
    out = L.adapt_all({"pv": spark.createDataFrame([("z",)], "code string"), "parcelles": spark.createDataFrame([("070050000A0001",)], "idu string")}, "07", "Commune")
    assert out["pv"].first().id_pv == "z" and out["parcelles"].first().commune_insee == "07005"


def test_suppliers(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('Supplier ID,Lat,Lon,Commodity\nA,"4,5",1.0,Cocoa\n ,5.5,2.0,\n')
    rows = SU.read_suppliers(spark, str(path)).orderBy("source_row").collect()
    assert [(r.supplier_id, r.latitude, r.source_commodity) for r in rows] == [("A", 4.5, "Cocoa"), ("SUP-000002", 5.5, None)]
    path2 = tmp_path / "bad.csv"
    path2.write_text("lat,lon\n1.0,2.0\nx,3.0\n")
    with pytest.raises(ValueError, match="invalid latitude on row 2"):
        SU.read_suppliers(spark, str(path2))
    empty = tmp_path / "none.csv"
    empty.write_text("lat,lon\n")
    with pytest.raises(ValueError):
        SU.read_suppliers(spark, str(empty))


def test_replace_partition(spark):
    spark.sql("DROP TABLE IF EXISTS vegetation_zone_stats")
    ST.apply_schema(spark)
    ST.apply_schema(spark)
    rows = lambda n: spark.createDataFrame([(f"{i}", 0.1 * i) for i in range(n)], "insee string, mean_sen_slope double")
    keys = {"y0": 2018, "y1": 2025}
    count = lambda a: spark.table("vegetation_zone_stats").where(F.col("aoi_id") == a).count()
    assert ST.replace_partition(rows(3), "vegetation_zone_stats", "a", keys) == 3
    assert ST.replace_partition(rows(1), "vegetation_zone_stats", "b", keys) == 1
    assert ST.replace_partition(rows(2), "vegetation_zone_stats", "a", keys) == 2
    assert (count("a"), count("b")) == (2, 1)
    assert ST.replace_partition(rows(1), "vegetation_zone_stats", "a", {"y0": 2010, "y1": 2017}) == 1 and count("a") == 3
    assert ST.replace_partition(rows(0), "vegetation_zone_stats", "a", keys) == 0 and count("a") == 1
    assert ST.replace_partition(rows(0), "vegetation_zone_stats", "a") == 0 and (count("a"), count("b")) == (0, 1)
    with pytest.raises(ValueError):
        ST.replace_partition(rows(1), "vegetation_zone_stats", "a", {"nom": "x"})


def test_stage_products_embeddings(spark, tmp_path):
    one, two = spark.range(1), spark.range(2)
    path = str(tmp_path / "stage")
    assert ST.stage(one, path).count() == 1 and ST.stage(two, path).count() == 1 and ST.stage(two, path, force=True).count() == 2
    folder = ST.write_product(two, str(tmp_path), "vege", "insee-07005", "trend", "2018_2025")
    assert folder.endswith("pillar=vege/aoi=insee-07005/product=trend/window=2018_2025")
    emb = spark.createDataFrame([("a", 2020, 1, 4.0, 44.0), ("a", 2020, 2, 5.0, 45.0), ("a", 2021, 1, 4.0, 44.0)], "aoi_id string, year int, pixel_id int, lon double, lat double")
    info = {r.year: (r.n_pixels, list(r.bbox_wgs84)) for r in ST.write_embeddings(emb, str(tmp_path), "v1").collect()}
    assert info[2020] == (2, [4.0, 44.0, 5.0, 45.0])
    assert ST.read_embeddings(spark, str(tmp_path), "a", 2020).count() == 2
    ST.write_attributes(emb.withColumn("geom", F.lit(None).cast("binary")), "attributes_only")
    assert "geom" not in spark.table("attributes_only").columns


def test_embedding_change(spark):
    same = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "pixel_id long, embedding array<float>")
    flipped = spark.createDataFrame([(1, [-1.0, 0.0]), (2, [2.0, 2.0]), (3, [1.0, 1.0])], "pixel_id long, embedding array<float>")
    got = {r.pixel_id: round(r.change_distance, 6) for r in CH.aligned_distance(same, flipped).collect()}
    assert got == {1: 2.0, 2: 0.0}
    d = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (0.3,), (0.9,)], "d double")
    rows = CH.flag_by_percentile(d, "d", 80.0).collect()
    assert [r.d for r in rows if r.changed] == [0.9] and abs(rows[0].threshold - 0.42) < 1e-9
    assert CH.flag_by_percentile(d.where("d > 5"), "d").count() == 0
    assert CH.change_summary(CH.flag_by_percentile(d.where("d > 5"), "d")).first().threshold == 0.0


def test_forest(spark):
    rows = [(i, [float((i * 7 + j) % 11) / 11 + (3.0 if j == 0 and i % 2 else 0.0) for j in range(8)], "b" if i % 2 else "a") for i in range(80)]
    df = spark.createDataFrame(rows, "pixel_id long, embedding array<double>, label string")
    trained = CH.train_forest(df, trees=10, folds=3)
    assert trained.cv_accuracy > 0.9 and trained.class_names == ["a", "b"] and trained.n_samples == 80
    out = CH.classify_pixels(trained, df)
    assert out.where("confidence < 0 or confidence > 1").count() == 0
    assert out.where("predicted_class = label").count() > 72
    assert CH.train_forest(df.limit(3), trees=2).cv_accuracy is None


def test_forest_of_many_nodes(spark):
    """Labels that nothing tells: trees grow to the last row, which took Spark's trainer minutes for 2000 rows."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).tolist(), str(int(rng.integers(10)))) for i in range(2000)]
    df = spark.createDataFrame(rows, "pixel_id long, embedding array<double>, label string")
    start = time.monotonic()
    trained = CH.train_forest(df, folds=0)
    out = CH.classify_pixels(trained, df)
    assert out.where("predicted_class = label and confidence between 0 and 1").count() > 1980
    assert time.monotonic() - start < 90 and trained.model.getNumTrees == 100


def test_trees():
    from terrapulse.operators import trees as T

    x = np.array([[0.0, 5.0], [1.0, 5.0], [2.0, 5.0], [3.0, 5.0]])
    column, at = T.best_split(x, np.array([0, 0, 1, 1]), np.ones(4), 2)
    assert (column, at) == (0, 1.5)
    assert T.best_split(x[:, 1:], np.array([0, 0, 1, 1]), np.ones(4), 2) is None
    y = (np.arange(300) // 7) % 3
    values = np.stack([np.arange(300) * 1.0, np.arange(300) % 11 * 1.0], 1)
    forest = [T.grow(values, y, 3, 30, [1, t]) for t in range(30)]
    assert (T.shares(forest, values).argmax(axis=1) == y).mean() > 0.98
    assert len(T.grow(values, y, 3, 1, [1, 1])[0]) == 3


def test_forest_of_more_rows_than_a_task_holds(spark, monkeypatch):
    """Upper nodes are split by counts over all rows, what is below them by tasks; neither rows nor trees reach the driver."""
    from terrapulse.operators import trees as T

    rng = np.random.default_rng(3)
    values = rng.normal(size=(3000, 6)).round(3)
    rows = [(i, v.tolist(), f"{int(v[0] > 0.2) + 2 * int(v[3] > -0.1)}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "pixel_id long, embedding array<double>, label string").repartition(3)
    monkeypatch.setattr(T, "LOCAL_ROWS", 100)
    for most in (6000, 1 << 23):
        monkeypatch.setattr(T, "TASK_VALUES", most)
        trained = CH.train_forest(df.where("pixel_id % 3 > 0"), trees=10, folds=0)
        model = trained.model
        assert model.getNumTrees == 10 and model.parts.select("tree").distinct().count() == 10
        assert (min(len(u[0]) for u in model.uppers) > 1) == (most == 6000)
        out = CH.classify_pixels(trained, df)
        assert out.columns == [*df.columns, "predicted_class", "confidence"] and out.count() == 3000
        assert out.where("predicted_class = label and confidence between 0.25 and 1 and pixel_id % 3 = 0").count() > 950
    assert CH.train_forest(df, trees=5, folds=2).cv_accuracy > 0.95


def test_levels_are_split_as_single_nodes():
    from terrapulse.operators import trees as T

    rng = np.random.default_rng(8)
    x, y, w = rng.normal(size=(300, 4)).round(1), rng.integers(0, 3, 300), rng.integers(1, 4, 300).astype("f8")
    node = rng.integers(0, 5, 300)
    totals = np.bincount(node * 3 + y, w, 15).reshape(5, 3)
    columns, at = T.best_splits(x, T.ranks(x), y, w, np.arange(300), node, np.tile(np.arange(4), (5, 1)), totals)
    for n in range(5):
        rows = node == n
        assert T.best_split(x[rows], y[rows], w[rows], 3) == (columns[n], at[n])


def test_activity(spark):
    ev = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-02",), ("2024-01-16",)], "d string").select(F.to_timestamp("d").alias("ts"))
    weeks = A.weekly_series(ev, "ts", 4, F.to_date(F.lit("2024-01-24"))).orderBy("week").collect()
    assert [r.n for r in weeks] == [3, 0, 1, 0]
    days = A.weekday_histogram(ev, "ts").orderBy("weekday").collect()
    assert [r.n for r in days] == [1, 3, 0, 0, 0, 0, 0] and [r.weekday for r in days if r.is_peak] == [1]


def test_area_registry(spark):
    from terrapulse.functions import geometry as G

    areas = spark.createDataFrame([("bbox", "x", 4.0, 44.0, 5.0, 45.0)], "kind string, name string, a double, b double, c double, d double")
    row = AR.register(areas.withColumn("geom", G.box_edges("a", "b", "c", "d"))).first()
    assert row.aoi_id == "bbox-4.0000_44.0000_5.0000_45.0000" and row.bbox_wgs84 == [4.0, 44.0, 5.0, 45.0]
    squares = spark.createDataFrame([("07001", 4.0), ("07002", 5.0), ("07003", 6.0)], "code string, x double")
    communes = squares.withColumn("geom", G.box_edges("x", "44D", "x + 1", "45D"))
    assert sorted(r.code for r in AR.build_area(communes, (4.2, 44.2, 5.5, 44.8)).collect()) == ["07001", "07002"]
    near = AR.communes_in_area({"07": communes.withColumn("nom", F.lit("n"))}, communes.where("code = '07001'"), 1.0)
    assert sorted(r.code for r in near.collect()) == ["07001", "07002"]
