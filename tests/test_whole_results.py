import random

import pytest
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.operators.change import stratified_fold
from terrapulse.operators.ranks import percentile_of_score
from terrapulse.operators.zonal import rank_zones_within
from terrapulse.session import checkpoint_root
from terrapulse.sources import store as ST
from terrapulse.sources.layers import stack_layers


def test_percentile_rank_of_any_values(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), 0.0, -1e-9, 5.0]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "score double").repartition(4)
    got = sorted((r.score, round(r.percentile_score, 9)) for r in percentile_of_score(df, "score").collect())
    want = sorted((v, round(100 * sum(o < v for o in values) / (len(values) - 1), 9)) for v in values)
    assert got == want


def test_folds_are_stratified(spark):
    df = spark.range(3001).select("id", (F.col("id") % 7 == 0).cast("int").alias("label")).repartition(5)
    got = {}
    for row in stratified_fold(df, "label", "id", 5).groupBy("label", "_fold").count().collect():
        got.setdefault(row.label, []).append(row["count"])
    assert sum(map(sum, got.values())) == 3001
    assert all(len(n) == 5 and max(n) - min(n) <= 1 for n in got.values())


def test_rank_within_a_year(spark):
    df = spark.createDataFrame([(2000, z, float(z % 3)) for z in range(6)] + [(2001, 1, None), (2001, 2, -1.0)], "year int, zone int, m double")
    got = rank_zones_within(df, "year", "m", "zone", ascending=True, limit=2).collect()
    assert sorted((r.year, r.rank, r.zone) for r in got) == [(2000, 1, 0), (2000, 2, 3), (2001, 1, 2)]


def test_outlines_fit_the_schema(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS review LOCATION '{tmp_path}/db'")
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase("review")
    try:
        ST.apply_schema(spark)
        area = spark.range(1).select(F.lit("x").alias("label"), F.lit("insee").alias("kind"), G.line_edges("0D", "0D", "5D", "5D").alias("geom"))
        assert ST.replace_partition(area, "aoi", "a1") == 1
        assert ST.replace_partition(area.limit(0), "aoi", "a1") == 0
        assert spark.table("aoi").count() == 0
    finally:
        spark.catalog.setCurrentDatabase(before)


def test_embeddings_replace_clear_and_record(spark, tmp_path):
    rows = spark.range(6).select("id", (F.col("id") * 1.0).alias("lon"), F.lit(1.0).alias("lat"), F.lit("a").alias("aoi_id"), (2000 + F.col("id") % 2).cast("int").alias("year"))
    runs = ST.write_embeddings(rows, str(tmp_path), "v1").collect()
    assert sorted((r.year, r.n_pixels) for r in runs) == [(2000, 3), (2001, 3)]
    ST.write_embeddings(rows.where("year = 2000 and id < 3"), str(tmp_path), "v2").collect()
    assert spark.read.parquet(f"{tmp_path}/embedding_runs").count() == 3
    assert ST.read_embeddings(spark, str(tmp_path), "a", 2000).count() == 2
    ST.clear_embeddings(spark, str(tmp_path), "a", 2000)
    assert ST.read_embeddings(spark, str(tmp_path), "a", 2000).count() == 0
    assert ST.read_embeddings(spark, str(tmp_path), "a", 2001).count() == 3


def test_no_layer_is_an_empty_layer(spark):
    assert stack_layers({}, ["code", "nom"]).columns == ["kind", "code", "nom"]
    assert stack_layers({}, ["code"]).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://somewhere"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_root(Session())
