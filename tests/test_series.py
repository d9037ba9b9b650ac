import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapulse.functions import indices as I
from terrapulse.operators import breaks as B
from terrapulse.operators import composite as C
from terrapulse.operators import quantiles as Q
from terrapulse.operators import seasonal as SE
from terrapulse.operators import trend as T
from terrapulse.operators import zonal as Z
from terrapulse.plans import vegetation as V


def obs(spark, rows):
    return spark.createDataFrame(
        [(p, dt.datetime.fromisoformat(d), v) for p, d, v in rows], "pixel_id long, ts timestamp_ntz, v double"
    )


def series(spark, named, start=(2016, 1)):
    rows = []
    for name, vs in named.items():
        for i, v in enumerate(vs):
            y, m = divmod(start[0] * 12 + start[1] - 1 + i, 12)
            rows.append((name, i, dt.date(y, m + 1, 1), None if v is None else float(v)))
    return spark.createDataFrame(rows, "pixel_id string, mi int, month date, v double")


def collect(df, value="v"):
    return [r[value] for r in df.orderBy("pixel_id", "mi").collect()]


def test_monthly_median_dense_axis(spark):
    rows = [(1, "2020-01-05", 0.2), (1, "2020-01-20", 0.4), (1, "2020-01-25", 0.6), (1, "2020-02-02", 0.5),
            (1, "2020-02-05", 0.7), (1, "2020-03-01", None), (2, "2020-03-10", 0.8)]
    got = C.monthly_median(obs(spark, rows)).orderBy("pixel_id", "mi").collect()
    assert [(r.v and round(r.v, 9), r.valid_count) for r in got] == [
        (0.4, 3), (0.6, 2), (None, 0), (None, 0), (None, 0), (0.8, 1)]


def test_gap_fill(spark):
    fill = lambda vs, g: collect(C.fill_temporal_gaps(series(spark, {"a": vs}), g))
    assert [round(v, 9) for v in fill([0.2, None, 0.6], 1)] == [0.2, 0.4, 0.6]
    assert fill([0.2, None, None, 0.8], 1) == [0.2, None, None, 0.8]
    assert fill([0.2, None, 0.6], 0) == [0.2, None, 0.6]
    assert fill([None, 0.2, None], 3) == [None, 0.2, None]


def test_drought_hand_values(spark):
    two = series(spark, {"a": [0.4] + [0.5] * 11 + [0.6] + [0.5] * 11})
    got = SE.drought(two).orderBy("mi").collect()
    assert [round(got[i].anomaly, 9) for i in (0, 12)] == [-1.0, 1.0]
    assert [got[i].vci for i in (0, 12)] == [0.0, 100.0]
    assert got[1].anomaly is None and got[1].vci is None
    dry = [math.sin(i / 12 * 2 * math.pi) + 0.01 * (i // 12) - (0.12 if i // 12 == 2 else 0) for i in range(48)]
    timeline = SE.drought_timeline(SE.drought(series(spark, {"a": dry})))
    year = timeline.where(F.year("month") == 2018).agg(F.avg("anomaly_mean").alias("m")).first()
    assert year.m < -0.5
    assert SE.driest_month(timeline).first().month.year == 2018


def test_deseasonalize_keeps_slope(spark):
    vs = [0.3 * math.sin(i / 12 * 2 * math.pi) + 0.1 * i / 35 for i in range(36)]
    raw = series(spark, {"a": vs})
    flat = collect(SE.deseasonalize(raw))
    assert np.var(flat) < np.var(vs)
    slope = T.trend_table(SE.deseasonalize(raw)).first().sen_slope
    assert abs(slope - 0.1 / 35) < 5e-4
    assert SE.has_multiple_years(raw) and not SE.has_multiple_years(series(spark, {"a": vs[:12]}))


def brute_trend(vs):
    idx = [i for i, v in enumerate(vs) if v is not None]
    y = [vs[i] for i in idx]
    n = len(y)
    s = sum(np.sign(y[j] - y[i]) for i in range(n) for j in range(i + 1, n))
    slopes = [(y[j] - y[i]) / (idx[j] - idx[i]) for i in range(n) for j in range(i + 1, n)]
    var = n * (n - 1) * (2 * n + 5)
    for v in set(y):
        c = y.count(v)
        var -= c * (c - 1) * (2 * c + 5)
    var /= 18
    z = 0.0 if var <= 0 else (s - np.sign(s)) / math.sqrt(var)
    return float(np.median(slopes)), float(s), math.erfc(abs(z) / math.sqrt(2)), z


def test_mann_kendall_and_sen_brute_force(spark):
    rng = random.Random(7)
    named = {
        "greening": [0.01 * i + rng.gauss(0, 0.02) for i in range(40)],
        "browning": [-0.02 * i + rng.gauss(0, 0.05) for i in range(40)],
        "flat": [rng.gauss(0, 1) for _ in range(40)],
        "ties": [float(i // 3) for i in range(40)],
        "gappy": [None if i % 3 == 0 else 0.02 * i + rng.gauss(0, 0.01) for i in range(40)],
        "constant": [1.0] * 40,
        "short": [1.0, 2.0] + [None] * 38,
    }
    got = {r.pixel_id: r for r in T.trend_table(series(spark, named)).collect()}
    assert got["short"].sen_slope is None and got["short"].trend_class is None
    for name, vs in named.items():
        if name == "short":
            continue
        slope, s, p, z = brute_trend(vs)
        r = got[name]
        assert abs(r.sen_slope - slope) < 1e-9 and r.mk_s == s
        assert abs(r.mk_pvalue - p) < 1e-9 and abs(r.mk_z - z) < 1e-9
    assert [got[n].trend_class for n in ("greening", "browning", "constant")] == [1.0, -1.0, 0.0]


def brute_pettitt(vs):
    y = np.array([np.nan if v is None else v for v in vs])
    sg = np.sign(y[:, None] - y[None, :])
    sg[~np.isfinite(sg)] = 0
    u = np.cumsum(sg.sum(axis=1))
    k = int(np.argmax(np.abs(u)))
    n = int(np.isfinite(y).sum())
    return k, min(1.0, 2 * math.exp(-6 * abs(u[k]) ** 2 / (n**3 + n**2)))


def test_pettitt_brute_force(spark):
    rng = random.Random(3)
    named = {f"r{i}": [None if rng.random() < 0.2 else float(rng.randint(0, 9)) for _ in range(24)] for i in range(12)}
    named["step"] = [0.2 + rng.gauss(0, 0.01) for _ in range(12)] + [0.6 + rng.gauss(0, 0.01) for _ in range(12)]
    named["few"] = [1.0, 2.0, 3.0] + [None] * 21
    got = {r.pixel_id: r for r in B.break_table(series(spark, named)).collect()}
    assert got["few"].break_index is None and got["few"].break_direction == 0.0
    for name, vs in named.items():
        if name != "few":
            k, p = brute_pettitt(vs)
            assert got[name].break_index == k and abs(got[name].break_pvalue - p) < 1e-12
    assert 9 <= got["step"].break_index <= 13 and got["step"].break_direction == 1.0


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_exact_quantile_narrowing_with_a_hot_group(spark, p):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-6), rng.gauss(0, 1e6), 0.0])) for _ in range(4000)]
    rows += [("one", 5.0), ("two", -1.0), ("two", 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.quantiles[0] for r in Q.narrowed_quantiles(df, ["k"], "v", [p]).collect()}
    expected = np.quantile([v for k, v in rows if k == "hot"], p)
    assert math.isclose(got["hot"], expected, rel_tol=1e-12, abs_tol=1e-15)
    assert got["one"] == 5.0 and math.isclose(got["two"], -1 + 2 * p) and "none" not in got
    grouped = {r.k: r.q for r in Q.grouped_quantile(df, ["k"], "v", p, "q").collect()}
    assert math.isclose(grouped["hot"], expected, rel_tol=1e-12, abs_tol=1e-15) and grouped["none"] is None
    low, whole, high = Q.column_quantiles(df, "v", [0.0, p, 1.0]).first().quantiles
    assert low == min(v for _, v in rows if v is not None) and high == max(v for _, v in rows if v is not None)
    assert math.isclose(whole, np.quantile([v for _, v in rows if v is not None], p), rel_tol=1e-12, abs_tol=1e-15)


def test_zone_fixture(spark):
    pixels = spark.createDataFrame(
        [(i, 0.2 if i % 4 < 2 else 0.8, 1.0 if i % 4 < 2 or i < 8 else -1.0) for i in range(16)],
        "pixel_id int, sen_slope double, trend_class double")
    where = spark.createDataFrame([(i, "A" if i % 4 < 2 else "B") for i in range(16)], "pixel_id int, code string")
    zones = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "empty")], "code string, nom string")
    got = {r.code: r for r in Z.zone_statistics(pixels, where, zones, "code").collect()}
    assert abs(got["A"].mean_sen_slope - 0.2) < 1e-12 and abs(got["B"].mean_sen_slope - 0.8) < 1e-12
    assert (got["A"].pct_greening, got["B"].pct_greening) == (100.0, 50.0)
    assert got["C"].mean_sen_slope is None
    stats = spark.createDataFrame(
        [("A", 0.03, -0.2), ("B", -0.01, -1.5), ("C", 0.005, 0.4), ("D", None, None)],
        "code string, mean_sen_slope double, mean_anomaly double")
    assert Z.named_ranking(stats, "top_greening", "code").first().code == "A"
    assert Z.named_ranking(stats, "driest", "code").first().code == "B"
    assert Z.named_ranking(stats, "driest", "code").count() == 3


def test_vegetation_job_single_year_has_no_breaks(spark):
    rows = [(p, f"2020-{m:02d}-03", 0.1 * m + p) for p in (1, 2) for m in range(1, 13)]
    run = V.run(obs(spark, rows))
    assert run.breaks is None and run.trend.where("trend_class = 1").count() == 2
    cube = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), 1200, 5200, 4)], "pixel_id long, ts timestamp_ntz, red int, nir int, scl int")
    assert abs(V.scene_values(cube).first().v - 0.4 / 0.44) < 1e-12
    assert I.VALID_SCENE_CLASSES == (4, 5, 6, 7)


def test_equal_seasonal_differences_tie(spark):
    """Two calendar months with the same difference between the years, told apart by rounding alone."""
    import datetime

    from terrapulse.operators import seasonal, trend

    values = {(2001, 1): 43693.48, (2001, 2): 84020.21, (2002, 1): 20683.47, (2002, 2): 61010.2}
    rows = [(1, datetime.date(y, m, 1), 12 * (y - 2001) + m - 1, v) for (y, m), v in values.items()]
    monthly = spark.createDataFrame(rows, "pixel_id long, month date, mi int, v double")
    series = seasonal.series_for_trend(monthly)
    assert series.select("v").distinct().count() == 2
    assert abs(trend.trend_table(series, min_valid=4).first().mk_s) == 4.0


def test_dense_series_keep_their_partitions(spark):
    """A few packed kilobytes are many dense rows: they are not put together in one task."""
    obs = spark.createDataFrame([(p, f"20{y}-01-01", 1.0) for p in range(200) for y in (10, 24)], "pixel_id long, ts string, v double")
    dense = C.monthly_median(obs.withColumn("ts", F.to_timestamp("ts")))
    assert dense.count() == 200 * 169
    rows = dense.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) == 4 and max(r["count"] for r in rows) < 200 * 169 / 2


def test_vegetation_job_ties_equal_seasonal_differences(spark):
    """The job's own series states the same rule as the trend queries."""
    values = {(2001, 1): 43693.48, (2001, 2): 84020.21, (2002, 1): 20683.47, (2002, 2): 61010.2}
    rows = [(1, dt.datetime(y, m, 5), v) for (y, m), v in values.items()]
    cube = spark.createDataFrame(rows, "pixel_id long, ts timestamp_ntz, v double")
    found = V.run(cube, min_valid=4).trend.first()
    # Two pairs of ties: the variance is (4 * 3 * 13 - 2 * 18) / 18.
    assert found.mk_s == -4.0 and abs(found.mk_z + 3 / (120 / 18) ** 0.5) < 1e-12
