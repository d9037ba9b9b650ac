"""Vegetation series: composites, season, trend, breaks, zones, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import indices as I
from terrapulse.operators import breaks as B
from terrapulse.operators import composite as C
from terrapulse.operators import seasonal as SE
from terrapulse.operators import trend as T
from terrapulse.operators import zonal as Z
from terrapulse.plans import vegetation as V
from workload import standins as D
from workload.registry import query, r
from workload.standins import with_

Z_CRIT = "1.959963984540054"  # two-sided normal quantile at alpha = 0.05


def monthly(spark, sf):
    return C.monthly_median(D.observations(spark, sf))


def sparse(spark, sf):
    return C.monthly_median(D.observations(spark, sf, "l_partkey"))


MK = {
    "ser": "SELECT pixel_id, mi, v FROM deseason WHERE v IS NOT NULL",
    "pairs": """SELECT a.pixel_id, sum(sign(b.v - a.v)) AS s,
        median((b.v - a.v) / (b.mi - a.mi)) AS slope
        FROM ser a JOIN ser b ON a.pixel_id = b.pixel_id AND a.mi < b.mi GROUP BY 1""",
    "ties": """SELECT pixel_id, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS t FROM (
        SELECT pixel_id, v, count(*) AS c FROM ser GROUP BY 1, 2) GROUP BY 1""",
    "mk": """SELECT t.pixel_id, n, s, slope, (n * (n - 1) * (2 * n + 5) - t) / 18.0 AS var
        FROM ties t LEFT JOIN pairs p ON p.pixel_id = t.pixel_id""",
    "mkz": """SELECT pixel_id, n, s, slope,
        CASE WHEN var <= 0 THEN 0 ELSE (s - sign(s)) / sqrt(var) END AS z FROM mk""",
    "trend": f"""SELECT pixel_id, s, slope, z,
        CASE WHEN abs(z) > {Z_CRIT} THEN sign(z) ELSE 0 END::DOUBLE AS cls FROM mkz WHERE n >= 6""",
}
PETTITT = {
    "rk": """SELECT pixel_id, mi, v, count(v) OVER (PARTITION BY pixel_id) AS n,
        rank() OVER (PARTITION BY pixel_id, v IS NULL ORDER BY v) - 1 AS less,
        count(*) OVER (PARTITION BY pixel_id, v IS NULL, v) AS eq FROM deseason""",
    "us": """SELECT pixel_id, mi, v, n, sum(CASE WHEN v IS NULL THEN 0 ELSE 2 * less + eq - n END)
        OVER (PARTITION BY pixel_id ORDER BY mi ROWS UNBOUNDED PRECEDING) AS u FROM rk""",
    "best": """SELECT pixel_id, mi AS k, abs(u)::DOUBLE AS big FROM us
        QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY abs(u) DESC, mi) = 1""",
    "brk": """SELECT u.pixel_id, any_value(b.k) AS k, any_value(b.big) AS big,
        any_value(u.n)::DOUBLE AS n, avg(CASE WHEN mi <= k THEN v END) AS va,
        avg(CASE WHEN mi > k THEN v END) AS vb FROM us u JOIN best b ON b.pixel_id = u.pixel_id
        GROUP BY 1""",
    "breaks": """SELECT pixel_id, CASE WHEN n >= 6 THEN k END AS k,
        CASE WHEN n >= 6 THEN least(1, 2 * exp(-6 * big * big / (n * n * n + n * n))) END AS p,
        CASE WHEN n >= 6 THEN coalesce(sign(vb - va), 0) ELSE 0 END::DOUBLE AS dir FROM brk""",
}


@query(
    "ag01_monthly_median",
    with_("monthly") + "SELECT pixel_id, month, v, valid_count FROM monthly",
)
def monthly_median(spark, sf):
    return monthly(spark, sf).select("pixel_id", "month", "v", "valid_count")


@query(
    "ag02_valid_count",
    with_("monthly") + "SELECT pixel_id, month, valid_count FROM monthly",
)
def valid_count(spark, sf):
    return C.valid_count_per_month(D.observations(spark, sf)).select(
        "pixel_id", "month", "valid_count"
    )


@query(
    "wn01_fill_short_gaps",
    with_(
        "sparse",
        b="""SELECT pixel_id, month, mi, v,
        last_value(CASE WHEN v IS NOT NULL THEN mi END IGNORE NULLS) OVER p AS i0,
        last_value(v IGNORE NULLS) OVER p AS y0,
        first_value(CASE WHEN v IS NOT NULL THEN mi END IGNORE NULLS) OVER f AS i1,
        first_value(v IGNORE NULLS) OVER f AS y1 FROM sparse WINDOW
        p AS (PARTITION BY pixel_id ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY pixel_id ORDER BY mi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    )
    + """SELECT pixel_id, month, round(CASE WHEN v IS NOT NULL THEN v WHEN i1 - i0 <= 3
        THEN y0 + (y1 - y0) * (mi - i0) / nullif(i1 - i0, 0) END, 6) AS v FROM b""",
)
def fill_short_gaps(spark, sf):
    filled = C.fill_temporal_gaps(sparse(spark, sf), 2)
    return filled.select("pixel_id", "month", r("v").alias("v"))


@query(
    "wn02_build_monthly",
    with_("monthly") + "SELECT pixel_id, month, v, valid_count FROM monthly",
)
def build_monthly(spark, sf):
    built = C.build_monthly(D.observations(spark, sf), fill_max_gap=0)
    return built.select("pixel_id", "month", "v", "valid_count")


@query(
    "wn03_deseasonalize",
    with_("deseason") + "SELECT pixel_id, month, round(v, 6) AS v FROM deseason",
)
def deseasonalize(spark, sf):
    return SE.deseasonalize(monthly(spark, sf)).select("pixel_id", "month", r("v").alias("v"))


@query(
    "wn04_series_for_trend",
    with_("deseason") + "SELECT pixel_id, month, round(v, 6) AS v FROM deseason",
)
def series_for_trend(spark, sf):
    return SE.series_for_trend(monthly(spark, sf), obs=D.observations(spark, sf)).select("pixel_id", "month", r("v").alias("v"))


@query(
    "ag03_climatology",
    with_("monthly")
    + """SELECT pixel_id, month(month)::INTEGER AS moy, round(avg(v), 6) AS clim_mean,
        round(stddev_pop(v), 6) AS clim_std, min(v) AS clim_min, max(v) AS clim_max
        FROM monthly GROUP BY 1, 2""",
)
def climatology(spark, sf):
    return SE.monthly_climatology(monthly(spark, sf)).select(
        "pixel_id", "moy", r("clim_mean").alias("clim_mean"), r("clim_std").alias("clim_std"),
        "clim_min", "clim_max",
    )


@query(
    "wn05_anomaly",
    with_("drought") + "SELECT pixel_id, month, round(anomaly, 6) AS anomaly FROM drought",
)
def anomaly(spark, sf):
    return SE.drought(monthly(spark, sf)).select("pixel_id", "month", r("anomaly").alias("anomaly"))


@query(
    "wn06_vci",
    with_("drought") + "SELECT pixel_id, month, round(vci, 6) AS vci FROM drought",
)
def vci(spark, sf):
    return SE.drought(monthly(spark, sf)).select("pixel_id", "month", r("vci").alias("vci"))


@query(
    "wn07_drought_table",
    with_("drought")
    + "SELECT pixel_id, month, round(anomaly, 6) AS anomaly, round(vci, 6) AS vci FROM drought",
)
def drought_table(spark, sf):
    return SE.drought(monthly(spark, sf)).select(
        "pixel_id", "month", r("anomaly").alias("anomaly"), r("vci").alias("vci")
    )


@query(
    "jn15_climatology_each_step",
    with_(
        "monthly",
        clim="SELECT pixel_id, month(month) AS moy, avg(v) AS m FROM monthly GROUP BY 1, 2",
    )
    + """SELECT x.pixel_id, x.month, round(c.m, 6) AS clim_mean FROM monthly x
        JOIN clim c ON c.pixel_id = x.pixel_id AND c.moy = month(x.month)""",
)
def climatology_each_step(spark, sf):
    steps = monthly(spark, sf).withColumn("moy", F.month("month"))
    clim = SE.monthly_climatology(monthly(spark, sf))
    return steps.join(clim, ["pixel_id", "moy"]).select(
        "pixel_id", "month", r("clim_mean").alias("clim_mean")
    )


@query(
    "ag04_drought_per_pixel",
    with_("drought")
    + """SELECT pixel_id, round(avg(anomaly), 6) + 0::DOUBLE AS mean_anomaly, round(min(vci), 6) AS min_vci
        FROM drought GROUP BY 1""",
)
def drought_per_pixel(spark, sf):
    per_pixel = SE.drought_per_pixel(SE.drought(monthly(spark, sf)))
    return per_pixel.select(
        "pixel_id", r("mean_anomaly").alias("mean_anomaly"), r("min_vci").alias("min_vci")
    )


TIMELINE = "SELECT month, avg(anomaly) AS anomaly_mean FROM drought GROUP BY 1"


@query(
    "ag05_drought_timeline",
    with_("drought", t=TIMELINE) + "SELECT month, round(anomaly_mean, 6) AS anomaly_mean FROM t",
)
def drought_timeline(spark, sf):
    timeline = SE.drought_timeline(SE.drought(monthly(spark, sf)))
    return timeline.select("month", r("anomaly_mean").alias("anomaly_mean"))


@query(
    "tk04_driest_month",
    with_("drought", t=TIMELINE)
    + """SELECT month, round(anomaly_mean, 6) AS anomaly_mean FROM t
        WHERE anomaly_mean IS NOT NULL ORDER BY anomaly_mean, month LIMIT 1""",
)
def driest_month(spark, sf):
    found = SE.driest_month(SE.drought_timeline(SE.drought(monthly(spark, sf))))
    return found.select("month", r("anomaly_mean").alias("anomaly_mean"))


def deseasoned_trend(spark, sf):
    return T.trend_table(SE.series_for_trend(monthly(spark, sf)))


@query(
    "ag10_mann_kendall",
    with_("deseason", **MK)
    + "SELECT pixel_id, s::DOUBLE AS mk_s, round(z, 6) AS mk_z FROM trend",
)
def mann_kendall(spark, sf):
    return deseasoned_trend(spark, sf).select("pixel_id", "mk_s", r("mk_z").alias("mk_z"))


@query(
    "ag11_theil_sen",
    with_("deseason", **MK) + "SELECT pixel_id, round(slope, 6) AS sen_slope FROM trend",
)
def theil_sen(spark, sf):
    return deseasoned_trend(spark, sf).select("pixel_id", r("sen_slope").alias("sen_slope"))


@query(
    "ag12_trend_class",
    with_("deseason", **MK) + "SELECT pixel_id, cls AS trend_class FROM trend",
)
def trend_class(spark, sf):
    return deseasoned_trend(spark, sf).select("pixel_id", "trend_class")


SPARSE_MK = {**MK, "ser": "SELECT pixel_id, mi, v FROM sparse WHERE v IS NOT NULL"}


@query(
    "ag13_trend_table",
    with_("sparse", **SPARSE_MK)
    + """SELECT p.pixel_id, s::DOUBLE AS mk_s, round(slope, 6) AS sen_slope, round(z, 6) AS mk_z,
        cls AS trend_class FROM (SELECT DISTINCT pixel_id FROM sparse) p
        LEFT JOIN trend t ON t.pixel_id = p.pixel_id""",
)
def trend_table(spark, sf):
    return T.trend_table(sparse(spark, sf)).select(
        "pixel_id", "mk_s", r("sen_slope").alias("sen_slope"), r("mk_z").alias("mk_z"), "trend_class"
    )


@query(
    "ag14_pettitt",
    with_("deseason", **PETTITT)
    + """SELECT pixel_id, k::INTEGER AS break_index, round(p, 6) AS break_pvalue,
        dir AS break_direction FROM breaks""",
)
def pettitt(spark, sf):
    found = B.break_table(SE.series_for_trend(monthly(spark, sf)), 6)
    return found.select(
        "pixel_id", "break_index", r("break_pvalue").alias("break_pvalue"), "break_direction"
    )


SPARSE_PETTITT = {k: q.replace("deseason", "sparse") for k, q in PETTITT.items()}


@query(
    "ag15_break_table",
    with_("sparse", **SPARSE_PETTITT)
    + """SELECT pixel_id, k::INTEGER AS break_index, round(p, 6) AS break_pvalue,
        dir AS break_direction FROM breaks""",
)
def break_table(spark, sf):
    return B.break_table(sparse(spark, sf), 6).select(
        "pixel_id", "break_index", r("break_pvalue").alias("break_pvalue"), "break_direction"
    )


@query(
    "fn31_break_year",
    with_("deseason", **PETTITT)
    + """SELECT b.pixel_id, CASE WHEN b.p < 0.2 THEN year(a.month) END::INTEGER AS break_year
        FROM breaks b LEFT JOIN axis a ON a.mi = b.k""",
)
def break_year(spark, sf):
    obs = D.observations(spark, sf)
    found = B.break_table(SE.series_for_trend(C.monthly_median(obs)), 6)
    return B.break_year(found, C.month_axis(obs), alpha=0.2).select("pixel_id", "break_year")


ZONED = "SELECT z.zone, z.nom, {} FROM zones z LEFT JOIN (SELECT k.zone, {} FROM {} x JOIN pixel_zone k ON k.pixel_id = x.pixel_id GROUP BY 1) s ON s.zone = z.zone"


@query(
    "ag06_zonal_reduce",
    with_(
        "drought", "pixel_zone", "zones",
        px="SELECT pixel_id, avg(anomaly) AS a FROM drought GROUP BY 1",
    )
    + ZONED.format("round(s.m, 6) + 0::DOUBLE AS mean_anomaly", "avg(x.a) AS m", "px"),
)
def zonal_reduce(spark, sf):
    pixels = SE.drought_per_pixel(SE.drought(monthly(spark, sf)))
    out = Z.zonal_reduce(
        pixels, D.pixel_zones(spark, sf), D.zones(spark, sf), "zone", "mean_anomaly", "mean"
    )
    return out.select("zone", "nom", r("mean_anomaly").alias("mean_anomaly"))


@query(
    "ag07_zonal_class_fraction",
    with_("deseason", "pixel_zone", "zones", **MK)
    + ZONED.format(
        "round(s.g, 6) AS pct_greening",
        "100.0 * count(*) FILTER (WHERE x.cls = 1) / nullif(count(x.cls), 0) AS g",
        "trend",
    ),
)
def zonal_class_fraction(spark, sf):
    out = Z.zonal(
        deseasoned_trend(spark, sf), D.pixel_zones(spark, sf), D.zones(spark, sf), "zone",
        pct_greening=Z.class_fraction(F.col("trend_class"), 1),
    )
    return out.select("zone", "nom", r("pct_greening").alias("pct_greening"))


def zone_table(spark, sf):
    monthly_rows = monthly(spark, sf)
    pixels = T.trend_table(SE.series_for_trend(monthly_rows)).join(
        SE.drought_per_pixel(SE.drought(monthly_rows)), "pixel_id"
    )
    return Z.zone_statistics(pixels, D.pixel_zones(spark, sf), D.zones(spark, sf), "zone")


STATS = {
    **MK,
    "px": "SELECT pixel_id, avg(anomaly) AS a, min(vci) AS m FROM drought GROUP BY 1",
    "joined": """SELECT t.pixel_id, t.slope, t.cls, p.a, p.m FROM trend t JOIN px p
        ON p.pixel_id = t.pixel_id""",
    "stats": ZONED.format(
        "mean_sen_slope, pct_greening, pct_browning, mean_anomaly, min_vci",
        """avg(x.slope) AS mean_sen_slope,
        100.0 * count(*) FILTER (WHERE x.cls = 1) / nullif(count(x.cls), 0) AS pct_greening,
        100.0 * count(*) FILTER (WHERE x.cls = -1) / nullif(count(x.cls), 0) AS pct_browning,
        avg(x.a) AS mean_anomaly, min(x.m) AS min_vci""",
        "joined",
    ),
}
STAT_COLUMNS = ("mean_sen_slope", "pct_greening", "pct_browning", "mean_anomaly", "min_vci")
STAT_SQL = ", ".join(f"round({c}, 6) + 0::DOUBLE AS {c}" for c in STAT_COLUMNS)


def rounded_stats(df):
    return df.select("zone", "nom", *[r(c).alias(c) for c in STAT_COLUMNS])


@query(
    "ag08_zone_statistics",
    with_("deseason", "drought", "pixel_zone", "zones", **STATS)
    + f"SELECT zone, nom, {STAT_SQL} FROM stats",
)
def zone_statistics(spark, sf):
    return rounded_stats(zone_table(spark, sf))


@query(
    "jn16_raster_alignment",
    with_("deseason", "drought", **{k: STATS[k] for k in (*MK, "px", "joined")})
    + """SELECT pixel_id, round(slope, 6) AS sen_slope, cls AS trend_class,
        round(a, 6) + 0::DOUBLE AS mean_anomaly, round(m, 6) AS min_vci FROM joined""",
)
def raster_alignment(spark, sf):
    rows = monthly(spark, sf)
    trends = T.trend_table(SE.series_for_trend(rows))
    both = trends.join(SE.drought_per_pixel(SE.drought(rows)), "pixel_id")
    return both.select(
        "pixel_id", r("sen_slope").alias("sen_slope"), "trend_class",
        r("mean_anomaly").alias("mean_anomaly"), r("min_vci").alias("min_vci"),
    )


@query(
    "tk01_rank_zones",
    with_("deseason", "drought", "pixel_zone", "zones", **STATS)
    + f"""SELECT zone, nom, {STAT_SQL} FROM stats WHERE mean_sen_slope IS NOT NULL
        ORDER BY stats.mean_sen_slope DESC, zone LIMIT 10""",
)
def rank_zones(spark, sf):
    return rounded_stats(Z.rank_zones(zone_table(spark, sf), "mean_sen_slope", "zone"))


@query(
    "tk02_driest_zones",
    with_(
        "drought", "pixel_zone", "zones",
        px="SELECT pixel_id, year(month)::INT AS year, avg(anomaly) AS a, min(vci) AS m FROM drought GROUP BY 1, 2",
        zy="""SELECT k.zone, x.year, avg(x.a) AS a, min(x.m) AS m FROM px x JOIN pixel_zone k
        ON k.pixel_id = x.pixel_id GROUP BY 1, 2""",
        ranked="""SELECT *, row_number() OVER (PARTITION BY year ORDER BY a, zone)::INT AS rank FROM zy
        WHERE a IS NOT NULL""",
    )
    + """SELECT r.year, r.rank, z.zone, z.nom, round(r.a, 6) + 0::DOUBLE AS mean_anomaly,
        round(r.m, 6) + 0::DOUBLE AS min_vci FROM ranked r JOIN zones z ON z.zone = r.zone WHERE r.rank <= 5""",
)
def driest_zones(spark, sf):
    """The five driest zones of every year: over all years the mean of a z-score is zero by construction."""
    yearly = SE.drought(monthly(spark, sf)).groupBy("pixel_id", F.year("month").alias("year"))
    pixels = yearly.agg(F.avg("anomaly").alias("a"), F.min("vci").alias("m"))
    zoned = pixels.join(D.pixel_zones(spark, sf), "pixel_id").groupBy("year", "zone")
    stats = zoned.agg(F.avg("a").alias("mean_anomaly"), F.min("m").alias("min_vci"))
    top = Z.rank_zones_within(stats, "year", "mean_anomaly", "zone", ascending=True, limit=5)
    return top.join(D.zones(spark, sf), "zone").select(
        "year", "rank", "zone", "nom", r("mean_anomaly").alias("mean_anomaly"), r("min_vci").alias("min_vci")
    )


@query(
    "tk02_top_browning",
    with_("deseason", "drought", "pixel_zone", "zones", **STATS)
    + f"""SELECT zone, nom, {STAT_SQL} FROM stats WHERE mean_sen_slope IS NOT NULL
        ORDER BY stats.mean_sen_slope, zone LIMIT 10""",
)
def top_browning(spark, sf):
    return rounded_stats(Z.named_ranking(zone_table(spark, sf), "top_browning", "zone"))


@query(
    "ag30_slope_signs",
    with_("deseason", "drought", "pixel_zone", "zones", **STATS)
    + """SELECT count(*) FILTER (WHERE mean_sen_slope > 0) AS n_greening,
        count(*) FILTER (WHERE mean_sen_slope < 0) AS n_browning FROM stats""",
)
def slope_signs(spark, sf):
    return Z.slope_signs(zone_table(spark, sf))


@query(
    "src22_timeline_sink",
    with_("drought", t=TIMELINE) + "SELECT month, round(anomaly_mean, 6) AS anomaly_mean FROM t",
)
def timeline_sink(spark, sf):
    products = V.run(D.observations(spark, sf))
    return products.timeline.select("month", r("anomaly_mean").alias("anomaly_mean"))


NDVI_OBS = """SELECT l_suppkey AS pixel_id, l_shipdate AS ts, CASE WHEN l_linenumber IN (4, 5, 6, 7)
    THEN (l_discount - l_tax) / nullif(l_discount + l_tax, 0) END AS v FROM lineitem"""


def job_vegetation(spark, sf):
    obs = D.observations(spark, sf)
    seen = obs.withColumn("v", I.masked_ndvi(F.col("red"), F.col("nir"), F.col("scl")))
    return V.run(seen, D.pixel_zones(spark, sf), D.zones(spark, sf), zone="zone")


JOB_SQL = with_("axis", "pixel_zone", "zones", obs=NDVI_OBS, monthly=D.CTE["monthly"],
                deseason=D.CTE["deseason"], drought=D.CTE["drought"], **STATS)


@query("job01_vegetation", JOB_SQL + f"SELECT zone, nom, {STAT_SQL} FROM stats")
def vegetation_zones(spark, sf):
    return rounded_stats(job_vegetation(spark, sf).zone_stats)


#: The pixels' places on the grid and zones that are polygons over it: one row of cells for each zone.
GRID_ZONES = {
    "pixel_zone": """SELECT s_suppkey AS pixel_id, z.zone FROM supplier JOIN (SELECT n_nationkey AS zone FROM nation) z
        ON floor(s_suppkey / 40) % 25 = z.zone""",
    "zones": "SELECT n_nationkey AS zone, n_name AS nom FROM nation",
    "obs": """SELECT pixel_id, day AS ts, arg_min(v, (ts, scene)) FILTER (v IS NOT NULL) AS v FROM (
        SELECT l_suppkey AS pixel_id, l_orderkey * 10 + l_linenumber AS scene, l_shipdate AS ts,
        (l_shipdate + to_seconds(((l_suppkey % 360 - 180)::DOUBLE / 15 * 3600)::BIGINT))::DATE AS day,
        CASE WHEN l_linenumber IN (4, 5, 6, 7) THEN (nir - red) / nullif(nir + red, 0) END AS v FROM (
        SELECT *, (l_partkey % 3000 + 900 - 1000) * (1.0::DOUBLE / 10000) AS red,
        (l_quantity * 100 + 1500 - 1000) * (1.0::DOUBLE / 10000) AS nir FROM lineitem)) GROUP BY 1, 2""",
    "axis": """SELECT m::DATE AS month, row_number() OVER (ORDER BY m) - 1 AS mi FROM (
        SELECT unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS m FROM obs)""",
    "monthly": D.CTE["monthly"], "deseason": D.CTE["deseason"], "drought": D.CTE["drought"], **STATS,
}


@query("job01_from_bands", with_(**GRID_ZONES) + f"SELECT zone, nom, {STAT_SQL} FROM stats")
def vegetation_from_bands(spark, sf):
    line = D.read(spark, sf, "lineitem")
    scenes = line.select(
        F.col("l_suppkey").alias("pixel_id"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_suppkey") % 360 - 180).cast("double").alias("lon"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scene"),
        (F.col("l_partkey") % 3000 + 900).cast("double").alias("red"),
        (F.col("l_quantity") * 100 + 1500).alias("nir"),
        F.col("l_linenumber").alias("scl"),
    )
    pixels = D.read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("pixel_id"), (F.col("s_suppkey") % 40).alias("col"),
        (F.floor(F.col("s_suppkey") / 40) % 25).alias("row"),
    )
    # Slanted strips within their row of cells.
    strip = "transform(array(struct(0.5D AS x, zone * 10 + 2D AS y), struct(399D AS x, zone * 10 + 3D AS y), struct(398D AS x, zone * 10 + 9D AS y), struct(1D AS x, zone * 10 + 8D AS y), struct(0.5D AS x, zone * 10 + 2D AS y)), p -> p)"
    zones = D.zones(spark, sf).withColumn("geom", G.ring_edges(strip))
    return rounded_stats(V.run_scenes(scenes, pixels, zones, 10.0).zone_stats)


@query(
    "geo28_solar_day_fusion",
    """SELECT pixel_id, day, arg_min(v, (ts, scene)) AS v FROM (
        SELECT l_suppkey AS pixel_id, l_orderkey * 10 + l_linenumber AS scene, l_shipdate AS ts,
        (l_shipdate + to_seconds(((l_suppkey % 360 - 180)::DOUBLE / 15 * 3600)::BIGINT))::DATE AS day,
        (l_discount - l_tax) / nullif(l_discount + l_tax, 0) AS v FROM lineitem)
        WHERE v IS NOT NULL GROUP BY 1, 2
        UNION ALL SELECT pixel_id, day, NULL FROM (
        SELECT l_suppkey AS pixel_id,
        (l_shipdate + to_seconds(((l_suppkey % 360 - 180)::DOUBLE / 15 * 3600)::BIGINT))::DATE AS day,
        (l_discount - l_tax) / nullif(l_discount + l_tax, 0) AS v FROM lineitem)
        GROUP BY 1, 2 HAVING count(v) = 0""",
)
def solar_day_fusion(spark, sf):
    scenes = D.read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pixel_id"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scene"),
        (F.col("l_suppkey") % 360 - 180).cast("double").alias("lon"),
        I.ndvi(F.col("l_tax"), F.col("l_discount")).alias("v"),
    )
    return C.fuse_solar_day(scenes)
