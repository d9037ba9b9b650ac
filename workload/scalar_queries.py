"""Scalar functions, normalisation, activity, embedding change."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapulse.functions import crs as P
from terrapulse.functions import indices as I
from terrapulse.functions import scoring as S
from terrapulse.functions import text as T
from terrapulse.operators import activity as A
from terrapulse.operators import change as CH
from terrapulse.operators.quantiles import column_quantiles
from terrapulse.sources import establishments as ES
from terrapulse.sources import layers as L
from terrapulse.sources import store as ST
from workload import standins as D
from workload.registry import query, r
from workload.standins import with_

LINE_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
NDVI_SQL = "(l_discount - l_tax) / nullif(l_discount + l_tax, 0)"


def lines(spark, sf):
    return D.read(spark, sf, "lineitem")


@query("fn01_ndvi", f"SELECT {LINE_KEY}, round({NDVI_SQL}, 9) + 0::DOUBLE AS ndvi FROM lineitem")
def ndvi(spark, sf):
    value = I.ndvi(F.col("l_tax"), F.col("l_discount"))
    return lines(spark, sf).select(*KEYS, r(value, 9).alias("ndvi"))


@query(
    "fn02_scene_mask",
    f"SELECT {LINE_KEY}, l_linenumber IN (4, 5, 6, 7) AS valid FROM lineitem",
)
def scene_mask(spark, sf):
    return lines(spark, sf).select(*KEYS, I.scene_is_valid(F.col("l_linenumber")).alias("valid"))


@query(
    "fn03_masked_ndvi",
    f"""SELECT {LINE_KEY}, CASE WHEN l_linenumber IN (4, 5, 6, 7)
        THEN round({NDVI_SQL}, 9) + 0::DOUBLE END AS ndvi FROM lineitem""",
)
def masked(spark, sf):
    value = I.masked_ndvi(F.col("l_tax"), F.col("l_discount"), F.col("l_linenumber"))
    return lines(spark, sf).select(*KEYS, r(value, 9).alias("ndvi"))


@query(
    "fn05_harmonize_reflectance",
    f"""SELECT {LINE_KEY}, round((l_partkey - 1000) / 10000.0, 6)::DOUBLE + 0::DOUBLE AS red,
        round((l_quantity * 100 - 1000) / 10000, 6) + 0::DOUBLE AS nir, l_linenumber AS scl
        FROM lineitem""",
)
def harmonize(spark, sf):
    cube = lines(spark, sf).select(
        *KEYS, F.col("l_partkey").alias("red"), (F.col("l_quantity") * 100).alias("nir"),
        F.col("l_linenumber").alias("scl"),
    )
    return I.harmonize_reflectance(cube).select(*KEYS, r("red").alias("red"), r("nir").alias("nir"), "scl")


# The published constants of the conic projection (exponent, radius, ordinate of the pole), the first
# eccentricity and the third flattening of its ellipsoid. The engine derives its own from parallels and flattening.
CONE_N, CONE_C, CONE_Y = "0.7256077650532670::DOUBLE", "11754255.426096::DOUBLE", "12655612.049876::DOUBLE"
ECCENTRICITY, THIRD = "0.0818191910428158::DOUBLE", "0.00167922039462874"


@query(
    "fn04_projections",
    with_(
        geo="""SELECT c_custkey AS k, radians(-1.5 + (c_custkey * 37) % 900 / 100.0::DOUBLE) AS lam,
        radians(42.5 + (c_custkey * 53) % 800 / 100.0::DOUBLE) AS phi FROM customer""",
        iso=f"""SELECT k, lam, phi, ln(tan(pi() / 4 + phi / 2)
        * pow((1 - {ECCENTRICITY} * sin(phi)) / (1 + {ECCENTRICITY} * sin(phi)), {ECCENTRICITY} / 2)) AS l FROM geo""",
        # The meridian series of the transverse projection, by powers of the third flattening.
        tm=f"""SELECT *, atan2(sinh(l), cos(lam - radians(3))) AS xi, atanh(sin(lam - radians(3)) / cosh(l)) AS eta,
        {THIRD}::DOUBLE AS f FROM iso""",
        co="""SELECT *, 6378137.0::DOUBLE / (1 + f) * (1 + f * f / 4 + f * f * f * f / 64) * 0.9996 AS big,
        f / 2 - 2 * f * f / 3 + 5 * f * f * f / 16 AS a1, 13 * f * f / 48 - 3 * f * f * f / 5 AS a2, 61 * f * f * f / 240 AS a3 FROM tm""",
    )
    + f"""SELECT k AS c_custkey,
        round(700000::DOUBLE + {CONE_C} * exp(-{CONE_N} * l) * sin({CONE_N} * (lam - radians(3))), 3) AS l93_x,
        round({CONE_Y} - {CONE_C} * exp(-{CONE_N} * l) * cos({CONE_N} * (lam - radians(3))), 3) AS l93_y,
        round(6378137.0::DOUBLE * lam, 3) AS merc_x,
        round(6378137.0::DOUBLE * ln(tan(pi() / 4 + phi / 2)), 3) AS merc_y,
        round(500000::DOUBLE + big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta)
            + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS utm_x,
        round(big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta)
            + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS utm_y,
        round(degrees(lam), 7) + 0::DOUBLE AS back_lon, round(degrees(phi), 7) AS back_lat FROM co""",
)
def projections(spark, sf):
    k = F.col("c_custkey")
    lon = F.lit(-1.5) + (k * 37) % 900 / F.lit(100.0)
    lat = F.lit(42.5) + (k * 53) % 800 / F.lit(100.0)
    rows = D.read(spark, sf, "customer").select(k, lon.alias("lon"), lat.alias("lat"))
    lon, lat = F.col("lon"), F.col("lat")
    l93, merc, utm = P.wgs84_to_l93(lon, lat), P.wgs84_to_mercator(lon, lat), P.wgs84_to_utm31(lon, lat)
    there = rows.select(
        k,
        *[c.alias(n) for c, n in zip(l93 + merc + utm, ("x", "y", "mx", "my", "ux", "uy"))],
    )
    # Through conic, then Mercator, then transverse Mercator and back to degrees.
    back = P.l93_to_wgs84(F.col("x"), F.col("y"))
    return there.select(
        k,
        *[
            F.round(F.col(c), 3).alias(n)
            for c, n in zip(
                ("x", "y", "mx", "my", "ux", "uy"),
                ("l93_x", "l93_y", "merc_x", "merc_y", "utm_x", "utm_y"),
            )
        ],
        r(back[0], 7).alias("back_lon"),
        r(back[1], 7).alias("back_lat"),
    )


@query(
    "fn06_rescale",
    """SELECT c_custkey, round(greatest(least((c_acctbal - 0) / 5000, 1), 0), 9) AS up,
        round(1 - greatest(least(c_acctbal / 5000, 1), 0), 9) AS down,
        round(greatest(least((c_acctbal / -1000 - 0) / -2, 1), 0), 9) AS flipped FROM customer""",
)
def rescale(spark, sf):
    v = F.col("c_acctbal")
    return D.read(spark, sf, "customer").select(
        "c_custkey",
        r(S.rescale(v, 0, 5000), 9).alias("up"),
        r(S.rescale(v, 0, 5000, invert=True), 9).alias("down"),
        r(S.rescale(v / F.lit(-1000.0), 0.0, -2.0), 9).alias("flipped"),
    )


@query(
    "fn07_band",
    """SELECT p_partkey, round(greatest(least(least((p_size - 5) / 10.0, 1),
        least((50 - p_size) / 10.0, 1)), 0), 9)::DOUBLE AS fit FROM part""",
)
def band(spark, sf):
    fit = S.band(F.col("p_size").cast("double"), 15, 40, 10)
    return D.read(spark, sf, "part").select("p_partkey", r(fit, 9).alias("fit"))


APTITUDE_SQL = """SELECT p_partkey, p_size, CASE WHEN p_type = 'PROMO' THEN 0 ELSE
    (25 * greatest(least((p_retailprice - 900) / 1000, 1), 0)
    + 20 * greatest(least(least((p_size - 5) / 10.0, 1), least((50 - p_size) / 10.0, 1)), 0)
    + 15 * (1 - greatest(least(p_partkey % 500 / 500.0, 1), 0))) / 60 * 100 END::DOUBLE AS score
    FROM part"""


def aptitude_rows(spark, sf):
    size = F.col("p_size").cast("double")
    score = S.aptitude(
        [
            (S.rescale(F.col("p_retailprice"), 900, 1900), 25),
            (S.band(size, 15, 40, 10), 20),
            (S.rescale((F.col("p_partkey") % 500).cast("double"), 0, 500, invert=True), 15),
        ],
        F.col("p_type") == "PROMO",
    )
    return D.read(spark, sf, "part").select("p_partkey", "p_size", score.alias("score"))


@query("fn08_aptitude", with_(a=APTITUDE_SQL) + "SELECT p_partkey, round(score, 6) AS score FROM a")
def aptitude(spark, sf):
    return aptitude_rows(spark, sf).select("p_partkey", r("score").alias("score"))


CLASS3 = "CASE WHEN score >= 66 THEN 2 WHEN score >= 33 THEN 1 ELSE 0 END"


@query("fn09_three_classes", with_(a=APTITUDE_SQL) + f"SELECT p_partkey, {CLASS3} AS classe FROM a")
def three_classes(spark, sf):
    rows = aptitude_rows(spark, sf)
    return rows.select("p_partkey", S.three_classes(F.col("score")).alias("classe"))


@query(
    "ag29_aptitude_summary",
    with_(a=APTITUDE_SQL)
    + f"""SELECT count(*) FILTER (WHERE {CLASS3} = 2) AS n_prioritaire,
        count(*) FILTER (WHERE {CLASS3} = 1) AS n_a_etudier,
        count(*) FILTER (WHERE {CLASS3} = 0) AS n_a_exclure FROM a""",
)
def aptitude_summary(spark, sf):
    from terrapulse.plans.burning import class_summary

    rows = aptitude_rows(spark, sf).withColumn("classe", S.three_classes(F.col("score")))
    return class_summary(rows)


@query(
    "ag31_class_distribution",
    with_(a=APTITUDE_SQL)
    + f"""SELECT CASE {CLASS3} WHEN 2 THEN 'prioritaire' WHEN 1 THEN 'à étudier'
        ELSE 'à exclure' END AS label, count(*) AS n FROM a GROUP BY 1""",
)
def class_distribution(spark, sf):
    from terrapulse.operators.zonal import class_distribution as distribution

    rows = aptitude_rows(spark, sf).withColumn("classe", S.three_classes(F.col("score")))
    return distribution(rows, "classe", {0: "à exclure", 1: "à étudier", 2: "prioritaire"})


@query(
    "fn10_priority_score",
    """SELECT c_custkey, round(pow(greatest(least(c_acctbal / 8000, 1), 0)
        * (c_custkey % 100) / 99.0 * ((c_custkey * 7) % 50) / 49.0, 1.0 / 3) * 100, 6) AS score
        FROM customer""",
)
def priority_score(spark, sf):
    k = F.col("c_custkey")
    axes = [F.col("c_acctbal") / F.lit(8000.0), (k % 100) / F.lit(99.0), (k * 7) % 50 / F.lit(49.0)]
    return D.read(spark, sf, "customer").select(k, r(S.priority_score(axes)).alias("score"))


@query(
    "fn11_degradation",
    """SELECT s_suppkey, round(coalesce(least(greatest(-(CASE WHEN s_suppkey % 7 > 0
        THEN s_acctbal / 1000000 END) / 0.01, 0), 1), 0), 9) AS degradation FROM (
        SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN -s_acctbal ELSE s_acctbal END AS s_acctbal
        FROM supplier)""".replace(
        "coalesce(least(greatest(-(CASE WHEN s_suppkey % 7 > 0\n        THEN s_acctbal / 1000000 END) / 0.01, 0), 1), 0)",
        "CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE least(greatest(-s_acctbal / 1000000 / 0.01, 0), 1) END",
    ),
)
def degradation(spark, sf):
    k, v = F.col("s_suppkey"), F.col("s_acctbal")
    slope = F.when(k % 7 > 0, F.when(k % 3 == 0, -v).otherwise(v) / F.lit(1000000.0))
    return D.read(spark, sf, "supplier").select(k, r(S.degradation(slope), 9).alias("degradation"))


@query(
    "fn12_professional_use",
    with_("buildings")
    + """SELECT id_batiment, usage_1, usage_2 FROM buildings
        WHERE usage_1 IN ('Commercial et services', 'Industriel')
        OR coalesce(usage_2 IN ('Commercial et services', 'Industriel'), false)""",
)
def professional_use(spark, sf):
    df = D.buildings(spark, sf)
    return df.where(T.is_professional(df)).select("id_batiment", "usage_1", "usage_2")


NATURE_SQL = """CASE p_type WHEN 'ECONOMY' THEN 'Forêt fermée de feuillus' WHEN 'LARGE' THEN 'Bois'
    WHEN 'MEDIUM' THEN 'Vigne' WHEN 'PROMO' THEN 'HAIE' WHEN 'SMALL' THEN 'Lande ligneuse' END"""


@query(
    "fn13_forest_nature",
    with_(v=f"SELECT p_partkey, {NATURE_SQL} AS nature FROM part")
    + """SELECT p_partkey, nature FROM v WHERE lower(nature) LIKE '%forêt%'
        OR lower(nature) LIKE '%foret%' OR lower(nature) LIKE '%bois%' OR lower(nature) LIKE '%haie%'""",
)
def forest_nature(spark, sf):
    kind = F.col("p_type")
    nature = (
        F.when(kind == "ECONOMY", "Forêt fermée de feuillus")
        .when(kind == "LARGE", "Bois")
        .when(kind == "MEDIUM", "Vigne")
        .when(kind == "PROMO", "HAIE")
        .when(kind == "SMALL", "Lande ligneuse")
    )
    rows = D.read(spark, sf, "part").select("p_partkey", nature.alias("nature"))
    return rows.where(T.is_forest(F.col("nature")))


@query(
    "fn14_scene_search",
    """SELECT o_orderkey AS id, o_orderdate AS datetime, (o_custkey % 100)::DOUBLE AS cloud_cover
        FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1999 AND o_custkey % 100 < 20
        AND o_orderkey % 100 <= 60 AND o_orderkey % 100 + 10 >= 40
        AND o_orderkey % 70 <= 50 AND o_orderkey % 70 + 10 >= 30""",
)
def scene_search(spark, sf):
    from terrapulse.sources.scenes import search_scenes

    k = F.col("o_orderkey")
    scenes = D.read(spark, sf, "orders").select(
        k.alias("id"),
        F.col("o_orderdate").alias("datetime"),
        (F.col("o_custkey") % 100).cast("double").alias("cloud_cover"),
        (k % 100).alias("minx"), (k % 70).alias("miny"),
        (k % 100 + 10).alias("maxx"), (k % 70 + 10).alias("maxy"),
    )
    found = search_scenes(scenes, (40, 30, 60, 50), 1997, 1999, 20.0)
    return found.select("id", "datetime", "cloud_cover")


@query(
    "fn15_land_score",
    """SELECT p_partkey, round(least(free / 400 * 20, 20), 6) AS score_foncier FROM (
        SELECT p_partkey, p_retailprice - 900 AS free, p_size % 3 AS resid, p_size % 4 AS block
        FROM part) WHERE resid > 0 AND block = 0 AND free > 50""",
)
def land_score(spark, sf):
    rows = D.read(spark, sf, "part").select(
        "p_partkey", (F.col("p_retailprice") - 900).alias("free"),
        (F.col("p_size") % 3).alias("resid"), (F.col("p_size") % 4).alias("block"),
    )
    kept = rows.where(S.land_gate(F.col("resid"), F.col("block"), F.col("free")))
    return kept.select("p_partkey", r(S.land_score(F.col("free"))).alias("score_foncier"))


@query(
    "fn16_nuisance_score",
    """SELECT p_partkey, round(least(8 * least(install / 40, 1) + 8
        + CASE WHEN road <= 30 THEN 4 ELSE 0 END, 20), 6)::DOUBLE AS score_nuisances FROM (
        SELECT p_partkey, p_size * 1.5::DOUBLE AS install, p_partkey % 30 AS built,
        p_partkey % 60 AS road FROM part) WHERE install >= 4 AND built <= 15""",
)
def nuisance_score(spark, sf):
    k = F.col("p_partkey")
    rows = D.read(spark, sf, "part").select(
        k, (F.col("p_size") * F.lit(1.5)).alias("install"), (k % 30).alias("built"), (k % 60).alias("road")
    )
    kept = rows.where(S.nuisance_gate(F.col("install"), F.col("built")))
    score = S.nuisance_score(F.col("install"), F.col("built"), F.col("road"))
    return kept.select(k, r(score).alias("score_nuisances"))


@query(
    "fn17_fibre_score",
    with_("fibre")
    + """SELECT id_locale, CASE statut_deploiement WHEN 'Déployé' THEN 20 ELSE 12 END::DOUBLE
        AS score_fibre FROM fibre WHERE statut_deploiement IN ('Déployé', 'Raccordable')""",
)
def fibre_score(spark, sf):
    status = F.col("statut_deploiement")
    kept = D.fibre(spark, sf).where(S.fibre_gate(status))
    return kept.select("id_locale", S.fibre_score(status).alias("score_fibre"))


@query(
    "fn18_energy_score",
    with_("energy")
    + """SELECT id_poste_source,
        round(least(10 + 10 * least((puissance_disponible_kva - 36) / 36, 1), 20), 6) AS score_energie
        FROM energy WHERE puissance_disponible_kva >= 36""",
)
def energy_score(spark, sf):
    kva = F.col("puissance_disponible_kva")
    kept = D.energy(spark, sf).where(S.energy_gate(kva))
    return kept.select("id_poste_source", r(S.energy_score(kva)).alias("score_energie"))


SCORES_SQL = """SELECT c_custkey, c_nationkey, c_custkey % 21 * 1.0::DOUBLE AS a, (c_custkey * 3) % 41 * 0.5::DOUBLE AS b,
    (c_custkey * 7) % 81 * 0.25::DOUBLE AS c, (c_custkey * 11) % 21 * 1.0::DOUBLE AS d, 20::DOUBLE AS e,
    (c_custkey % 3) * 5::DOUBLE AS f FROM customer"""
TOTAL_SQL = """SELECT *, least(round(a + b + c + d + e + f, 1), 100) AS score_total,
    CASE WHEN a + b + c + d + e + f >= 90 THEN 'Premium' WHEN a + b + c + d + e + f >= 70 THEN 'Bon'
    ELSE 'Moyen' END AS classe FROM sc"""


def totals(spark, sf):
    k = F.col("c_custkey")
    parts = [
        k % 21 * F.lit(1.0), (k * 3) % 41 * F.lit(0.5), (k * 7) % 81 * F.lit(0.25),
        (k * 11) % 21 * F.lit(1.0), F.lit(20.0), (k % 3) * F.lit(5.0),
    ]
    return D.read(spark, sf, "customer").select(
        k, "c_nationkey", S.total_score(parts).alias("score_total"), S.total_class(parts).alias("classe")
    )


@query("fn19_total_and_class", with_(sc=SCORES_SQL, t=TOTAL_SQL) + "SELECT c_custkey, score_total, classe FROM t")
def total_and_class(spark, sf):
    return totals(spark, sf).select("c_custkey", "score_total", "classe")


@query(
    "wn08_percentile_score",
    with_(sc=SCORES_SQL, t=TOTAL_SQL)
    + """SELECT c_custkey, round(100 * percent_rank() OVER (ORDER BY score_total), 6)
        AS percentile_score FROM t""",
)
def percentile_score(spark, sf):
    from terrapulse.operators.ranks import percentile_of_score

    ranked = percentile_of_score(totals(spark, sf), "score_total")
    return ranked.select("c_custkey", r("percentile_score").alias("percentile_score"))


@query(
    "ag36_score_quartiles",
    with_(sc=SCORES_SQL, t=TOTAL_SQL)
    + """SELECT round(quantile_cont(score_total, 0.25), 6) AS p25,
        round(quantile_cont(score_total, 0.5), 6) AS median,
        round(quantile_cont(score_total, 0.75), 6) AS p75 FROM t""",
)
def score_quartiles(spark, sf):
    scores = totals(spark, sf).select("score_total")
    named = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    found = column_quantiles(scores, "score_total", list(named.values()))
    return found.select(*[r(F.col("quantiles")[i]).alias(n) for i, n in enumerate(named)])


@query(
    "ag20_class_ranking",
    with_(sc=SCORES_SQL, t=TOTAL_SQL)
    + """SELECT classe, count(*) AS n, round(avg(score_total), 1) AS score_moyen FROM t
        GROUP BY 1 ORDER BY 3 DESC""",
)
def class_ranking(spark, sf):
    from terrapulse.plans.reports import class_ranking as ranking

    return ranking(totals(spark, sf), "classe", "score_total", "score_moyen")


@query(
    "tk03_top_scores",
    with_(sc=SCORES_SQL, t=TOTAL_SQL)
    + "SELECT c_custkey, score_total, classe FROM t ORDER BY score_total DESC, c_custkey LIMIT 20",
)
def top_scores(spark, sf):
    from terrapulse.plans.reports import top_report

    return top_report(totals(spark, sf), "score_total", "c_custkey").select("c_custkey", "score_total", "classe")


LAT_SQL = """CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN 'n/a'
    ELSE ' ' || (40 + o_orderkey % 10) || ',' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || ' ' END"""


def coordinate_text():
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.concat(
        F.lit(" "), (k % 10 + 40).cast("string"), F.lit(","),
        F.lpad((c % 1000).cast("string"), 3, "0"), F.lit(" "),
    )
    return F.when(k % 97 == 0, "").when(k % 89 == 0, "n/a").otherwise(number)


@query(
    "fn21_parse_coordinate",
    with_(t=f"SELECT o_orderkey, {LAT_SQL} AS lat FROM orders")
    + """SELECT o_orderkey, try_cast(replace(trim(lat), ',', '.') AS DOUBLE) AS latitude,
        CASE WHEN trim(lat) = '' THEN 'missing latitude'
        WHEN try_cast(replace(trim(lat), ',', '.') AS DOUBLE) IS NULL THEN 'invalid latitude' END
        AS error FROM t""",
)
def parse_coordinate(spark, sf):
    rows = D.read(spark, sf, "orders").select("o_orderkey", coordinate_text().alias("lat"))
    return rows.select(
        "o_orderkey",
        T.parse_coordinate(F.col("lat")).alias("latitude"),
        T.coordinate_error(F.col("lat"), "latitude").alias("error"),
    )


@query(
    "fn22_supplier_id",
    """SELECT s_suppkey, coalesce(nullif(trim(CASE WHEN s_suppkey % 5 = 0 THEN '  ' ELSE s_name END),
        ''), 'SUP-' || lpad((s_suppkey + 1)::VARCHAR, 6, '0')) AS supplier_id FROM supplier""",
)
def supplier_ids(spark, sf):
    k = F.col("s_suppkey")
    given = F.when(k % 5 == 0, "  ").otherwise(F.col("s_name"))
    return D.read(spark, sf, "supplier").select(k, T.supplier_id(given, k + 1).alias("supplier_id"))


@query(
    "fn23_raw_material",
    """SELECT p_partkey, coalesce(CASE WHEN p_size % 4 > 0 THEN p_type END, 'Unknown') AS from_column,
        'Cocoa' AS fixed FROM part""",
)
def raw_material(spark, sf):
    commodity = F.when(F.col("p_size") % 4 > 0, F.col("p_type"))
    return D.read(spark, sf, "part").select(
        "p_partkey",
        T.raw_material(commodity, T.USE_COMMODITY_COLUMN).alias("from_column"),
        T.raw_material(commodity, "Cocoa").alias("fixed"),
    )


@query(
    "fn24_risk_band",
    """SELECT c_custkey, CASE WHEN c_custkey % 101 <= 19 THEN 'low' WHEN c_custkey % 101 <= 50
        THEN 'medium' ELSE 'high' END AS risk FROM customer""",
)
def risk_band(spark, sf):
    return D.read(spark, sf, "customer").select(
        "c_custkey", S.risk_band(F.col("c_custkey") % 101).alias("risk")
    )


COMMUNE_SQL = """SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN '75056' WHEN 1 THEN '13055'
    WHEN 2 THEN '69123' ELSE lpad((o_custkey % 95 * 1000 + 5)::VARCHAR, 5, '0') END AS insee FROM orders"""


@query(
    "fn25_district_codes",
    with_(
        c=COMMUNE_SQL,
        m="""SELECT '75056' AS insee, '751' || lpad(i::VARCHAR, 2, '0') AS code FROM range(1, 21) t(i)
        UNION ALL SELECT '13055', '132' || lpad(i::VARCHAR, 2, '0') FROM range(1, 17) t(i)
        UNION ALL SELECT '69123', '693' || i FROM range(81, 90) t(i)""",
    )
    + """SELECT c.o_orderkey, c.insee, coalesce(m.code, c.insee) AS code
        FROM c LEFT JOIN m ON m.insee = c.insee""",
)
def district_codes(spark, sf):
    c = F.col("o_custkey")
    insee = (
        F.when(c % 6 == 0, "75056").when(c % 6 == 1, "13055").when(c % 6 == 2, "69123")
        .otherwise(F.lpad((c % 95 * 1000 + 5).cast("string"), 5, "0"))
    )
    rows = D.read(spark, sf, "orders").select("o_orderkey", insee.alias("insee"))
    return ES.expand_districts(rows, "insee")


@query(
    "fn26_activity_sections",
    with_(
        rng="""SELECT * FROM (VALUES ('A',1,3),('B',5,9),('C',10,33),('D',35,35),('E',36,39),
        ('F',41,43),('G',45,47),('H',49,53),('I',55,56),('J',58,63),('K',64,66),('L',68,68),
        ('M',69,75),('N',77,82),('O',84,84),('P',85,85),('Q',86,88),('R',90,93),('S',94,96),
        ('T',97,98),('U',99,99)) t(section, lo, hi)""",
        codes="""SELECT DISTINCT lpad((p_partkey % 100)::VARCHAR, 2, '0') || '.'
        || lpad((p_size % 50)::VARCHAR, 2, '0') || 'Z' AS code FROM part""",
    )
    + """SELECT section, count(*) AS n_codes, min(code) AS first_code, max(code) AS last_code
        FROM codes JOIN rng ON substr(code, 1, 2)::INTEGER BETWEEN lo AND hi GROUP BY 1""",
)
def activity_sections(spark, sf):
    code = F.concat(
        F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("."),
        F.lpad((F.col("p_size") % 50).cast("string"), 2, "0"), F.lit("Z"),
    )
    codes = D.read(spark, sf, "part").select(code.alias("code")).distinct()
    per_section = ES.codes_by_section(codes, "code")
    return per_section.select(
        "section",
        F.size("codes").cast("bigint").alias("n_codes"),
        F.element_at("codes", 1).alias("first_code"),
        F.element_at("codes", -1).alias("last_code"),
    )


@query(
    "fn27_parcel_id",
    """SELECT concat_ws('-', l_suppkey, l_returnflag, l_orderkey) AS id_parcelle, l_linenumber,
        l_discount AS aire FROM lineitem WHERE l_discount > 0""",
)
def parcel_id(spark, sf):
    from terrapulse.plans.commune_analysis import parcel_id as make_id

    rows = lines(spark, sf).where(F.col("l_discount") > 0)
    made = make_id(F.col("l_suppkey"), F.col("l_returnflag"), F.col("l_orderkey"))
    return rows.select(made.alias("id_parcelle"), "l_linenumber", F.col("l_discount").alias("aire"))


@query(
    "fn28_building_flags",
    """SELECT p_partkey, p_type = 'ECONOMY' AS est_residentiel,
        (coalesce(try_cast(CASE WHEN p_size % 5 = 0 THEN 'x' ELSE (p_size % 9)::VARCHAR END AS DOUBLE), 0) > 4
        OR coalesce(try_cast((p_size % 6)::VARCHAR AS DOUBLE), 0) >= 4) AS est_immeuble
        FROM part WHERE p_brand <> 'Brand#1'""",
)
def building_flags(spark, sf):
    from terrapulse.plans.commune_analysis import stage_building_flags

    size = F.col("p_size")
    rows = D.read(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_type") == "ECONOMY", "Résidentiel").otherwise(F.col("p_type")).alias("USAGE1"),
        F.when(size % 5 == 0, "x").otherwise((size % 9).cast("string")).alias("NB_LOGTS"),
        (size % 6).cast("string").alias("NB_ETAGES"),
        F.when(F.col("p_brand") != "Brand#1", "En service").otherwise("En projet").alias("ETAT"),
    )
    return stage_building_flags(rows).select("p_partkey", "est_residentiel", "est_immeuble")


EVAL_IN = """SELECT o_orderkey AS id, o_orderkey % 4 AS n_resid, o_orderkey % 7 // 6 AS n_block,
    (o_custkey % 900)::DOUBLE + 0.37::DOUBLE AS libre, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 90 END::DOUBLE AS install,
    CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 20 END::DOUBLE AS bati,
    CASE WHEN o_orderkey % 13 > 0 THEN CASE o_orderstatus WHEN 'F' THEN 'Déployé' WHEN 'O'
    THEN 'Raccordable' ELSE 'Non desservi' END END AS fibre, (o_custkey % 200)::DOUBLE AS hta,
    o_orderkey % 10 = 3 AS ebc FROM orders"""
EVAL = {
    "i": EVAL_IN,
    "ev": """SELECT *, (n_resid > 0 AND n_block = 0 AND libre > 50) AS g1,
        (install >= 4 AND bati <= 15) AS g2, (fibre IN ('Déployé', 'Raccordable')) AS g3,
        (hta <= 150) AS g4, (NOT ebc) AS g5, 20 * least(libre / 400, 1) AS s1,
        least(10 * least(install / 40, 1) + CASE WHEN bati <= 15 THEN 10 ELSE 0 END, 20)::DOUBLE AS s2,
        CASE fibre WHEN 'Déployé' THEN 20 WHEN 'Raccordable' THEN 12 ELSE 0 END::DOUBLE AS s3,
        20 * greatest((150 - hta) / 150, 0) AS s4, CASE WHEN ebc THEN 0 ELSE 20 END::DOUBLE AS s5 FROM i""",
    "qa": """SELECT *, (g1 AND g2 AND g3 AND g4 AND g5) AS eligible,
        least(round(s1 + s2 + s3 + s4 + s5, 1), 100) AS indice,
        CASE WHEN NOT g1 THEN '1-Foncier' WHEN NOT g2 THEN '2-Nuisances' WHEN NOT g3 THEN '3-Fibre'
        WHEN NOT g4 THEN '4-Energie (HTA)' WHEN NOT g5 THEN '5-EBC' ELSE '0-Candidate' END AS etape_rejet,
        CASE WHEN NOT (g1 AND g2 AND g3 AND g4 AND g5) THEN NULL WHEN s1 + s2 + s3 + s4 + s5 >= 80
        THEN 'Premium' WHEN s1 + s2 + s3 + s4 + s5 >= 60 THEN 'Bon' ELSE 'Moyen' END AS classe FROM ev""",
}


def evaluated(spark, sf):
    from terrapulse.plans.commune_analysis import evaluate

    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    status = F.when(s == "F", "Déployé").when(s == "O", "Raccordable").otherwise("Non desservi")
    rows = D.read(spark, sf, "orders").select(
        k.alias("id"),
        (k % 4).alias("n_resid_indiv"),
        F.floor(k % 7 / 6).alias("n_immeuble"),
        (c % 900 + F.lit(0.37)).alias("surface_libre_m2"),
        F.when(k % 11 > 0, c % 90).cast("double").alias("install_m2"),
        F.when(k % 11 > 0, c % 20).cast("double").alias("dist_bati_m"),
        F.when(k % 13 > 0, status).alias("fibre_statut"),
        (c % 200).cast("double").alias("dist_hta_m"),
        (k % 10 == 3).alias("dans_ebc"),
    )
    return evaluate(rows)


@query(
    "fn29_five_gates_and_scores",
    with_(**EVAL)
    + """SELECT id, g1 AS pass_foncier, g2 AS pass_nuisances, g3 AS pass_fibre, g4 AS pass_energie,
        g5 AS pass_reglement, round(s1, 6) AS score_foncier, round(s2, 6) AS score_nuisances,
        s3 AS score_fibre, round(s4, 6) AS score_energie, s5 AS score_reglement FROM ev""",
)
def five_gates(spark, sf):
    return evaluated(spark, sf).select(
        "id", "pass_foncier", "pass_nuisances", "pass_fibre", "pass_energie", "pass_reglement",
        r("score_foncier").alias("score_foncier"), r("score_nuisances").alias("score_nuisances"),
        "score_fibre", r("score_energie").alias("score_energie"), "score_reglement",
    )


@query(
    "fn30_eligibility_and_rejection",
    with_(**EVAL) + "SELECT id, eligible, indice, etape_rejet, classe FROM qa",
)
def eligibility(spark, sf):
    from terrapulse.plans.commune_analysis import conclude

    return conclude(evaluated(spark, sf)).select("id", "eligible", "indice", "etape_rejet", "classe")


@query(
    "ag21_rejection_histogram",
    with_(**EVAL)
    + """SELECT etape_rejet, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE
        AS pct FROM qa GROUP BY 1""",
)
def rejection_histogram(spark, sf):
    from terrapulse.plans.commune_analysis import conclude
    from terrapulse.plans.reports import rejection_histogram as histogram

    out = histogram(conclude(evaluated(spark, sf)), "etape_rejet")
    return out.select("etape_rejet", "n", r("pct").alias("pct"))


@query(
    "fn32_occupation_status",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'VACANT_CANDIDAT' ELSE 'OCCUPE' END
        AS statut_occupation FROM customer""",
)
def occupation_status(spark, sf):
    return D.read(spark, sf, "customer").select(
        "c_custkey", S.occupation_status(F.col("c_custkey") % 4).alias("statut_occupation")
    )


@query(
    "ag32_weekly_series",
    """SELECT w::DATE AS week, count(event_id) AS n FROM (SELECT unnest(generate_series(
        DATE '2024-01-29' - 25 * 7, DATE '2024-01-29', INTERVAL 7 DAY)) AS w)
        LEFT JOIN events ON date_trunc('week', ts) = w GROUP BY 1""",
)
def weekly_series(spark, sf):
    today = F.to_date(F.lit("2024-01-31"))
    return A.weekly_series(D.read(spark, sf, "events"), "ts", 26, today)


@query(
    "ag33_weekday_histogram",
    """SELECT d::INTEGER AS weekday, count(event_id) AS n, count(event_id) > 0 AND row_number() OVER (
        ORDER BY count(event_id) DESC, d) = 1 AS is_peak FROM range(7) t(d)
        LEFT JOIN events ON isodow(ts) - 1 = d GROUP BY d""",
)
def weekday_histogram(spark, sf):
    return A.weekday_histogram(D.read(spark, sf, "events"), "ts")


@query(
    "ag34_top_shares",
    with_(
        s="SELECT user_id::VARCHAR AS language, sum(event_id) AS bytes FROM events GROUP BY 1",
        k="SELECT *, row_number() OVER (ORDER BY bytes DESC, language) AS rk FROM s",
        g="""SELECT CASE WHEN rk <= 5 THEN language ELSE 'Autres' END AS language,
        sum(bytes)::BIGINT AS bytes FROM k GROUP BY 1""",
    )
    + """SELECT language, bytes, round(100.0::DOUBLE * bytes / sum(bytes) OVER (), 6) AS share_pct FROM g""",
)
def top_shares(spark, sf):
    rows = D.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("language"), "event_id")
    shares = A.top_shares(rows, "language", "event_id")
    return shares.select("language", "bytes", r("share_pct").alias("share_pct"))


@query(
    "ag35_activity_totals",
    "SELECT count(*) AS n_events, count(DISTINCT ts::DATE) AS active_days FROM events",
)
def activity_totals(spark, sf):
    return A.activity_totals(D.read(spark, sf, "events"), "ts")


EMB = {
    "n": "SELECT count(*) AS n FROM embeddings",
    "y1": "SELECT vec_id AS pixel_id, embedding::DOUBLE[] AS e FROM embeddings",
    "y2": "SELECT (vec_id + n - 1) % n AS pixel_id, embedding::DOUBLE[] AS e FROM embeddings, n",
    "dist": """SELECT y1.pixel_id, 1 - list_dot_product(y1.e, y2.e)
        / ((sqrt(list_dot_product(y1.e, y1.e)) + 1e-12) * (sqrt(list_dot_product(y2.e, y2.e)) + 1e-12))
        AS d FROM y1 JOIN y2 ON y1.pixel_id = y2.pixel_id""",
    "thr": "SELECT quantile_cont(d, 0.95) AS t FROM dist",
}


def two_years(spark, sf):
    emb = D.read(spark, sf, "embeddings")
    n = emb.agg(F.count(F.lit(1)).alias("n")).scalar()
    year1 = emb.select(F.col("vec_id").alias("pixel_id"), "embedding")
    year2 = emb.select(((F.col("vec_id") + n - 1) % n).alias("pixel_id"), "embedding")
    return year1, year2


@query(
    "jn14_year_alignment",
    with_(**EMB) + "SELECT pixel_id, round(d, 9) AS change_distance FROM dist",
)
def year_alignment(spark, sf):
    rows = CH.aligned_distance(*two_years(spark, sf))
    return rows.select("pixel_id", r("change_distance", 9).alias("change_distance"))


@query(
    "ag25_percentile_flag",
    """SELECT o_orderkey, o_totalprice > (SELECT quantile_cont(o_totalprice, 0.9) FROM orders) AS changed
        FROM orders""",
)
def percentile_flag(spark, sf):
    rows = D.read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return CH.flag_by_percentile(rows, "o_totalprice", 90.0).select("o_orderkey", "changed")


@query(
    "ag26_detect_change",
    with_(**EMB)
    + "SELECT pixel_id, round(d, 9) AS change_distance, d > t AS changed FROM dist, thr",
)
def detect_change(spark, sf):
    rows = CH.detect_change(*two_years(spark, sf))
    return rows.select("pixel_id", r("change_distance", 9).alias("change_distance"), "changed")


@query(
    "ag27_change_summary",
    with_(**EMB)
    + """SELECT count(*) AS n_pixels, count(*) FILTER (WHERE d > t) AS n_changed,
        round(any_value(t), 4) AS threshold FROM dist, thr""",
)
def change_summary(spark, sf):
    return CH.change_summary(CH.detect_change(*two_years(spark, sf)))


@query(
    "job08_change_candidates",
    with_(**EMB)
    + "SELECT pixel_id, round(d, 9) AS change_distance, round(t, 9) AS threshold FROM dist, thr WHERE d > t",
)
def change_candidates(spark, sf):
    from terrapulse.plans.embedding_change import run

    kept = run(*two_years(spark, sf)).candidates
    return kept.select(
        "pixel_id", r("change_distance", 9).alias("change_distance"), r("threshold", 9).alias("threshold")
    )


def forest_samples(spark, sf):
    return D.read(spark, sf, "embeddings").withColumnRenamed("vec_id", "pixel_id")


@query(
    "ml01_forest_training",
    """SELECT count(*) AS n_samples, count(DISTINCT label)::INT AS n_classes, 100 AS n_trees,
        string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR) AS class_names FROM embeddings""",
)
def forest_training(spark, sf):
    samples = forest_samples(spark, sf)
    trained = CH.train_forest(samples, folds=0)
    return samples.agg(F.count(F.lit(1)).alias("n_samples")).select(
        F.col("n_samples"),
        F.lit(len(trained.class_names)).alias("n_classes"),
        F.lit(trained.model.getNumTrees).alias("n_trees"),
        F.lit(",".join(trained.class_names)).alias("class_names"),
    )


@query(
    "ml02_cross_validation",
    """WITH s AS (SELECT CASE WHEN embedding[1] > 0.05 THEN 'a' WHEN embedding[1] < -0.05 THEN 'b' ELSE 'c' END AS label FROM embeddings)
        SELECT label, (place % least(5, k))::INT AS fold, count(*) AS n, true AS better_than_majority FROM (
        SELECT label, row_number() OVER (PARTITION BY label) - 1 AS place, k FROM s, (
        SELECT min(n) AS k FROM (SELECT count(*) AS n FROM s GROUP BY label))) GROUP BY ALL""",
)
def cross_validation(spark, sf):
    """Labels that one of the features tells: a forest that learns is far above the share of the largest class."""
    told = F.get("embedding", F.lit(0))
    label = F.when(told > 0.05, "a").when(told < -0.05, "b").otherwise("c")
    samples = forest_samples(spark, sf).withColumn("label", label)
    trained = CH.train_forest(samples)
    sizes = [row["count"] for row in samples.groupBy("label").count().collect()]
    folded = CH.stratified_fold(samples, "label", "pixel_id", min(5, *sizes))
    better = F.lit(trained.cv_accuracy > 0.2 + max(sizes) / sum(sizes))
    return folded.groupBy("label", F.col("_fold").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.first(better).alias("better_than_majority")
    )


@query(
    "ml03_classify_pixels",
    """SELECT vec_id AS pixel_id, true AS known_class, true AS confidence_in_range, true AS mostly_right
        FROM embeddings""",
)
def classify_pixels(spark, sf):
    samples = forest_samples(spark, sf)
    found = CH.classify_pixels(CH.train_forest(samples, folds=0), samples)
    labels = samples.select(F.col("label").cast("string").alias("known")).distinct()
    right = found.agg(F.avg((F.col("predicted_class") == F.col("label").cast("string")).cast("double"))).scalar()
    joined = found.join(labels, F.col("predicted_class") == F.col("known"), "left")
    return joined.select(
        "pixel_id",
        F.col("known").isNotNull().alias("known_class"),
        F.col("confidence").between(0.0, 1.0).alias("confidence_in_range"),
        (right > 0.9).alias("mostly_right"),
    )


@query(
    "src09_establishment_file",
    with_(f=f"SELECT o_orderkey, o_custkey, o_orderstatus, {LAT_SQL} AS lat FROM orders")
    + """SELECT siret, arg_min(naf, k) AS activite_principale, arg_min(lat, k) AS latitude,
        arg_min(lon, k) AS longitude FROM (
        SELECT lpad((o_custkey)::VARCHAR, 14, '0') AS siret, o_orderkey AS k, o_orderstatus AS naf,
        try_cast(replace(trim(lat), ',', '.') AS DOUBLE) AS lat, (o_custkey % 7)::DOUBLE AS lon FROM f
        WHERE o_orderstatus <> 'P') WHERE lat IS NOT NULL GROUP BY 1""",
)
def establishment_file(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = D.read(spark, sf, "orders").select(
        F.format_string("%014d", c).alias("siret"),
        F.col("o_orderstatus").alias("naf"),
        F.replace(F.trim(coordinate_text()), F.lit(","), F.lit(".")).alias("latitude"),
        (c % 7).cast("string").alias("longitude"),
        F.when(F.col("o_orderstatus") != "P", "A").otherwise("F").alias("etatAdministratifEtablissement"),
        k.alias("line"),
    )
    out = ES.normalize_geofile(raw, {"activite_principale": "naf"}, order="line")
    return out.select("siret", "activite_principale", "latitude", "longitude")


@query(
    "src12_fibre_status",
    """SELECT c_custkey AS id_locale, CASE WHEN f.k IS NULL THEN 'Non desservi' ELSE 'Déployé' END
        AS statut_deploiement, coalesce(f.op, '') AS operateur FROM customer LEFT JOIN (
        SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) AS op FROM orders
        WHERE o_orderstatus = 'F' GROUP BY 1) f ON f.k = c_custkey WHERE c_nationkey < 12""",
)
def fibre_status(spark, sf):
    from terrapulse.sources.fibre import fibre_layer

    buildings = D.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("imb_id"),
        F.when(F.col("c_nationkey") < 12, "07005").otherwise("26000").alias("imb_code_insee"),
        (F.lit(500000.0) + F.col("c_custkey")).cast("string").alias("imb_x"),
        (F.lit(5500000.0) + F.col("c_custkey")).cast("string").alias("imb_y"),
        F.lit("12").alias("imb_nbr_logloc"),
    )
    eligibility_rows = D.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("imb_id"),
        F.when(F.col("o_orderstatus") == "F", "FO").otherwise("CU").alias("code_techno"),
        F.col("o_orderpriority").alias("code_operateur"),
        F.col("o_orderkey").alias("line"),
    )
    layer = fibre_layer(buildings, eligibility_rows, "07005", order="line")
    return layer.select("id_locale", "statut_deploiement", "operateur")


@query(
    "src15_layer_contract",
    """SELECT c_name AS id_parcelle, substr(lpad(c_nationkey::VARCHAR, 5, '0') || 'XYZ', 1, 5) AS commune_insee,
        substr(lpad(c_nationkey::VARCHAR, 5, '0'), 1, 2) AS dept, 'Commune' AS commune FROM customer""",
)
def layer_contract(spark, sf):
    raw = D.read(spark, sf, "customer").select(
        F.col("c_name").alias(" IDU "),
        F.concat(F.lpad(F.col("c_nationkey").cast("string"), 5, "0"), F.lit("XYZ")).alias("Code-INSEE"),
    )
    return L.adapt_parcels(raw, "Commune").select("id_parcelle", "commune_insee", "dept", "commune")


PRODUCTS_SQL = """SELECT 'run-' || doc_id AS run_id, 'aoi-' || doc_id % 7 AS aoi_id, lang AS pilier,
    source AS produit, 'p' || doc_id // 3 AS stem, CASE doc_id % 3 WHEN 0 THEN 'parquet' WHEN 1 THEN
    'geojson' ELSE 'csv' END AS ext FROM documents"""


def products(spark, sf):
    k = F.col("doc_id")
    ext = F.when(k % 3 == 0, "parquet").when(k % 3 == 1, "geojson").otherwise("csv")
    stem = F.concat(F.lit("p"), F.floor(k / 3).cast("string"))
    folder = F.concat_ws("/", F.lit("root"), "lang")
    return D.read(spark, sf, "documents").select(
        F.concat(F.lit("run-"), k.cast("string")).alias("run_id"),
        F.concat(F.lit("aoi-"), (k % 7).cast("string")).alias("aoi_id"),
        F.concat(folder, F.lit("/"), stem, F.lit("."), ext).alias("path"),
    )


@query(
    "src19_loadable_products",
    with_(p=PRODUCTS_SQL)
    + """SELECT 'root/' || pilier || '/' || stem || '.' || ext AS path FROM p a
        WHERE aoi_id = 'aoi-3' AND ext IN ('parquet', 'geojson') AND NOT (ext = 'parquet' AND EXISTS (
        SELECT 1 FROM p b WHERE b.aoi_id = 'aoi-3' AND b.pilier = a.pilier AND b.stem = a.stem
        AND b.ext = 'geojson'))""",
)
def loadable_products(spark, sf):
    return ST.loadable_products(products(spark, sf), "aoi-3").select("path")


@query(
    "src25_latest_product",
    """SELECT source AS produit, max(lang || '_' || lpad(doc_id::VARCHAR, 6, '0')) AS latest
        FROM documents GROUP BY 1""",
)
def latest_product(spark, sf):
    name = F.concat_ws("_", "lang", F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    rows = D.read(spark, sf, "documents").select(F.col("source").alias("produit"), name.alias("path"))
    return ST.latest_products(rows, "produit", "path").select("produit", F.col("path").alias("latest"))


@query(
    "so02_stacked_layers",
    """SELECT 'site' AS kind, s_name AS nom_site FROM supplier
        UNION ALL SELECT 'zone', NULL FROM nation""",
)
def stacked_layers(spark, sf):
    named = D.read(spark, sf, "supplier").select(F.col("s_name").alias("nom_site"))
    unnamed = D.read(spark, sf, "nation").select(F.col("n_nationkey").alias("gid"))
    empty = D.read(spark, sf, "region").where(F.lit(False)).select(F.col("r_name").alias("nom_site"))
    return L.stack_layers({"site": named, "zone": unnamed, "none": empty}, ["nom_site"])


@query(
    "so03_merged_establishments",
    """SELECT siret, arg_min(src, (src, k)) AS source FROM (
        SELECT o_custkey AS siret, 'a' AS src, o_orderkey AS k FROM orders
        UNION ALL SELECT c_custkey, 'b', c_custkey FROM customer) GROUP BY 1""",
)
def merged_establishments(spark, sf):
    first = D.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("siret"), F.lit("a").alias("source"), F.col("o_orderkey").alias("k")
    )
    second = D.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("siret"), F.lit("b").alias("source"), F.col("c_custkey").alias("k")
    )
    return ES.merge_establishments([first, second], ["source", "k"]).select("siret", "source")


@query(
    "so04_stacked_departments",
    """SELECT c_custkey AS code, c_name AS nom FROM customer
        UNION ALL SELECT s_suppkey, s_name FROM supplier""",
)
def stacked_departments(spark, sf):
    frames = {
        "07": D.read(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("nom")),
        "26": D.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("nom")),
    }
    return L.stack_layers(frames, ["code", "nom"]).select("code", "nom")


@query(
    "wn09_first_per_key",
    """SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice
        FROM orders GROUP BY 1""",
)
def first_per_key(spark, sf):
    rows = D.read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ES.first_per_key(rows, "o_custkey", ["o_orderkey"])


@query(
    "jn17_id_semi_join",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
        SELECT c_custkey FROM customer WHERE c_nationkey < 12)""",
)
def id_semi_join(spark, sf):
    wanted = D.read(spark, sf, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return D.read(spark, sf, "orders").select("o_orderkey", "o_custkey").join(wanted, "o_custkey", "left_semi")


@query(
    "dq09_target_schema",
    """SELECT c_nationkey::VARCHAR AS dept, count(*) AS n_parcels,
        count(*) FILTER (WHERE c_acctbal > 0) AS n_passing,
        count(*) FILTER (WHERE c_custkey > c_acctbal) AS n_free_above_area FROM customer GROUP BY 1""",
)
def target_schema(spark, sf):
    from terrapulse.operators.quality import department_coverage

    rows = D.read(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("dept"),
        (F.col("c_acctbal") > 0).alias("eligible"),
        F.col("c_custkey").cast("double").alias("surface_libre_m2"),
        F.col("c_acctbal").alias("surface_m2"),
    )
    return department_coverage(rows)
