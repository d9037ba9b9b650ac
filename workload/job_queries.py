"""Proximity joins in the siting shape, and the user-level jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import hexgrid as H
from terrapulse.functions import scoring as S
from terrapulse.functions import text as T
from terrapulse.operators import mesh as M
from terrapulse.operators import overlay as OV
from terrapulse.operators import quality as Q
from terrapulse.operators import raster as R
from terrapulse.operators import spatial as SP
from terrapulse.plans import areas as AR
from terrapulse.plans import burning as BU
from terrapulse.plans import commune_analysis as CA
from terrapulse.plans import interface as IF
from terrapulse.plans import priority_mesh as PM
from terrapulse.plans import reports as RE
from terrapulse.plans import siting as SI
from terrapulse.plans import supplier_risk as SR
from terrapulse.plans import vacancy as VA
from terrapulse.session import checkpoint_root
from terrapulse.sources import store as ST
from workload import spatial_queries as SQ
from workload import standins as D
from workload.registry import query, r
from workload.spatial_queries import EDGE8, EDGE9, INSTALL, apart, hex_sql
from workload.standins import gap, meets, point_gap, with_


def staged_parcels(spark, sf):
    return SI.stage_polygons(D.parcels(spark, sf).drop("geom"))


@query(
    "jn01_intersects_join",
    with_("parcels", "buildings")
    + f"SELECT p.id_parcelle, b.id_batiment FROM parcels p JOIN buildings b ON {meets('p', 'b')}",
)
def intersects_join(spark, sf):
    right = D.buildings(spark, sf).select("id_batiment", F.col("geom").alias("bgeom"))
    left = D.parcels(spark, sf).select("id_parcelle", "geom")
    pairs = SP.intersecting_pairs(left, right, "geom", "bgeom", 100.0, ("id_parcelle", "id_batiment"))
    return pairs.select("id_parcelle", "id_batiment")


PARCEL_HEX = hex_sql("parcels", "((minx + maxx) / 2)", "((miny + maxy) / 2)", EDGE9)


@query(
    "jn02_nearest_in_disk",
    with_(
        "parcels", "energy", ph=PARCEL_HEX, eh=hex_sql("energy", "px", "py", EDGE9),
        cand=f"""SELECT id_parcelle, puissance_disponible_kva AS kva, id_poste_source AS i,
        {point_gap('ph', 'eh')} AS d FROM ph JOIN eh ON {apart('ph', 'eh')} <= 2""",
    )
    + """SELECT id_parcelle, arg_min(kva, (d, i)) AS puissance_dispo_kva, round(min(d), 6) AS dist_poste_m
        FROM cand GROUP BY 1""",
)
def nearest_in_disk(spark, sf):
    found = SP.nearest_in_disk(
        staged_parcels(spark, sf), SI.stage_points(D.energy(spark, sf)), "id_parcelle",
        "id_poste_source", ["puissance_disponible_kva"], 2, EDGE9,
    )
    return found.select(
        "id_parcelle", F.col("puissance_disponible_kva").alias("puissance_dispo_kva"),
        r("d").alias("dist_poste_m"),
    )


@query(
    "jn03_within_distance_exists",
    with_("parcels", "solar")
    + f"""SELECT p.id_parcelle, CASE WHEN EXISTS (SELECT 1 FROM solar v WHERE
        {point_gap('p', 'v')} <= 60) THEN 5 ELSE 0 END::DOUBLE AS bonus_pv FROM parcels p""",
)
def within_distance_exists(spark, sf):
    flagged = SI.near_flag(D.parcels(spark, sf), D.solar(spark, sf), 60.0, "near_pv")
    bonus = F.when(F.col("near_pv"), F.lit(S.BONUS)).otherwise(F.lit(0.0))
    return flagged.select("id_parcelle", bonus.alias("bonus_pv"))


CLIP = (300.0, 200.0, 900.0, 700.0)


@query(
    "jn04_area_restriction",
    with_("parcels")
    + f"""SELECT id_parcelle FROM parcels WHERE minx <= {CLIP[2]} AND maxx >= {CLIP[0]}
        AND miny <= {CLIP[3]} AND maxy >= {CLIP[1]}""",
)
def area_restriction(spark, sf):
    return D.parcels(spark, sf).where(SP.in_box("geom", *CLIP)).select("id_parcelle")


@query(
    "jn05_communes_in_area",
    with_("parcels", "woods", "flood")
    + f"""SELECT 'P' || id_parcelle AS code FROM parcels p WHERE EXISTS (SELECT 1 FROM flood f
        WHERE {meets('p', 'f')}) UNION ALL SELECT 'W' || id_ebc FROM woods p
        WHERE EXISTS (SELECT 1 FROM flood f WHERE {meets('p', 'f')})""",
)
def communes_in_area(spark, sf):
    named = lambda df, p, k: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("code"), F.lit(p).alias("nom"), "geom")
    departments = {
        "07": named(D.parcels(spark, sf), "P", "id_parcelle"),
        "26": named(D.woods(spark, sf), "W", "id_ebc"),
    }
    return AR.communes_in_area(departments, D.flood_zones(spark, sf), 200.0).select("code")


@query(
    "jn06_unbounded_min_distance",
    with_("parcels", "hta")
    + f"SELECT p.id_parcelle, round(min({gap('p', 'h')}), 6) AS dist_hta_m FROM parcels p, hta h GROUP BY 1",
)
def unbounded_min_distance(spark, sf):
    found = SI.line_distance(D.parcels(spark, sf), D.power_lines(spark, sf), "id_hta", 50.0)
    return found.select("id_parcelle", r("d").alias("dist_hta_m"))


def pro_buildings(spark, sf):
    rows = D.buildings(spark, sf).withColumnRenamed("id_batiment", "id_bati")
    return rows.where(T.is_professional(rows))


PRO = """SELECT * FROM buildings WHERE usage_1 IN ('Commercial et services', 'Industriel')
    OR coalesce(usage_2 = 'Industriel', false)"""
COUNTED = f"""SELECT b.id_batiment AS id_bati, b.usage_1, b.commune, (maxx - minx) * (maxy - miny) AS area,
    count(e.siret) AS nb
    FROM pro b LEFT JOIN establishments e ON {point_gap('b', 'e')} <= 15 GROUP BY ALL"""
LISTED = f"""SELECT DISTINCT b.id_batiment AS id_bati, e.siret FROM pro b JOIN establishments e
    ON {point_gap('b', 'e')} <= 15"""


@query(
    "jn07_establishments_in_buffer",
    with_("buildings", "establishments", pro=PRO, c=COUNTED, l=LISTED)
    + "SELECT c.id_bati, nb AS nb_etab_actifs, siret FROM c LEFT JOIN l ON l.id_bati = c.id_bati",
)
def establishments_in_buffer(spark, sf):
    buildings = pro_buildings(spark, sf)
    attached = VA.attach(buildings, D.establishments(spark, sf), 15.0)
    counted = VA.count_establishments(buildings, attached).select("id_bati", "nb_etab_actifs")
    return counted.join(attached, "id_bati", "left").select("id_bati", "nb_etab_actifs", "siret")


@query(
    "jn08_clip_by_representative_point",
    with_("buildings", "flood")
    + """SELECT id_batiment AS id_bati FROM buildings b WHERE EXISTS (SELECT 1 FROM flood f WHERE
        (b.minx + b.maxx) / 2 BETWEEN f.minx AND f.maxx AND (b.miny + b.maxy) / 2 BETWEEN f.miny AND f.maxy)""",
)
def clip_by_representative_point(spark, sf):
    buildings = D.buildings(spark, sf).withColumnRenamed("id_batiment", "id_bati")
    return VA.clip_by_point(buildings, D.flood_zones(spark, sf), 200.0).select("id_bati")


@query(
    "jn09_points_near_area",
    with_("establishments", "flood")
    + f"""SELECT siret FROM establishments e WHERE EXISTS (SELECT 1 FROM flood f
        WHERE {point_gap('f', 'e')} <= 15)""",
)
def points_near_area(spark, sf):
    return VA.points_near(D.establishments(spark, sf), D.flood_zones(spark, sf), 15.0).select("siret")


VIOLATIONS = f"""SELECT id_parcelle FROM parcels p JOIN monuments m ON {point_gap('p', 'm')} <= 500
    UNION SELECT id_parcelle FROM parcels p JOIN flood f ON {meets('p', 'f')}
    UNION SELECT id_parcelle FROM parcels p JOIN woods w ON {meets('p', 'w')}"""


def violating(spark, sf):
    return SI.regulatory_violations(
        D.parcels(spark, sf), D.monuments(spark, sf), D.flood_zones(spark, sf), D.woods(spark, sf)
    )


@query(
    "jn10_exclusion_anti_join",
    with_("parcels", "monuments", "flood", "woods", v=VIOLATIONS)
    + "SELECT id_parcelle FROM parcels WHERE id_parcelle NOT IN (SELECT id_parcelle FROM v)",
)
def exclusion_anti_join(spark, sf):
    kept = SP.drop_matched(D.parcels(spark, sf), violating(spark, sf), "id_parcelle")
    return kept.select("id_parcelle")


@query(
    "jn11_membership_flag",
    with_("parcels", "woods")
    + f"""SELECT id_parcelle, EXISTS (SELECT 1 FROM woods w WHERE {meets('p', 'w')}) AS dans_ebc
        FROM parcels p""",
)
def membership_flag(spark, sf):
    parcels = D.parcels(spark, sf).select("id_parcelle", "geom")
    met = SP.touching(parcels, D.woods(spark, sf), "id_parcelle", "geom", "geom", 100.0)
    return SP.flag_matched(parcels, met, "id_parcelle", "dans_ebc").select("id_parcelle", "dans_ebc")


SURFACE = f"""SELECT p.id_parcelle, p.minx, p.miny, p.maxx, p.maxy, (p.maxx - p.minx) * (p.maxy - p.miny) AS area,
    coalesce(any_value(c.n), 0) AS n, coalesce(any_value(c.resid), 0) AS resid,
    coalesce(any_value(c.block), 0) AS block, coalesce(any_value(c.m), 0) AS emprise
    FROM parcels p LEFT JOIN (SELECT p.id_parcelle, count(*) AS n,
    count(*) FILTER (WHERE usage = 'Résidentiel' AND sous_type <> 'Immeuble') AS resid,
    count(*) FILTER (WHERE sous_type = 'Immeuble') AS block, sum({SQ.OVERLAP}) AS m
    FROM parcels p JOIN buildings b ON {meets('p', 'b')} GROUP BY 1) c ON c.id_parcelle = p.id_parcelle
    GROUP BY p.id_parcelle, p.minx, p.miny, p.maxx, p.maxy"""


@query(
    "jn12_free_surface",
    with_("parcels", "buildings", s=SURFACE)
    + """SELECT id_parcelle, resid AS count_resid, block AS count_immeuble,
        round(emprise, 6)::DOUBLE AS emprise_m2, round(area - emprise, 6) AS surface_libre_m2 FROM s""",
)
def free_surface(spark, sf):
    out = SI.free_surface(staged_parcels(spark, sf), SQ.parcel_pairs(spark, sf))
    return out.select(
        "id_parcelle", "count_resid", "count_immeuble", r("emprise_m2").alias("emprise_m2"),
        r("surface_libre_m2").alias("surface_libre_m2"),
    )


@query(
    "ag16_building_counts",
    with_("parcels", "buildings", s=SURFACE)
    + """SELECT id_parcelle, n AS count_batiments, resid AS count_resid, block AS count_immeuble,
        round(emprise, 6)::DOUBLE AS emprise_m2 FROM s WHERE n > 0""",
)
def building_counts(spark, sf):
    out = SI.free_surface(staged_parcels(spark, sf), SQ.parcel_pairs(spark, sf))
    return out.where(F.col("count_batiments") > 0).select(
        "id_parcelle", "count_batiments", "count_resid", "count_immeuble",
        r("emprise_m2").alias("emprise_m2"),
    )


BROWNING = {
    "p": hex_sql("fibre", "px", "py", 50.0),
    "e": hex_sql("establishments", "px", "py", 50.0),
    "g": """SELECT q, r, avg(CASE WHEN id_locale % 11 > 0 THEN (id_locale % 40 - 22) / 1000.0::DOUBLE END)
        AS s FROM p GROUP BY 1, 2""",
    "deg": """SELECT q, r, CASE WHEN s IS NULL THEN 0 ELSE least(greatest(-s / 0.01, 0), 1) END::DOUBLE
        AS degradation FROM g""",
}


def browning(spark, sf):
    k = F.col("id_locale")
    slope = F.when(k % 11 > 0, (k % 40 - 22) / F.lit(1000.0))
    pixels = D.fibre(spark, sf).select("px", "py", slope.alias("sen_slope"))
    return M.browning_by_cell(pixels, H.cell_of("px", "py", 50.0))


@query(
    "ag09_zonal_mean_by_hexagon",
    with_("fibre", "establishments", **BROWNING)
    + "SELECT q, r, round(degradation, 6) AS degradation FROM deg",
)
def zonal_mean_by_hexagon(spark, sf):
    return browning(spark, sf).select("cell.q", "cell.r", r("degradation").alias("degradation"))


@query(
    "jn18_label_join",
    with_("fibre", "establishments", **BROWNING)
    + """SELECT siret, round(coalesce(degradation, 0), 6) AS degradation
        FROM e LEFT JOIN deg ON deg.q = e.q AND deg.r = e.r""",
)
def label_join(spark, sf):
    cell = H.cell_of("px", "py", 50.0)
    spots = D.establishments(spark, sf).select("siret", cell.alias("cell"))
    joined = spots.join(browning(spark, sf), "cell", "left")
    return joined.select("siret", r(F.coalesce("degradation", F.lit(0.0))).alias("degradation"))


@query(
    "jn19_violation_joins",
    with_("parcels", "monuments", "flood", "woods")
    + f"""SELECT id_parcelle, 'abf' AS kind FROM parcels p WHERE EXISTS (SELECT 1 FROM monuments m
        WHERE {point_gap('p', 'm')} <= 500)
        UNION ALL SELECT id_parcelle, 'ppri' FROM parcels p WHERE EXISTS (SELECT 1 FROM flood f WHERE {meets('p', 'f')})
        UNION ALL SELECT id_parcelle, 'ebc' FROM parcels p WHERE EXISTS (SELECT 1 FROM woods w WHERE {meets('p', 'w')})""",
)
def violation_joins(spark, sf):
    none = lambda df: df.where(F.lit(False))
    layers = [D.monuments(spark, sf), D.flood_zones(spark, sf), D.woods(spark, sf)]
    out = None
    for i, kind in enumerate(("abf", "ppri", "ebc")):
        only = [df if j == i else none(df) for j, df in enumerate(layers)]
        found = SI.regulatory_violations(D.parcels(spark, sf), *only)
        named = found.select("id_parcelle", F.lit(kind).alias("kind"))
        out = named if out is None else out.unionByName(named)
    return out


@query(
    "so01_distinct_violations",
    with_("parcels", "monuments", "flood", "woods", v=VIOLATIONS) + "SELECT id_parcelle FROM v",
)
def distinct_violations(spark, sf):
    return violating(spark, sf)


# --- site selection -----------------------------------------------------------

SITING = {
    "s": SURFACE,
    "f1": "SELECT *, area - emprise AS libre FROM s WHERE resid > 0 AND block = 0 AND area - emprise > 50",
    **{k: q for k, q in INSTALL.items()},
    "bd": f"""SELECT z.id_parcelle, min(sqrt(pow(greatest(f.x0 - install_x, install_x - f.x1, 0), 2)
        + pow(greatest(f.y0 - install_y, install_y - f.y1, 0), 2))) AS dist_bati
        FROM install z JOIN foot f ON f.id_parcelle = z.id_parcelle GROUP BY 1""",
    "f2": f"""SELECT f1.*, z.install_m2, b.dist_bati, (SELECT min({gap('f1', 'v')}) FROM roads v) AS dist_voirie
        FROM f1 JOIN install z ON z.id_parcelle = f1.id_parcelle JOIN bd b ON b.id_parcelle = f1.id_parcelle
        WHERE z.install_m2 >= 4 AND b.dist_bati <= 15""",
    "h2": hex_sql("f2", "((minx + maxx) / 2)", "((miny + maxy) / 2)", EDGE9),
    "hf": hex_sql("fibre", "px", "py", EDGE9),
    "he": hex_sql("energy", "px", "py", EDGE9),
    "nf": f"""SELECT id_parcelle, arg_min(statut_deploiement, (d, id_locale)) AS statut FROM (
        SELECT h2.id_parcelle, statut_deploiement, id_locale, {point_gap('h2', 'hf')} AS d
        FROM h2 JOIN hf ON {apart('h2', 'hf')} <= 6) GROUP BY 1""",
    "f3": "SELECT h2.*, statut FROM h2 JOIN nf ON nf.id_parcelle = h2.id_parcelle WHERE statut IN ('Déployé', 'Raccordable')",
    "ne": f"""SELECT id_parcelle, arg_min(kva, (d, i)) AS kva, min(d) AS dist_poste FROM (
        SELECT f3.id_parcelle, puissance_disponible_kva AS kva, id_poste_source AS i, {point_gap('f3', 'he')} AS d
        FROM f3 JOIN he ON {apart('f3', 'he')} <= 12) GROUP BY 1""",
    "f4": "SELECT f3.*, ne.kva, ne.dist_poste FROM f3 JOIN ne ON ne.id_parcelle = f3.id_parcelle WHERE ne.kva >= 36",
    "f5": f"""SELECT * FROM f4 p WHERE NOT EXISTS (SELECT 1 FROM monuments m WHERE {point_gap('p', 'm')} <= 500)
        AND NOT EXISTS (SELECT 1 FROM flood f WHERE {meets('p', 'f')})
        AND NOT EXISTS (SELECT 1 FROM woods w WHERE {meets('p', 'w')})""",
    "sc": f"""SELECT *, least(libre / 400 * 20, 20) AS s1, least(8 * least(install_m2 / 40, 1) + 8
        + CASE WHEN dist_voirie <= 30 THEN 4 ELSE 0 END, 20) AS s2,
        CASE statut WHEN 'Déployé' THEN 20 ELSE 12 END AS s3,
        least(10 + 10 * least((kva - 36) / 36, 1), 20) AS s4,
        CASE WHEN EXISTS (SELECT 1 FROM solar v WHERE {point_gap('f5', 'v')} <= 250) THEN 5 ELSE 0 END AS b1,
        CASE WHEN EXISTS (SELECT 1 FROM chargers v WHERE {point_gap('f5', 'v')} <= 250) THEN 5 ELSE 0 END AS b2,
        CASE WHEN dist_poste <= 300 THEN 5 ELSE 0 END AS b3 FROM f5""",
    "el": """SELECT *, least(round(s1 + s2 + s3 + s4 + 20 + b1 + b2 + b3, 1), 100)::DOUBLE AS score_total,
        CASE WHEN s1 + s2 + s3 + s4 + 20 + b1 + b2 + b3 >= 90 THEN 'Premium'
        WHEN s1 + s2 + s3 + s4 + 20 + b1 + b2 + b3 >= 70 THEN 'Bon' ELSE 'Moyen' END AS classe FROM sc""",
    "elh": hex_sql("(SELECT * EXCLUDE (q, r) FROM el)", "((minx + maxx) / 2)", "((miny + maxy) / 2)", EDGE8),
    "qa": """SELECT s.id_parcelle, f1.id_parcelle IS NOT NULL AS pass_01, f2.id_parcelle IS NOT NULL AS pass_02,
        f3.id_parcelle IS NOT NULL AS pass_03, f4.id_parcelle IS NOT NULL AS pass_04,
        el.id_parcelle IS NOT NULL AS pass_05, el.id_parcelle IS NOT NULL AS eligible, el.classe,
        CASE WHEN f1.id_parcelle IS NULL THEN '1-Foncier' WHEN f2.id_parcelle IS NULL THEN '2-Nuisances'
        WHEN f3.id_parcelle IS NULL THEN '3-Fibre' WHEN f4.id_parcelle IS NULL THEN '4-Energie'
        WHEN el.id_parcelle IS NULL THEN '5-Reglementaire' ELSE '0-Eligible' END AS etape_rejet
        FROM s LEFT JOIN f1 ON f1.id_parcelle = s.id_parcelle LEFT JOIN f2 ON f2.id_parcelle = s.id_parcelle
        LEFT JOIN f3 ON f3.id_parcelle = s.id_parcelle LEFT JOIN f4 ON f4.id_parcelle = s.id_parcelle
        LEFT JOIN el ON el.id_parcelle = s.id_parcelle""",
}
LAYERS = ("parcels", "buildings", "fibre", "energy", "chargers", "solar", "monuments", "flood", "woods", "roads")


def siting_sql(select: str) -> str:
    return with_(*LAYERS, **SITING) + select


_FUNNELS: dict = {}


def funnel(spark, sf):
    """The funnel of the stand-in layers; its tables are checkpointed, so one run serves all reports."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FUNNELS:
        drop = lambda df: df.drop("geom", "minx", "miny", "maxx", "maxy")
        parcels = drop(D.parcels(spark, sf)).withColumns(
            {"dept": F.lit("07"), "commune_insee": F.col("commune").cast("string")}
        )
        _FUNNELS[key] = SI.run(
            SI.Layers(
                parcels, drop(D.buildings(spark, sf)), D.fibre(spark, sf), D.energy(spark, sf),
                D.chargers(spark, sf), D.solar(spark, sf), D.monuments(spark, sf),
                drop(D.flood_zones(spark, sf)), drop(D.woods(spark, sf)), D.roads(spark, sf),
            )
        )
    return _FUNNELS[key]


@query(
    "job02_site_selection",
    siting_sql(
        """SELECT id_parcelle, round(s1, 1)::DOUBLE AS score_foncier, round(s2, 1)::DOUBLE AS score_nuisances,
        s3::DOUBLE AS score_fibre, round(s4, 1)::DOUBLE AS score_energie, b1::DOUBLE AS bonus_pv,
        b2::DOUBLE AS bonus_ve, b3::DOUBLE AS bonus_poste, score_total, classe FROM el"""
    ),
)
def site_selection(spark, sf):
    _FUNNELS.clear()
    return funnel(spark, sf).eligible.select(
        "id_parcelle", "score_foncier", "score_nuisances", "score_fibre", "score_energie",
        "bonus_pv", "bonus_ve", "bonus_poste", "score_total", "classe",
    )


@query(
    "ag17_heatmap",
    siting_sql(
        """SELECT q, r, count(*) AS count_eligibles, count(*) FILTER (WHERE classe = 'Premium') AS count_premium,
        count(*) FILTER (WHERE classe = 'Bon') AS count_bon, count(*) FILTER (WHERE classe = 'Moyen') AS count_moyen,
        max(score_total) AS max_score,
        round(100.0::DOUBLE * count(*) FILTER (WHERE classe = 'Premium') / count(*), 1) AS pct_premium,
        CASE WHEN count(*) FILTER (WHERE classe = 'Premium') >= 5 THEN 'Tier1' WHEN count(*) >= 5 THEN 'Tier2'
        ELSE 'Tier3' END AS priorite_deploiement FROM elh GROUP BY 1, 2"""
    ),
)
def heatmap(spark, sf):
    return funnel(spark, sf).heatmap.select(
        "h3_res8.q", "h3_res8.r", "count_eligibles", "count_premium", "count_bon", "count_moyen",
        "max_score", "pct_premium", "priorite_deploiement",
    )


@query(
    "jn13_funnel_audit",
    siting_sql("SELECT id_parcelle, pass_01, pass_02, pass_03, pass_04, pass_05, eligible, classe, etape_rejet FROM qa"),
)
def funnel_audit(spark, sf):
    return funnel(spark, sf).audit.select(
        "id_parcelle", "pass_01", "pass_02", "pass_03", "pass_04", "pass_05", "eligible", "classe",
        "etape_rejet",
    )


PASSES = ["pass_01", "pass_02", "pass_03", "pass_04", "pass_05"]


@query(
    "ag19_funnel_retention",
    siting_sql(
        """SELECT step, n, round(100.0::DOUBLE * n / (SELECT count(*) FROM qa), 6) AS pct FROM (
        SELECT 'n_base' AS step, count(*) AS n FROM qa """
        + " ".join(
            f"UNION ALL SELECT 'n_{p}', count(*) FILTER (WHERE {p}) FROM qa" for p in PASSES
        )
        + ")"
    ),
)
def funnel_retention(spark, sf):
    counts = Q.funnel_counts(funnel(spark, sf).audit, PASSES)
    return RE.funnel_retention(counts).select("step", "n", r("pct").alias("pct"))


@query("dq01_unique_ids", siting_sql("SELECT count(*) - count(DISTINCT id_parcelle) AS violations FROM el"))
def unique_ids(spark, sf):
    return Q.duplicate_ids(funnel(spark, sf).eligible, "id_parcelle")


@query("dq02_valid_geometry", with_("parcels") + "SELECT count(*) FILTER (WHERE maxx <= minx) AS violations FROM parcels")
def valid_geometry(spark, sf):
    return Q.violations(D.parcels(spark, sf), ~G.is_valid("ring"))


@query(
    "dq03_score_range",
    siting_sql("SELECT count(*) FILTER (WHERE score_total < 0 OR score_total > 100) AS violations FROM el"),
)
def score_range(spark, sf):
    return Q.violations(funnel(spark, sf).eligible, Q.score_out_of_range(F.col("score_total")))


@query(
    "dq04_class_consistency",
    siting_sql(
        """SELECT count(*) FILTER (WHERE (classe = 'Premium' AND score_total < 90) OR (classe = 'Bon'
        AND (score_total < 70 OR score_total >= 90)) OR (classe = 'Moyen' AND score_total >= 70))
        AS violations FROM el"""
    ),
)
def class_consistency(spark, sf):
    broken = Q.class_mismatch(F.col("classe"), F.col("score_total"))
    return Q.violations(funnel(spark, sf).eligible, broken)


@query(
    "dq05_funnel_decreasing",
    siting_sql(
        """SELECT count(*) >= count(*) FILTER (WHERE pass_01) AND count(*) FILTER (WHERE pass_01)
        >= count(*) FILTER (WHERE pass_02) AND count(*) FILTER (WHERE pass_02) >= count(*) FILTER (WHERE pass_03)
        AND count(*) FILTER (WHERE pass_03) >= count(*) FILTER (WHERE pass_04)
        AND count(*) FILTER (WHERE pass_04) >= count(*) FILTER (WHERE pass_05) AS ok FROM qa"""
    ),
)
def funnel_decreasing(spark, sf):
    return Q.funnel_is_decreasing(Q.funnel_counts(funnel(spark, sf).audit, PASSES))


@query(
    "dq06_heatmap_total",
    siting_sql(
        """SELECT (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM elh GROUP BY q, r))
        - (SELECT count(*) FROM el) AS violations"""
    ),
)
def heatmap_total(spark, sf):
    run = funnel(spark, sf)
    return Q.heatmap_gap(run.heatmap, run.eligible)


@query(
    "dq07_no_eligible_in_forbidden_zone",
    siting_sql(
        f"""SELECT count(*) AS violations FROM el p WHERE EXISTS (SELECT 1 FROM monuments m
        WHERE {point_gap('p', 'm')} <= 500) OR EXISTS (SELECT 1 FROM flood f WHERE {meets('p', 'f')})
        OR EXISTS (SELECT 1 FROM woods w WHERE {meets('p', 'w')})"""
    ),
)
def no_eligible_in_forbidden_zone(spark, sf):
    broken = SI.regulatory_violations(
        funnel(spark, sf).eligible, D.monuments(spark, sf), D.flood_zones(spark, sf), D.woods(spark, sf)
    )
    return broken.agg(F.count(F.lit(1)).alias("violations"))


@query("dq08_some_eligible", siting_sql("SELECT count(*) > 0 AS ok FROM el"))
def some_eligible(spark, sf):
    return Q.at_least_one(funnel(spark, sf).eligible)


@query(
    "src20_ranked_export",
    siting_sql(
        "SELECT id_parcelle, score_total, classe FROM el ORDER BY score_total DESC, id_parcelle LIMIT 20"
    ),
)
def ranked_export(spark, sf):
    folder = f"{checkpoint_root(spark)}/ranked-{uuid.uuid4().hex}"
    out = ST.export_ranked(funnel(spark, sf).eligible, folder, "score_total", "id_parcelle")
    top = spark.read.csv(out["top.csv"], header=True, schema=None)
    ids = {
        "ranked.parquet": spark.read.parquet(out["ranked.parquet"]).select("id_parcelle"),
        "ranked.csv": spark.read.csv(out["ranked.csv"], header=True).select("id_parcelle"),
        "features.json": spark.read.json(out["features.json"]).select("properties.id_parcelle"),
    }
    # The other outputs hold every eligible row, each once.
    whole = ids["ranked.parquet"].agg(F.count("*").alias("n"), F.sum("id_parcelle").alias("s"))
    for other in ("ranked.csv", "features.json"):
        same = ids[other].agg(F.count("*").alias("n"), F.sum(F.col("id_parcelle").cast("bigint")).alias("s"))
        whole = whole.join(same, ["n", "s"], "left_semi")
    shown = top.select(
        F.col("id_parcelle").cast("bigint").alias("id_parcelle"),
        F.col("score_total").cast("double").alias("score_total"),
        "classe",
    )
    held = whole.agg(F.count("*").alias("held")).scalar()
    return shown.where(held == 1)


@query(
    "src21_control_layers",
    siting_sql(
        """SELECT 'parcelles_qa' AS layer, (SELECT count(*) FROM parcels) AS n
        UNION ALL SELECT 'contrainte_abf_500m', count(*) FROM monuments UNION ALL SELECT 'contrainte_ppri', count(*) FROM flood
        UNION ALL SELECT 'contrainte_ebc', count(*) FROM woods UNION ALL SELECT 'reseau_fibre', count(*) FROM fibre
        UNION ALL SELECT 'reseau_energie', count(*) FROM energy UNION ALL SELECT 'reseau_voirie', count(*) FROM roads
        UNION ALL SELECT 'batiments', count(*) FROM buildings"""
    ),
)
def control_layers(spark, sf):
    run = funnel(spark, sf)
    folder = f"{checkpoint_root(spark)}/control-{uuid.uuid4().hex}"
    layers = {
        "parcelles_qa": run.audit, "contrainte_abf_500m": D.monuments(spark, sf),
        "contrainte_ppri": D.flood_zones(spark, sf), "contrainte_ebc": D.woods(spark, sf),
        "reseau_fibre": D.fibre(spark, sf), "reseau_energie": D.energy(spark, sf),
        "reseau_voirie": D.roads(spark, sf), "batiments": D.buildings(spark, sf),
    }
    out = None
    for name, path in ST.export_layers(layers, folder).items():
        counted = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
        row = counted.select(F.lit(name).alias("layer"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# --- multi-axis commune analysis ------------------------------------------------

COMMUNE = {
    "cs": f"""SELECT p.id_parcelle, p.minx, p.miny, p.maxx, p.maxy, (p.maxx - p.minx) * (p.maxy - p.miny) AS area,
        count(b.id_batiment) FILTER (WHERE usage = 'Résidentiel' AND sous_type <> 'Immeuble') AS resid,
        count(b.id_batiment) FILTER (WHERE usage = 'Résidentiel' AND sous_type = 'Immeuble') AS block,
        coalesce(sum({SQ.OVERLAP}), 0) AS emprise FROM parcels p LEFT JOIN buildings b ON {meets('p', 'b')}
        GROUP BY 1, 2, 3, 4, 5""",
    **INSTALL,
    "cb": f"""SELECT z.id_parcelle, z.install_m2, CASE WHEN count(f.x0) > 0 THEN
        min(sqrt(pow(greatest(f.x0 - install_x, install_x - f.x1, 0), 2)
        + pow(greatest(f.y0 - install_y, install_y - f.y1, 0), 2))) ELSE 0 END AS dist_bati
        FROM install z LEFT JOIN foot f ON f.id_parcelle = z.id_parcelle GROUP BY 1, 2""",
    "ch": hex_sql("cs", "((minx + maxx) / 2)", "((miny + maxy) / 2)", EDGE9),
    "cf": hex_sql("fibre", "px", "py", EDGE9),
    "cn": f"""SELECT id_parcelle, arg_min(s, (d, i)) AS statut FROM (SELECT ch.id_parcelle,
        statut_deploiement AS s, id_locale AS i, {point_gap('ch', 'cf')} AS d FROM ch JOIN cf
        ON {apart('ch', 'cf')} <= 12) GROUP BY 1""",
    "cev": f"""SELECT ch.*, area - emprise AS libre, install_m2, dist_bati, statut,
        (SELECT min({gap('ch', 'h')}) FROM hta h) AS hta,
        EXISTS (SELECT 1 FROM woods w WHERE {meets('ch', 'w')}) AS ebc
        FROM ch JOIN cb ON cb.id_parcelle = ch.id_parcelle LEFT JOIN cn ON cn.id_parcelle = ch.id_parcelle""",
    "cg": """SELECT *, (resid > 0 AND block = 0 AND libre > 50) AS g1, (install_m2 >= 4 AND dist_bati <= 15) AS g2,
        statut IN ('Déployé', 'Raccordable') AS g3, hta <= 150 AS g4, NOT ebc AS g5,
        20 * least(libre / 400, 1) AS s1,
        least(10 * least(install_m2 / 40, 1) + CASE WHEN dist_bati <= 15 THEN 10 ELSE 0 END, 20) AS s2,
        CASE statut WHEN 'Déployé' THEN 20 WHEN 'Raccordable' THEN 12 ELSE 0 END AS s3,
        20 * greatest((150 - hta) / 150, 0) AS s4, CASE WHEN ebc THEN 0 ELSE 20 END AS s5 FROM cev""",
    "cqa": """SELECT *, (g1 AND g2 AND g3 AND g4 AND g5) AS eligible,
        least(round(s1 + s2 + s3 + s4 + s5, 1), 100)::DOUBLE AS indice,
        CASE WHEN NOT g1 THEN '1-Foncier' WHEN NOT g2 THEN '2-Nuisances' WHEN NOT g3 THEN '3-Fibre'
        WHEN NOT g4 THEN '4-Energie (HTA)' WHEN NOT g5 THEN '5-EBC' ELSE '0-Candidate' END AS etape_rejet,
        CASE WHEN NOT (g1 AND g2 AND g3 AND g4 AND g5) THEN NULL WHEN s1 + s2 + s3 + s4 + s5 >= 80
        THEN 'Premium' WHEN s1 + s2 + s3 + s4 + s5 >= 60 THEN 'Bon' ELSE 'Moyen' END AS classe FROM cg""",
    "cqh": hex_sql("(SELECT * EXCLUDE (q, r) FROM cqa)", "((minx + maxx) / 2)", "((miny + maxy) / 2)", EDGE8),
}
COMMUNE_LAYERS = ("parcels", "buildings", "fibre", "hta", "woods")


def analysed(spark, sf):
    drop = lambda df: df.drop("geom", "minx", "miny", "maxx", "maxy")
    flags = drop(D.buildings(spark, sf)).withColumns(
        {
            "est_residentiel": F.col("usage") == SI.RESIDENTIAL,
            "est_immeuble": F.col("sous_type") == "Immeuble",
        }
    )
    return CA.run(
        drop(D.parcels(spark, sf)), flags, D.fibre(spark, sf), D.power_lines(spark, sf),
        drop(D.woods(spark, sf)),
    )


@query(
    "job03_commune_analysis",
    with_(*COMMUNE_LAYERS, **COMMUNE)
    + """SELECT id_parcelle, g1 AS pass_foncier, g2 AS pass_nuisances, g3 AS pass_fibre, g4 AS pass_energie,
        g5 AS pass_reglement, eligible, etape_rejet, classe FROM cqa""",
)
def commune_analysis(spark, sf):
    return analysed(spark, sf).select(
        "id_parcelle", "pass_foncier", "pass_nuisances", "pass_fibre", "pass_energie",
        "pass_reglement", "eligible", "etape_rejet", "classe",
    )


@query(
    "ag18_candidate_heatmap",
    with_(*COMMUNE_LAYERS, **COMMUNE)
    + """SELECT q, r, count(*) FILTER (WHERE eligible) AS nb_candidats,
        count(*) FILTER (WHERE classe = 'Premium') AS nb_premium FROM cqh GROUP BY 1, 2
        HAVING count(*) FILTER (WHERE eligible) > 0""",
)
def candidate_heatmap(spark, sf):
    return CA.candidate_heatmap(analysed(spark, sf)).select(
        "h3_res8.q", "h3_res8.r", "nb_candidats", "nb_premium"
    )


# --- vacancy ---------------------------------------------------------------------

VACANCY = {
    "pro": PRO,
    "c": COUNTED,
    "v": "SELECT *, CASE WHEN nb = 0 THEN 'VACANT_CANDIDAT' ELSE 'OCCUPE' END AS statut FROM c",
}


def vacancy(spark, sf):
    buildings = D.buildings(spark, sf).withColumnRenamed("id_batiment", "id_bati")
    return VA.run(buildings, D.establishments(spark, sf), 15.0)


@query(
    "job04_vacant_buildings",
    with_("buildings", "establishments", **VACANCY, l=LISTED)
    + """SELECT v.id_bati, usage_1, round_even(area, 1) AS surface_bati_m2, nb AS nb_etab_actifs,
        siret, statut AS statut_occupation FROM v LEFT JOIN l ON l.id_bati = v.id_bati""",
)
def vacant_buildings(spark, sf):
    run = vacancy(spark, sf)
    return run.result.join(run.attachments, "id_bati", "left").select(
        "id_bati", "usage_1", "surface_bati_m2", "nb_etab_actifs", "siret", "statut_occupation"
    )


@query(
    "ag22_vacancy_summary",
    with_("buildings", "establishments", **VACANCY)
    + """SELECT count(*) AS nb_batiments_pro, count(*) FILTER (WHERE nb = 0) AS nb_candidats_vacants,
        round(100.0::DOUBLE * count(*) FILTER (WHERE nb = 0) / count(*), 1) AS taux_apparent_pct,
        round(sum(area) FILTER (WHERE nb = 0), 1) AS surface_vacante_m2 FROM v""",
)
def vacancy_summary(spark, sf):
    return vacancy(spark, sf).summary


@query(
    "ag23_buffer_sensitivity",
    with_(
        "buildings", "establishments", pro=PRO,
        m=f"""SELECT id_batiment, (maxx - minx) * (maxy - miny) AS area, min({point_gap('b', 'e')}) AS d
        FROM pro b, establishments e GROUP BY ALL""",
        bf="SELECT unnest([15.0, 25.0, 50.0, 100.0])::DOUBLE AS buffer_m",
    )
    + """SELECT buffer_m, count(*) FILTER (WHERE d > buffer_m) AS nb_candidats,
        round(100.0::DOUBLE * count(*) FILTER (WHERE d > buffer_m) / count(*), 1) AS taux_pct,
        count(*) FILTER (WHERE d > buffer_m AND area >= 200) AS nb_candidats_200m2 FROM m, bf GROUP BY 1""",
)
def buffer_sensitivity(spark, sf):
    distances = VA.nearest_distance(pro_buildings(spark, sf), D.establishments(spark, sf), 100.0)
    return VA.buffer_sensitivity(distances)


@query(
    "ag24_vacancy_by_commune",
    with_("buildings", "establishments", **VACANCY)
    + """SELECT commune, count(*) AS nb_batiments, count(*) FILTER (WHERE nb = 0) AS nb_candidats,
        round(100.0::DOUBLE * count(*) FILTER (WHERE nb = 0) / count(*), 1) AS taux_pct FROM v GROUP BY 1""",
)
def vacancy_by_commune(spark, sf):
    buildings = D.buildings(spark, sf).withColumnRenamed("id_batiment", "id_bati")
    communes = buildings.select("id_bati", F.col("commune").alias("code"))
    result = vacancy(spark, sf).result.join(communes, "id_bati")
    by_commune = VA.vacancy_by_commune(result, "code")
    return by_commune.withColumnRenamed("code", "commune")


# --- interface, burning, mesh, areas, suppliers -----------------------------------

JOB5_CONTACT = 20.0


def built_features(spark, sf):
    return D.buildings(spark, sf).select(F.col("id_batiment").alias("fid"), "geom")


@query(
    "job05_interface",
    with_(
        "woods", "buildings", **SQ.NEAR, **SQ.BAND,
        bc="""SELECT DISTINCT i, j FROM (SELECT i, unnest(generate_series(floor(miny)::BIGINT,
        floor(maxy)::BIGINT - 1)) AS j FROM (SELECT *, unnest(generate_series(floor(minx)::BIGINT,
        floor(maxx)::BIGINT - 1)) AS i FROM buildings))""",
    )
    + f"""SELECT {JOB5_CONTACT}::DOUBLE AS contact_m,
        (SELECT round(sum(b - a), 3) FROM rn WHERE b > a)::DOUBLE AS interface_length_m,
        (SELECT round(count(*) * {SQ.BAND_STEP * SQ.BAND_STEP} / 10000, 6) FROM cb)::DOUBLE AS interface_zone_ha,
        (SELECT round(count(*) / 10000.0, 6) FROM bc)::DOUBLE AS bati_area_ha""",
)
def interface(spark, sf):
    run = IF.run(
        SQ.wood_features(spark, sf), built_features(spark, sf), JOB5_CONTACT, step=SQ.BAND_STEP, cell=50.0
    )
    return run.metrics.select(
        "contact_m", r("interface_length_m", 3).alias("interface_length_m"),
        r("interface_zone_ha").alias("interface_zone_ha"), r("bati_area_ha").alias("bati_area_ha"),
    )


@query("job05_interface_in_area")
def interface_in_area(spark, sf):
    area = D.flood_zones(spark, sf).select("geom")
    run = IF.run(
        SQ.wood_features(spark, sf), built_features(spark, sf), JOB5_CONTACT, aoi=area, step=SQ.BAND_STEP,
        cell=50.0,
    )
    return run.metrics


def burning(spark, sf):
    cells = SQ.access_cells(spark, sf)
    slope = R.slope_percent(SQ.elevation(spark, sf), 75.0)
    k = F.col("c_custkey")
    trend = D.read(spark, sf, "customer").select(
        (k % 40).alias("col"), F.floor(k / 40).alias("row"),
        F.when(k % 5 > 0, k % 13 / F.lit(1000.0)).alias("value"),
    )
    return BU.run(
        cells, slope, SQ.sparse_roads(spark, sf), D.flood_zones(spark, sf), 50.0, trend=trend
    )


BURN = {
    **SQ.SLOPES,
    "sl": """SELECT col, row, coalesce(sqrt(pow(dx / nullif(rx, 0), 2) + pow(dy / nullif(ry, 0), 2)) * 100, 0)
        AS slope FROM g""",
    "rc": """SELECT DISTINCT j, unnest(generate_series(floor((px - 2200) / 50)::BIGINT,
        floor((px - 2140) / 50)::BIGINT)) AS i FROM (SELECT *, floor(py / 50)::BIGINT AS j FROM monuments)""",
    "cells": """SELECT c_custkey % 40 AS col, c_custkey // 40 AS row, (c_custkey % 40 + 0.5) * 50::DOUBLE AS px,
        (c_custkey // 40 + 0.5) * 50::DOUBLE AS py,
        coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 13 / 1000.0::DOUBLE END, 0) AS trend FROM customer""",
    "ac": """SELECT col, row, greatest(1 - sqrt(min(pow(col - i, 2) + pow(row - j, 2))) * 50 / 500, 0) AS access
        FROM cells, (SELECT rc.i, rc.j FROM rc JOIN cells c ON c.col = rc.i AND c.row = rc.j) t GROUP BY 1, 2""",
    "sc": f"""SELECT c.col, c.row, CASE WHEN EXISTS (SELECT 1 FROM flood f WHERE {point_gap('f', 'c')} <= 100)
        THEN 0 ELSE (greatest(least(least((slope - 5) / 10, 1), least((50 - slope) / 10, 1)), 0) * 20
        + access * 15 + least(trend / 0.01, 1) * 25) / 60 * 100 END::DOUBLE AS score
        FROM cells c JOIN sl ON sl.col = c.col AND sl.row = c.row JOIN ac ON ac.col = c.col AND ac.row = c.row""",
}


@query(
    "job06_burning_aptitude",
    with_("monuments", "flood", **BURN)
    + """SELECT col, row, round(score, 6) AS score, CASE WHEN score >= 66 THEN 2 WHEN score >= 33 THEN 1
        ELSE 0 END AS classe FROM sc""",
)
def burning_aptitude(spark, sf):
    return burning(spark, sf).cells.select("col", "row", r("score").alias("score"), "classe")


MESH9 = {
    k: q.replace(f"{SQ.MESH_EDGE * 1.5}", f"{EDGE9 * 1.5}")
    .replace(f"{SQ.MESH_EDGE * H.SQRT3!r}", f"{EDGE9 * H.SQRT3!r}")
    for k, q in SQ.MESH.items()
}
JOB7 = {
    **MESH9,
    "ws": """SELECT DISTINCT i, j FROM (SELECT *, unnest(generate_series(ceil(miny / 25.0 - 0.5)::BIGINT,
        ceil(maxy / 25.0 - 0.5)::BIGINT - 1)) AS j FROM (SELECT *, unnest(generate_series(
        ceil(minx / 25.0 - 0.5)::BIGINT, ceil(maxx / 25.0 - 0.5)::BIGINT - 1)) AS i FROM flood))""",
    "wp": "SELECT (i + 0.5) * 25::DOUBLE AS px, (j + 0.5) * 25::DOUBLE AS py FROM ws",
    "wh": hex_sql("wp", "px", "py", EDGE9),
    "cnt": "SELECT q, r, count(*) AS n FROM wh GROUP BY 1, 2",
    "near": f"SELECT q, r, min({point_gap('w', 'm')}) AS d FROM mesh m, flood w GROUP BY 1, 2",
    "tp": hex_sql("fibre", "px", "py", EDGE9),
    "tg": """SELECT q, r, least(greatest(-avg((id_locale % 40 - 24) / 1000.0::DOUBLE) / 0.01, 0), 1) AS deg
        FROM tp GROUP BY 1, 2""",
    "ax": f"""SELECT m.q, m.r, least(coalesce(n, 0) * {625.0 / (1.5 * H.SQRT3 * EDGE9 * EDGE9)!r}, 1) AS enjeu,
        greatest(least(1 - d / 2000, 1), 0) AS connectivite, coalesce(deg, 0) AS degradation
        FROM mesh m JOIN near e ON e.q = m.q AND e.r = m.r LEFT JOIN cnt c ON c.q = m.q AND c.r = m.r
        LEFT JOIN tg ON tg.q = m.q AND tg.r = m.r""",
    "sc": "SELECT *, pow(enjeu * connectivite * degradation, 1.0::DOUBLE / 3) * 100 AS score FROM ax",
}


def priority_mesh(spark, sf):
    k = F.col("id_locale")
    pixels = D.fibre(spark, sf).select(
        F.col("px").alias("x"), F.col("py").alias("y"), ((k % 40 - 24) / F.lit(1000.0)).alias("sen_slope")
    )
    zones = D.flood_zones(spark, sf).select(F.col("id_ppri").alias("fid"), "geom")
    return PM.run(SQ.parcel_area(spark, sf), zones, "aid", grain=9, trend_pixels=pixels)


@query(
    "job07_priority_mesh",
    with_("parcels", "flood", "fibre", **JOB7)
    + """SELECT q, r, round(enjeu, 6)::DOUBLE AS enjeu, round(connectivite, 6)::DOUBLE AS connectivite,
        round(degradation, 6)::DOUBLE AS degradation, round(score, 5)::DOUBLE AS score,
        CASE WHEN score >= 66 THEN 2 WHEN score >= 33 THEN 1 ELSE 0 END AS classe FROM sc""",
)
def priority_mesh_cells(spark, sf):
    return priority_mesh(spark, sf).mesh.select(
        "cell.q", "cell.r", r("enjeu").alias("enjeu"), r("connectivite").alias("connectivite"),
        r("degradation").alias("degradation"), r("score", 5).alias("score"), "classe",
    )


@query(
    "ag28_mesh_summary",
    with_("parcels", "flood", "fibre", **JOB7)
    + """SELECT count(*) AS n_hexagons, count(*) FILTER (WHERE score >= 66) AS n_prioritaire,
        count(*) FILTER (WHERE score >= 33 AND score < 66) AS n_a_etudier,
        (SELECT count(*) FROM flood) AS n_reservoirs, 'reservoir_proximity_proxy' AS connectivity_source
        FROM sc""",
)
def mesh_summary(spark, sf):
    return priority_mesh(spark, sf).summary


@query(
    "job09_area_layer",
    with_("parcels", **{
        "pc": """SELECT DISTINCT i, j FROM (SELECT i, unnest(generate_series(floor(miny)::BIGINT,
        floor(maxy)::BIGINT - 1)) AS j FROM (SELECT *, unnest(generate_series(floor(minx)::BIGINT,
        floor(maxx)::BIGINT - 1)) AS i FROM parcels))""",
    })
    + f"""SELECT 'communes' AS layer, count(*)::DOUBLE AS size FROM parcels WHERE minx <= {CLIP[2]}
        AND maxx >= {CLIP[0]} AND miny <= {CLIP[3]} AND maxy >= {CLIP[1]}
        UNION ALL SELECT 'outline', (SELECT count(*) FROM pc)::DOUBLE""",
)
def area_layer(spark, sf):
    communes = D.parcels(spark, sf).select(F.col("id_parcelle").alias("code"), "geom")
    kept = AR.build_area(communes, CLIP).agg(F.count(F.lit(1)).cast("double").alias("size"))
    outline = OV.outline_area(AR.build_area(communes))
    return kept.select(F.lit("communes").alias("layer"), "size").unionByName(
        outline.select(F.lit("outline").alias("layer"), r("area", 3).alias("size"))
    )


@query(
    "job10_supplier_risk",
    """SELECT s_suppkey AS source_row, coalesce(nullif(CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END, ''),
        'SUP-' || lpad(s_suppkey::VARCHAR, 6, '0')) AS supplier_id,
        coalesce(CASE WHEN s_suppkey % 3 > 0 THEN 'Cocoa' END, 'Unknown') AS raw_material,
        CASE WHEN s_suppkey % 101 <= 19 THEN 'low' WHEN s_suppkey % 101 <= 50 THEN 'medium' ELSE 'high' END
        AS risk_band FROM supplier""",
)
def supplier_risk(spark, sf):
    from terrapulse.sources.suppliers import normalize_suppliers

    k = F.col("s_suppkey")
    raw = D.read(spark, sf, "supplier").select(
        k.alias("source_row"),
        F.when(k % 5 == 0, "").otherwise(F.col("s_name")).alias("Supplier ID"),
        F.when(k % 3 > 0, "Cocoa").otherwise(" ").alias("commodity"),
        F.concat((k % 60).cast("string"), F.lit(",5")).alias("Lat"),
        F.lit("4.5").alias("Lon"),
    )
    suppliers = normalize_suppliers(raw)
    scores = suppliers.select("supplier_id", (F.col("source_row") % 101).alias("risk_score"))
    out = SR.run(suppliers, scores, T.USE_COMMODITY_COLUMN)
    return out.select("source_row", "supplier_id", "raw_material", "risk_band")


#: The corners of the parcels in degrees: inverse conic formulas with the published constants, the latitude by iteration.
_LAT = "2 * atan(exp(l) * pow((1 + 0.0818191910428158 * sin({0})) / (1 - 0.0818191910428158 * sin({0})), 0.0818191910428158 / 2)) - pi() / 2"
DEGREES = {
    "corner": """SELECT id_parcelle, 700000 - x AS dx, 12655612.049876::DOUBLE - y AS dy FROM (SELECT id_parcelle, minx AS x, miny AS y FROM parcels
        UNION ALL SELECT id_parcelle, minx, maxy FROM parcels UNION ALL SELECT id_parcelle, maxx, miny FROM parcels
        UNION ALL SELECT id_parcelle, maxx, maxy FROM parcels)""",
    "l0": """SELECT id_parcelle, 3 + degrees(atan2(-dx, dy)) / 0.7256077650532670::DOUBLE AS lon,
        -ln(sqrt(dx * dx + dy * dy) / 11754255.426096::DOUBLE) / 0.7256077650532670::DOUBLE AS l FROM corner""",
    "l1": "SELECT *, 2 * atan(exp(l)) - pi() / 2 AS p0 FROM l0",
    **{f"l{k + 2}": f"SELECT *, {_LAT.format(f'p{k}')} AS p{k + 1} FROM l{k + 1}" for k in range(7)},
    "deg": "SELECT id_parcelle, min(lon) AS west, degrees(max(p7)) AS north FROM l8 GROUP BY 1",
}


@query(
    "job11_area_registry",
    with_("parcels", **DEGREES)
    + """SELECT CASE id_parcelle % 3 WHEN 0 THEN 'bbox-' || printf('%.4f_%.4f_%.4f_%.4f', minx, miny, maxx, maxy)
        WHEN 1 THEN 'insee-' || lpad(id_parcelle::VARCHAR, 5, '0') ELSE 'dept-' || lpad(id_parcelle::VARCHAR, 5, '0')
        END AS aoi_id, CASE id_parcelle % 3 WHEN 0 THEN 'bbox' WHEN 1 THEN 'insee' ELSE 'dept' END AS kind,
        round(west, 6) AS minx, round(north, 6) AS maxy FROM parcels JOIN deg USING (id_parcelle)""",
)
def area_registry(spark, sf):
    k = F.col("id_parcelle")
    areas = D.parcels(spark, sf).select(
        F.when(k % 3 == 0, "bbox").when(k % 3 == 1, "insee").otherwise("dept").alias("kind"),
        F.lpad(k.cast("string"), 5, "0").alias("name"),
        "geom",
    )
    rows = AR.register(areas, projected=True)
    return rows.select(
        "aoi_id", "kind", F.get("bbox_wgs84", F.lit(0)).alias("minx"), F.get("bbox_wgs84", F.lit(3)).alias("maxy")
    )


#: A slanted outline with a hole and, for every third feature, a second part; its area by the corners.
SLANTED = """SELECT *, w * h * 0.9 - 4 + CASE WHEN id % 3 = 0 THEN 8 ELSE 0 END AS area, CASE WHEN id % 3 = 0 THEN 11 ELSE 8 END AS n_edges
    FROM (SELECT id_batiment AS id, minx AS x, miny AS y, maxx - minx + 10 AS w, maxy - miny + 10 AS h FROM buildings)"""


def slanted(spark, sf):
    """Buildings as text geometry: a sheared quadrilateral with a square hole, some with a triangle beside it."""
    b = D.buildings(spark, sf).selectExpr("id_batiment", "minx AS x", "miny AS y", "maxx - minx + 10 AS w", "maxy - miny + 10 AS h")
    at = lambda *spots: ", ".join(f"' || ({x}) || ' ' || ({y}) || ' 7" for x, y in spots)
    outer = at(("x", "y"), ("x + w", "y + 0.1D * h"), ("x + w", "y + h"), ("x", "y + 0.9D * h"), ("x", "y"))
    hole = at(("x + 3", "y + 4"), ("x + 5", "y + 4"), ("x + 5", "y + 6"), ("x + 3", "y + 6"), ("x + 3", "y + 4"))
    beside = at(("x - 9", "y"), ("x - 5", "y"), ("x - 5", "y + 4"), ("x - 9", "y"))
    one, two = f"'POLYGON Z (({outer}), ({hole}))'", f"'MULTIPOLYGON Z ((({outer}), ({hole})), (({beside})))'"
    return b.selectExpr("id_batiment AS id", f"CASE WHEN id_batiment % 3 = 0 THEN {two} ELSE {one} END AS geometry")


def _layer_path(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/layer-{uuid.uuid4().hex}/{name}.parquet"


def _round_trip(spark, sf, encoding):
    from terrapulse.sources.vectors import read_vector, with_edges, write_vector

    path = _layer_path(spark, "slanted")
    write_vector(with_edges(slanted(spark, sf)), path, encoding)
    read = read_vector(spark, path)
    return read.select("id", r(G.area("geom")).alias("area"), F.size("geom").cast("long").alias("n_edges"))


@query(
    "src01_vector_round_trip",
    with_("buildings", slanted=SLANTED) + "SELECT id, round(area, 6) AS area, n_edges::BIGINT AS n_edges FROM slanted",
)
def vector_round_trip(spark, sf):
    return _round_trip(spark, sf, "wkb")


@query(
    "src02_text_geometry",
    with_("buildings", slanted=SLANTED) + "SELECT id, round(area, 6) AS area, n_edges::BIGINT AS n_edges FROM slanted",
)
def text_geometry(spark, sf):
    return _round_trip(spark, sf, "wkt")


#: Rows with faults in known places: each check has to find its own.
FAULTY = {
    "f": """SELECT id_parcelle, id_parcelle % 130 - 10 AS s, CASE WHEN id_parcelle % 9 = 0 THEN 'Premium' WHEN id_parcelle % 130 - 10 >= 90 THEN 'Premium'
        WHEN id_parcelle % 130 - 10 >= 70 THEN 'Bon' ELSE 'Moyen' END AS classe FROM parcels""",
}


@query(
    "dq10_faults_are_found",
    with_("parcels", "flood", **FAULTY)
    + f"""SELECT 'duplicates' AS fault, count(*) AS violations FROM f WHERE id_parcelle % 10 = 0
        UNION ALL SELECT 'geometry', count(*) FROM f WHERE id_parcelle % 7 = 0
        UNION ALL SELECT 'range', count(*) FROM f WHERE s < 0 OR s > 100
        UNION ALL SELECT 'class', count(*) FROM f WHERE id_parcelle % 9 = 0 AND s < 90
        UNION ALL SELECT 'zone', count(*) FROM parcels p WHERE EXISTS (SELECT 1 FROM flood f WHERE {meets('p', 'f')})""",
)
def faults_are_found(spark, sf):
    p = D.parcels(spark, sf)
    k = F.col("id_parcelle")
    score = (k % 130 - 10).cast("double")
    named = F.when(k % 9 == 0, "Premium").when(score >= 90, "Premium").when(score >= 70, "Bon").otherwise("Moyen")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    bow = F.array(corner("minx", "miny"), corner("maxx", "maxy"), corner("maxx", "miny"), corner("minx", "maxy"), corner("minx", "miny"))
    rows = p.select(k, score.alias("s"), named.alias("classe"), F.when(k % 7 == 0, bow).otherwise(F.col("ring")).alias("ring"), "geom")
    none = D.monuments(spark, sf).where(F.lit(False))
    zone = SI.regulatory_violations(rows, none, D.flood_zones(spark, sf), D.woods(spark, sf).where(F.lit(False)))
    found = {
        "duplicates": Q.duplicate_ids(rows.unionByName(rows.where(k % 10 == 0)), "id_parcelle"),
        "geometry": Q.violations(rows, ~G.is_valid("ring")),
        "range": Q.violations(rows, Q.score_out_of_range(F.col("s"))),
        "class": Q.violations(rows, Q.class_mismatch(F.col("classe"), F.col("s"))),
        "zone": zone.agg(F.count(F.lit(1)).alias("violations")),
    }
    parts = [df.select(F.lit(name).alias("fault"), F.col(df.columns[0]).alias("violations")) for name, df in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
