"""Geometry, cells, proximity joins, rasters and mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import hexgrid as H
from terrapulse.operators import mesh as M
from terrapulse.operators import overlay as OV
from terrapulse.operators import raster as R
from terrapulse.operators import spatial as SP
from terrapulse.operators.installable import installable_zone
from terrapulse.plans import siting as SI
from workload import standins as D
from workload.registry import query, r
from workload.standins import gap, meets, point_gap, with_

EDGE9, EDGE8 = H.edge_of(9), H.edge_of(8)


def hex_sql(table: str, x: str, y: str, edge: float, keep: str = "*") -> str:
    """SQL adding q and r of the hexagon holding (x, y)."""
    fractional = f"""SELECT {keep}, ({x} * {H.SQRT3 / 3!r} - {y} / 3.0::DOUBLE) / {edge!r} AS fq,
        {y} * {2 / 3!r} / {edge!r} AS fr FROM {table}"""
    rounded = f"""SELECT *, -fq - fr AS fs, floor(fq + 0.5) AS rq, floor(fr + 0.5) AS rr,
        floor(-fq - fr + 0.5) AS rs FROM ({fractional})"""
    return f"""SELECT * EXCLUDE (fq, fr, fs, rq, rr, rs),
        (CASE WHEN abs(rq - fq) > abs(rr - fr) AND abs(rq - fq) > abs(rs - fs) THEN -rr - rs
        ELSE rq END)::BIGINT AS q,
        (CASE WHEN NOT (abs(rq - fq) > abs(rr - fr) AND abs(rq - fq) > abs(rs - fs))
        AND abs(rr - fr) > abs(rs - fs) THEN -rq - rs ELSE rr END)::BIGINT AS r FROM ({rounded})"""


def apart(a: str, b: str) -> str:
    """SQL hexagon distance of tables with q and r."""
    return (
        f"greatest(abs({a}.q - {b}.q), abs({a}.r - {b}.r), abs({a}.q - {b}.q + {a}.r - {b}.r))"
    )


def boxes(df, *keep):
    return df.select(*keep, "geom")


@query(
    "geo01_area",
    with_("parcels") + "SELECT id_parcelle, round((maxx - minx) * (maxy - miny), 6) AS area FROM parcels",
)
def area(spark, sf):
    return D.parcels(spark, sf).select("id_parcelle", r(G.area("geom")).alias("area"))


@query(
    "geo02_length",
    with_("roads") + "SELECT id_troncon, round(maxx - minx, 6) AS length FROM roads",
)
def length(spark, sf):
    return D.roads(spark, sf).select("id_troncon", r(G.length("geom")).alias("length"))


@query(
    "geo03_total_bounds",
    with_("buildings")
    + """SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy
        FROM buildings""",
)
def total_bounds(spark, sf):
    return R.total_bounds(D.buildings(spark, sf))


@query(
    "geo04_centroid",
    with_("parcels")
    + """SELECT id_parcelle, round((minx + maxx) / 2, 6) AS cx, round((miny + maxy) / 2, 6) AS cy
        FROM parcels""",
)
def centroid(spark, sf):
    cx, cy = G.centroid("geom")
    return D.parcels(spark, sf).select("id_parcelle", r(cx).alias("cx"), r(cy).alias("cy"))


@query(
    "geo05_validity",
    with_("parcels") + "SELECT id_parcelle, id_parcelle % 5 <> 0 AS valid FROM parcels",
)
def validity(spark, sf):
    ring = F.col("ring")
    at = lambda i: F.element_at(ring, i)
    bow_tie = F.array(at(1), at(2), at(4), at(3), at(1))
    shaped = F.when(F.col("id_parcelle") % 5 == 0, bow_tie).otherwise(ring)
    rows = D.parcels(spark, sf).select("id_parcelle", shaped.alias("shaped"))
    return rows.select("id_parcelle", G.is_valid("shaped").alias("valid"))


@query(
    "geo07_buffer_predicate",
    with_("buildings", "establishments")
    + f"""SELECT b.id_batiment, e.siret FROM buildings b JOIN establishments e
        ON {point_gap('b', 'e')} <= 15""",
)
def buffer_predicate(spark, sf):
    d = G.point_distance("geom", "px", "py")
    pairs = SP.within_pairs(
        boxes(D.buildings(spark, sf), "id_batiment"), D.establishments(spark, sf),
        SP.geom_box("geom"), SP.point_box("px", "py"), d, 15.0,
    )
    return pairs.select("id_batiment", "siret")


OVERLAP = """greatest(least(p.maxx, b.maxx) - greatest(p.minx, b.minx), 0)
    * greatest(least(p.maxy, b.maxy) - greatest(p.miny, b.miny), 0)"""


def parcel_pairs(spark, sf):
    parcels = D.parcels(spark, sf).select("id_parcelle", "geom")
    return SI.building_pairs(parcels, D.buildings(spark, sf), ["usage", "sous_type"])


@query(
    "geo08_overlap_area",
    with_("parcels", "buildings")
    + f"""SELECT p.id_parcelle, round(sum({OVERLAP}), 6) AS emprise_m2
        FROM parcels p JOIN buildings b ON {meets('p', 'b')} GROUP BY 1""",
)
def overlap_area(spark, sf):
    total = parcel_pairs(spark, sf).groupBy("id_parcelle").agg(F.sum("footprint_m2").alias("m"))
    return total.select("id_parcelle", r("m").alias("emprise_m2"))


@query(
    "geo09_distance_to_built_set",
    with_("parcels", "buildings")
    + f"""SELECT p.id_parcelle, round(min({gap('p', 'b')}), 6) AS d
        FROM parcels p, buildings b GROUP BY 1""",
)
def distance_to_built(spark, sf):
    left = D.parcels(spark, sf).select("id_parcelle", "geom")
    right = D.buildings(spark, sf).select("id_batiment", F.col("geom").alias("bgeom"))
    d = G.distance("geom", "bgeom")
    best = SP.nearest(
        left, right, SP.geom_box("geom"), SP.geom_box("bgeom"), d, "id_parcelle", "id_batiment", 20.0
    )
    return best.select("id_parcelle", r("d").alias("d"))


INSTALL = {
    "lines": """SELECT id_parcelle, row, row + 0.5::DOUBLE AS y, minx + 5 AS a, maxx - 5 AS b FROM (
        SELECT *, unnest(generate_series(floor(miny)::BIGINT, floor(maxy)::BIGINT)) AS row FROM parcels)
        WHERE row + 0.5 > miny + 5 AND row + 0.5 < maxy - 5 AND maxx - 5 > minx + 5""",
    "foot": f"""SELECT p.id_parcelle, greatest(p.minx, b.minx) AS x0, least(p.maxx, b.maxx) AS x1,
        greatest(p.miny, b.miny) AS y0, least(p.maxy, b.maxy) AS y1
        FROM parcels p JOIN buildings b ON {meets('p', 'b')}""",
    "held": """SELECT l.id_parcelle, l.row, l.y, l.a, l.b, f.x0, f.x1 FROM lines l JOIN foot f
        ON f.id_parcelle = l.id_parcelle AND l.y > f.y0 AND l.y < f.y1 AND f.x1 > f.x0""",
    "opened": """SELECT *, coalesce(max(x1) OVER (PARTITION BY id_parcelle, row ORDER BY x0, x1
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x0) AS reach FROM held""",
    "cut": """SELECT id_parcelle, y, greatest(greatest(x0, reach), a) AS a, least(x1, b) AS b FROM opened""",
    "parts": """SELECT id_parcelle, y, a, b, 1 AS s FROM lines
        UNION ALL SELECT id_parcelle, y, a, b, -1 FROM cut WHERE b > a""",
    "zone": """SELECT id_parcelle, sum(s * (b - a)) AS m, sum(s * (b - a) * (a + b) / 2) AS mx,
        sum(s * (b - a) * y) AS my FROM parts GROUP BY 1""",
    "install": """SELECT p.*, CASE WHEN m > 1e-9 THEN m ELSE 0 END AS install_m2,
        CASE WHEN m > 1e-9 THEN mx / m END AS install_x, CASE WHEN m > 1e-9 THEN my / m END AS install_y
        FROM parcels p LEFT JOIN zone z ON z.id_parcelle = p.id_parcelle""",
}


@query(
    "geo10_installable_zone",
    with_("parcels", "buildings", **INSTALL)
    + """SELECT id_parcelle, round(install_m2, 6)::DOUBLE AS install_m2, round(install_x, 6) AS install_x,
        round(install_y, 6) AS install_y FROM install""",
)
def installable(spark, sf):
    parcels = D.parcels(spark, sf).select("id_parcelle", "geom")
    solid = parcel_pairs(spark, sf).where(F.size("footprint") > 0)
    zone = installable_zone(parcels, solid.select("id_parcelle", "footprint"), "id_parcelle")
    return zone.select("id_parcelle", *[r(c).alias(c) for c in ("install_m2", "install_x", "install_y")])


WOOD_CELLS = {
    "wc": """SELECT DISTINCT i, j FROM (SELECT i, unnest(generate_series(floor(miny)::BIGINT,
        floor(maxy)::BIGINT - 1)) AS j FROM (SELECT *, unnest(generate_series(floor(minx)::BIGINT,
        floor(maxx)::BIGINT - 1)) AS i FROM woods))""",
    "sides": """SELECT 'h' AS dir, i::DOUBLE AS x, j::DOUBLE AS y FROM wc a WHERE NOT EXISTS (
        SELECT 1 FROM wc b WHERE b.i = a.i AND b.j = a.j - 1)
        UNION ALL SELECT 'h', i, j + 1 FROM wc a WHERE NOT EXISTS (
        SELECT 1 FROM wc b WHERE b.i = a.i AND b.j = a.j + 1)
        UNION ALL SELECT 'v', i, j FROM wc a WHERE NOT EXISTS (
        SELECT 1 FROM wc b WHERE b.i = a.i - 1 AND b.j = a.j)
        UNION ALL SELECT 'v', i + 1, j FROM wc a WHERE NOT EXISTS (
        SELECT 1 FROM wc b WHERE b.i = a.i + 1 AND b.j = a.j)""",
}


def wood_features(spark, sf):
    return D.woods(spark, sf).select(F.col("id_ebc").alias("fid"), "geom")


@query(
    "geo11_dissolve",
    with_("woods", **WOOD_CELLS)
    + """SELECT (SELECT count(*) FROM wc)::DOUBLE AS area, (SELECT count(*) FROM sides)::DOUBLE AS length""",
)
def dissolve(spark, sf):
    pieces = OV.dissolve_outline(wood_features(spark, sf), "fid", cell=50.0)
    total = OV.outline_area(pieces).select(r("area", 4).alias("area"))
    return total.withColumn("length", r(OV.outline_length(pieces).scalar(), 4))


CONTACT = 20.0
NEAR = {
    **WOOD_CELLS,
    "s": """SELECT row_number() OVER (ORDER BY dir, x, y) AS sid, dir,
        CASE WHEN dir = 'h' THEN x ELSE y END + 0.125::DOUBLE AS u, CASE WHEN dir = 'h' THEN y ELSE x END
        + 0.125::DOUBLE AS c FROM sides""",
    "bb": """SELECT 'h' AS dir, minx AS u0, maxx AS u1, miny AS c0, maxy AS c1 FROM buildings
        UNION ALL SELECT 'v', miny, maxy, minx, maxx FROM buildings""",
    "touch": f"""SELECT sid, u, u0, u1, greatest(c0 - c, c - c1, 0) AS dc FROM s JOIN bb ON s.dir = bb.dir
        AND bb.c0 - {CONTACT} <= s.c AND s.c <= bb.c1 + {CONTACT}
        AND bb.u0 - {CONTACT} <= s.u + 1 AND s.u <= bb.u1 + {CONTACT}""",
    "iv": f"""SELECT sid, greatest(u, u0 - sqrt({CONTACT} * {CONTACT} - dc * dc)) AS a,
        least(u + 1, u1 + sqrt({CONTACT} * {CONTACT} - dc * dc)) AS b FROM touch""",
    "rn": """SELECT sid, b, greatest(a, coalesce(max(b) OVER (PARTITION BY sid ORDER BY a, b
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS a FROM iv WHERE b > a""",
}


@query(
    "geo12_interface_line",
    with_("woods", "buildings", **NEAR)
    + "SELECT round(coalesce(sum(b - a), 0), 4)::DOUBLE AS length_m FROM rn WHERE b > a",
)
def interface_line(spark, sf):
    outline = OV.dissolve_outline(wood_features(spark, sf), "fid", cell=50.0)
    line = OV.interface_line(outline, D.buildings(spark, sf).select("geom"), CONTACT)
    return line.agg(r(F.coalesce(F.sum("length_m"), F.lit(0.0)), 4).alias("length_m"))


BAND_STEP = 4.0
BAND = {
    "cw": f"""SELECT DISTINCT i, j FROM (SELECT *, unnest(generate_series(
        ceil(miny / {BAND_STEP} - 0.5)::BIGINT, ceil(maxy / {BAND_STEP} - 0.5)::BIGINT - 1)) AS j FROM (
        SELECT *, unnest(generate_series(ceil(minx / {BAND_STEP} - 0.5)::BIGINT,
        ceil(maxx / {BAND_STEP} - 0.5)::BIGINT - 1)) AS i FROM woods))""",
    "cp": f"SELECT i, j, (i + 0.5) * {BAND_STEP}::DOUBLE AS px, (j + 0.5) * {BAND_STEP}::DOUBLE AS py FROM cw",
    "cb": f"""SELECT DISTINCT i, j FROM cp c JOIN buildings b ON c.px BETWEEN b.minx - {CONTACT}
        AND b.maxx + {CONTACT} AND c.py BETWEEN b.miny - {CONTACT} AND b.maxy + {CONTACT}
        AND {point_gap('b', 'c')} <= {CONTACT}""",
}


@query(
    "geo13_interface_band",
    with_("woods", "buildings", **BAND)
    + f"SELECT round(count(*) * {BAND_STEP} * {BAND_STEP} / 10000, 6)::DOUBLE AS interface_zone_ha FROM cb",
)
def interface_band(spark, sf):
    band = OV.interface_band_ha(
        D.woods(spark, sf), D.buildings(spark, sf), CONTACT, BAND_STEP
    )
    return band.select(r("interface_zone_ha").alias("interface_zone_ha"))


MESH_EDGE = 100.0
AOI_SQL = "SELECT 1 AS aid, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM parcels"


def parcel_area(spark, sf):
    b = R.total_bounds(D.parcels(spark, sf))
    corners = ("minx", "miny", "maxx", "maxy")
    return b.select(F.lit(1).alias("aid"), *corners, G.box_edges(*corners).alias("geom"))


MESH = {
    "aoi": AOI_SQL,
    "rr": f"""SELECT *, unnest(generate_series(floor(miny / {MESH_EDGE * 1.5})::BIGINT,
        ceil(maxy / {MESH_EDGE * 1.5})::BIGINT)) AS r FROM aoi""",
    "qq": f"""SELECT *, unnest(generate_series(floor(minx / {MESH_EDGE * H.SQRT3!r} - r / 2.0)::BIGINT,
        ceil(maxx / {MESH_EDGE * H.SQRT3!r} - r / 2.0)::BIGINT)) AS q FROM rr""",
    "hx": f"""SELECT q, r, {MESH_EDGE * H.SQRT3!r} * (q + r / 2.0::DOUBLE) AS px,
        {MESH_EDGE * 1.5} * r::DOUBLE AS py, minx, miny, maxx, maxy FROM qq""",
    "mesh": "SELECT q, r, px, py FROM hx WHERE px > minx AND px < maxx AND py > miny AND py < maxy",
}


def parcel_mesh(spark, sf):
    return M.hex_grid(parcel_area(spark, sf), "aid", "geom", MESH_EDGE)


@query(
    "geo19_hex_grid",
    with_("parcels", **MESH) + "SELECT q, r, round(px, 6) AS cx, round(py, 6) AS cy FROM mesh",
)
def hex_grid(spark, sf):
    return parcel_mesh(spark, sf).select("cell.q", "cell.r", r("cx").alias("cx"), r("cy").alias("cy"))


SHARE_STEP = 5.0
SHARE = {
    **MESH,
    "ws": f"""SELECT DISTINCT i, j FROM (SELECT *, unnest(generate_series(
        ceil(miny / {SHARE_STEP} - 0.5)::BIGINT, ceil(maxy / {SHARE_STEP} - 0.5)::BIGINT - 1)) AS j FROM (
        SELECT *, unnest(generate_series(ceil(minx / {SHARE_STEP} - 0.5)::BIGINT,
        ceil(maxx / {SHARE_STEP} - 0.5)::BIGINT - 1)) AS i FROM woods))""",
    "wp": f"SELECT (i + 0.5) * {SHARE_STEP}::DOUBLE AS px, (j + 0.5) * {SHARE_STEP}::DOUBLE AS py FROM ws",
    "wh": hex_sql("wp", "px", "py", MESH_EDGE),
    "cnt": "SELECT q, r, count(*) AS n FROM wh GROUP BY 1, 2",
}
HEX_M2 = 1.5 * H.SQRT3 * MESH_EDGE * MESH_EDGE


@query(
    "geo14_protected_share",
    with_("parcels", "woods", **SHARE)
    + f"""SELECT m.q, m.r, round(least(coalesce(n, 0) * {SHARE_STEP * SHARE_STEP / HEX_M2!r}, 1), 6)::DOUBLE
        AS enjeu FROM mesh m LEFT JOIN cnt c ON c.q = m.q AND c.r = m.r""",
)
def protected_share(spark, sf):
    out = M.protected_share(parcel_mesh(spark, sf), D.woods(spark, sf), "geom", MESH_EDGE, SHARE_STEP)
    return out.select("cell.q", "cell.r", r("enjeu").alias("enjeu"))


PROX = {
    **MESH,
    "near": f"""SELECT q, r, min({point_gap('w', 'm')}) AS d FROM mesh m, flood w GROUP BY 1, 2""",
}


@query(
    "geo15_proximity",
    with_("parcels", "flood", **PROX)
    + """SELECT q, r, round(greatest(least(1 - d / 400, 1), 0), 6)::DOUBLE AS connectivite FROM near""",
)
def proximity(spark, sf):
    zones = D.flood_zones(spark, sf)
    out = M.proximity(parcel_mesh(spark, sf), zones, "geom", "id_ppri", 400.0, "connectivite")
    return out.select("cell.q", "cell.r", r("connectivite").alias("connectivite"))


@query(
    "geo16_cell_of_point",
    with_("fibre", h=hex_sql("fibre", "px", "py", EDGE9)) + "SELECT id_locale, q, r FROM h",
)
def cell_of_point(spark, sf):
    cell = H.cell_of("px", "py", EDGE9)
    return D.fibre(spark, sf).select("id_locale", cell.alias("c")).select("id_locale", "c.q", "c.r")


@query(
    "geo17_disk",
    with_(
        "energy", h=hex_sql("energy", "px", "py", EDGE9),
        o="""SELECT a.range AS dq, b.range AS dr FROM range(-3, 4) a, range(-3, 4) b
        WHERE abs(a.range + b.range) <= 3""",
    )
    + "SELECT id_poste_source, q + dq AS q, r + dr AS r FROM h, o",
)
def disk(spark, sf):
    cell = H.cell_of.sql("px", "py", EDGE9)
    cells = D.energy(spark, sf).select("id_poste_source", F.explode(H.disk(cell, 3)).alias("c"))
    return cells.select("id_poste_source", "c.q", "c.r")


@query(
    "geo18_cell_boundary",
    with_("energy", h=hex_sql("energy", "px", "py", EDGE8))
    + f"""SELECT id_poste_source, i::INTEGER AS i,
        round({EDGE8 * H.SQRT3!r} * (q + r / 2.0::DOUBLE) + {EDGE8} * cos(radians(60 * i - 30)), 6)
        + 0::DOUBLE AS x,
        round({EDGE8 * 1.5} * r::DOUBLE + {EDGE8} * sin(radians(60 * i - 30)), 6) + 0::DOUBLE AS y
        FROM h, range(7) t(i)""",
)
def cell_boundary(spark, sf):
    cell = H.cell_of.sql("px", "py", EDGE8)
    rows = D.energy(spark, sf).select(
        "id_poste_source", F.posexplode(H.cell_boundary(cell, EDGE8)).alias("i", "p")
    )
    return rows.select("id_poste_source", "i", r("p.x").alias("x"), r("p.y").alias("y"))


STEP = 10.0


def whole_bounds(spark, sf):
    row = R.total_bounds(D.parcels(spark, sf)).first()
    return row["minx"], row["miny"], row["maxx"], row["maxy"]


@query(
    "geo20_grid",
    with_(
        "parcels", b=AOI_SQL,
        wh="SELECT *, ceil((maxx - minx) / 25)::BIGINT AS w, ceil((maxy - miny) / 25)::BIGINT AS h FROM b",
    )
    + """SELECT c AS col, l AS row, round(minx + (c + 0.5) * 25, 6) AS x, round(maxy - (l + 0.5) * 25, 6) AS y
        FROM (SELECT *, unnest(generate_series(0, h - 1)) AS l FROM (
        SELECT *, unnest(generate_series(0, w - 1)) AS c FROM wh))""",
)
def grid(spark, sf):
    cells = R.grid(spark, *whole_bounds(spark, sf), 25.0)
    return cells.select("col", "row", r("x").alias("x"), r("y").alias("y"))


@query(
    "geo21_rasterize_zones",
    with_(
        "woods",
        c=f"""SELECT id_ebc, i, unnest(generate_series(floor(miny / {STEP})::BIGINT,
        floor(maxy / {STEP})::BIGINT)) AS j FROM (SELECT *, unnest(generate_series(
        floor(minx / {STEP})::BIGINT, floor(maxx / {STEP})::BIGINT)) AS i FROM woods)""",
    )
    + "SELECT i AS col, j AS row, max(id_ebc) AS zone_idx FROM c GROUP BY 1, 2",
)
def rasterize_zones(spark, sf):
    zones = D.woods(spark, sf).select(F.col("id_ebc").alias("zone_idx"), "geom")
    return R.rasterize_zones(zones, "zone_idx", "geom", STEP)


@query(
    "geo22_presence_mask",
    with_(
        "buildings",
        c=f"""SELECT i, unnest(generate_series(ceil(miny / 2.0 - 0.5)::BIGINT,
        ceil(maxy / 2.0 - 0.5)::BIGINT - 1)) AS j FROM (SELECT *, unnest(generate_series(
        ceil(minx / 2.0 - 0.5)::BIGINT, ceil(maxx / 2.0 - 0.5)::BIGINT - 1)) AS i FROM buildings)""",
    )
    + "SELECT DISTINCT i AS col, j AS row FROM c",
)
def presence_mask(spark, sf):
    return R.presence_mask(D.buildings(spark, sf), "geom", 2.0).select("col", "row")


ELEVATION = "SELECT c_custkey % 40 AS col, c_custkey // 40 AS row, CASE WHEN c_custkey % 37 > 0 THEN c_acctbal / 100 END AS z FROM customer"
SLOPES = {
    "e": ELEVATION,
    "g": """SELECT col, row,
        coalesce(lead({z: z}) OVER x, {z: z}).z - coalesce(lag({z: z}) OVER x, {z: z}).z AS dx,
        (coalesce(lead(col) OVER x, col) - coalesce(lag(col) OVER x, col)) * 75.0::DOUBLE AS rx,
        coalesce(lead({z: z}) OVER y, {z: z}).z - coalesce(lag({z: z}) OVER y, {z: z}).z AS dy,
        (coalesce(lead(row) OVER y, row) - coalesce(lag(row) OVER y, row)) * 75.0::DOUBLE AS ry
        FROM e WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row)""",
}


def elevation(spark, sf):
    k = F.col("c_custkey")
    return D.read(spark, sf, "customer").select(
        (k % 40).alias("col"), F.floor(k / 40).alias("row"),
        F.when(k % 37 > 0, F.col("c_acctbal") / 100).alias("z"),
    )


@query(
    "geo23_slope",
    with_(**SLOPES)
    + """SELECT col, row, round(coalesce(sqrt(pow(dx / nullif(rx, 0), 2) + pow(dy / nullif(ry, 0), 2)) * 100, 0),
        6) AS slope FROM g""",
)
def slope(spark, sf):
    return R.slope_percent(elevation(spark, sf), 75.0).select("col", "row", r("slope").alias("slope"))


def sparse_roads(spark, sf):
    """Monument access tracks: one short line per monument."""
    m = D.monuments(spark, sf)
    return m.select("id_monument", G.line_edges("px - 2200", "py", "px - 2140", "py").alias("geom"))


def access_cells(spark, sf):
    k = F.col("c_custkey")
    return D.read(spark, sf, "customer").select((k % 40).alias("col"), F.floor(k / 40).alias("row"))


@query(
    "geo24_access",
    with_(
        "monuments",
        rc="""SELECT DISTINCT j, unnest(generate_series(floor((px - 2200) / 50)::BIGINT,
        floor((px - 2140) / 50)::BIGINT)) AS i FROM (SELECT *, floor(py / 50)::BIGINT AS j FROM monuments)""",
        cells="SELECT c_custkey % 40 AS col, c_custkey // 40 AS row FROM customer",
        n="""SELECT col, row, min(pow(col - i, 2) + pow(row - j, 2)) AS d2 FROM cells, (
        SELECT rc.i, rc.j FROM rc JOIN cells c ON c.col = rc.i AND c.row = rc.j) t GROUP BY 1, 2""",
    )
    + "SELECT col, row, round(greatest(1 - sqrt(d2) * 50 / 500, 0), 6)::DOUBLE AS access FROM n",
)
def access(spark, sf):
    cells = access_cells(spark, sf)
    roads = R.presence_mask(sparse_roads(spark, sf), "geom", 50.0, lines=True)
    return R.access_from_cells(cells, roads, 50.0).select("col", "row", r("access").alias("access"))


@query(
    "geo25_exclusion_mask",
    with_(
        "flood",
        c="""SELECT *, (i + 0.5) * 25::DOUBLE AS px, (j + 0.5) * 25::DOUBLE AS py FROM (
        SELECT *, unnest(generate_series(floor((miny - 100) / 25)::BIGINT, floor((maxy + 100) / 25)::BIGINT)) AS j
        FROM (SELECT *, unnest(generate_series(floor((minx - 100) / 25)::BIGINT,
        floor((maxx + 100) / 25)::BIGINT)) AS i FROM flood))""",
    )
    + f"SELECT DISTINCT i AS col, j AS row FROM c WHERE {point_gap('c', 'c')} <= 100",
)
def exclusion_mask(spark, sf):
    return R.exclusion_cells(D.flood_zones(spark, sf), "geom", 25.0).select("col", "row")


@query(
    "geo26_resample",
    with_(
        src=ELEVATION.replace("SELECT", "SELECT c_custkey,", 1),
        t="""SELECT s_suppkey AS col, s_nationkey AS row, (s_suppkey * 797) % 2900 + 40.5::DOUBLE AS x,
        (s_suppkey * 331) % 2600 + 40.5::DOUBLE AS y FROM supplier""",
        f="SELECT *, x / 75 - 0.5 AS fx, y / 75 - 0.5 AS fy FROM t",
        k="""SELECT f.col, f.row, f.x, f.y, floor(fx)::BIGINT + a.range AS c, floor(fy)::BIGINT + b.range AS l,
        (CASE WHEN a.range = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END)
        * (CASE WHEN b.range = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS w
        FROM f, range(2) a, range(2) b""",
    )
    + """SELECT k.col, k.row, round(coalesce(sum(w * z) / nullif(sum(CASE WHEN z IS NOT NULL THEN w END), 0),
        0), 6) + 0::DOUBLE AS z FROM k LEFT JOIN src s ON s.col = k.c AND s.row = k.l
        GROUP BY k.col, k.row, k.x, k.y""",
)
def resample(spark, sf):
    k = F.col("s_suppkey")
    target = D.read(spark, sf, "supplier").select(
        k.alias("col"), F.col("s_nationkey").alias("row"),
        ((k * 797) % 2900 + F.lit(40.5)).alias("x"), ((k * 331) % 2600 + F.lit(40.5)).alias("y"),
    )
    out = R.resample_bilinear(elevation(spark, sf), target, 75.0)
    return out.select("col", "row", r("z").alias("z"))


@query(
    "geo27_representative_point",
    with_("parcels")
    + """SELECT id_parcelle, round((minx + maxx) / 2, 6) AS x, round((miny + maxy) / 2, 6) AS y
        FROM parcels""",
)
def representative_point(spark, sf):
    x, y = G.representative_point("geom")
    return D.parcels(spark, sf).select("id_parcelle", r(x).alias("x"), r(y).alias("y"))
