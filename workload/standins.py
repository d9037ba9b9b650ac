"""Domain layers derived from the driver tables, as DataFrames and as SQL common table expressions.

Positions are integer formulas of the row keys inside a strip 2000 m wide that grows northwards
with the keys, so density does not change with the size of the tables. A quarter-metre offset keeps
outlines off the sampling lines.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.session import checkpointed


_LAYERS: dict[tuple, DataFrame] = {}


def layer(build):
    """Write a derived layer once per session: the operators get it as the stored table it stands for."""

    @wraps(build)
    def stored(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        if key not in _LAYERS:
            _LAYERS[key] = checkpointed(build(spark, sf))
        return _LAYERS[key]

    return stored


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _div(k: Column, n: int) -> Column:
    return F.floor(k / F.lit(n))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


def _boxed(df: DataFrame, x: Column, y: Column, w: Column, h: Column, offset: float) -> DataFrame:
    # A small table is one split, and geometry costs far more per row than its bytes suggest.
    placed = df.repartition(df.sparkSession.sparkContext.defaultParallelism).withColumns({"minx": x + F.lit(offset), "miny": y + F.lit(offset)})
    placed = placed.withColumns({"maxx": F.col("minx") + w, "maxy": F.col("miny") + h})
    corners = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    return placed.withColumns({"ring": box_ring(*corners), "geom": G.box_edges("minx", "miny", "maxx", "maxy")})


def observations(spark: SparkSession, sf: str, key: str = "l_suppkey") -> DataFrame:
    """Pixel observations: series key, time, value, two bands and a scene class."""
    return read(spark, sf, "lineitem").select(
        F.col(key).alias("pixel_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("v"),
        F.col("l_tax").alias("red"),
        F.col("l_discount").alias("nir"),
        F.col("l_linenumber").alias("scl"),
    )


def pixel_zones(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("pixel_id"), F.col("s_nationkey").alias("zone")
    )


def zones(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select(
        F.col("n_nationkey").alias("zone"), F.col("n_name").alias("nom")
    )


@layer
def parcels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    placed = _boxed(
        read(spark, sf, "customer"),
        (k % 40) * 50 + (k * 7) % 10,
        _div(k, 40) * 50 + (k * 13) % 8,
        (k * 17) % 20 + 20,
        (k * 29) % 22 + 20,
        0.25,
    )
    return placed.select(
        k.alias("id_parcelle"),
        F.col("c_nationkey").alias("commune"),
        "minx", "miny", "maxx", "maxy", "ring", "geom",
    )


@layer
def buildings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    slot = _div(k, 2)
    placed = _boxed(
        read(spark, sf, "part"),
        (slot % 40) * 50 + (k * 11) % 31,
        _div(slot, 40) * 50 + (k * 19) % 27,
        (k * 5) % 9 + 6,
        (k * 3) % 10 + 5,
        0.75,
    )
    size = F.col("p_size")
    usage = (
        F.when(size % 4 == 0, "Commercial et services")
        .when(size % 4 == 1, "Industriel")
        .otherwise("Résidentiel")
    )
    return placed.select(
        k.alias("id_batiment"),
        usage.alias("usage"),
        usage.alias("usage_1"),
        F.when(size % 5 == 0, "Industriel").alias("usage_2"),
        F.when(size > 45, "Immeuble").otherwise("Maison").alias("sous_type"),
        (k % 25).alias("commune"),
        "minx", "miny", "maxx", "maxy", "ring", "geom",
    )


def fibre(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "Déployé")
        .when(F.col("o_orderstatus") == "O", "Raccordable")
        .otherwise("Non desservi")
    )
    return read(spark, sf, "orders").select(
        k.alias("id_locale"),
        status.alias("statut_deploiement"),
        F.col("o_orderpriority").alias("operateur"),
        ((k % 100) * 20 + (k * 17) % 19 + F.lit(0.5)).alias("px"),
        (_div(k, 100) * 12 + (k * 31) % 11 + F.lit(0.5)).alias("py"),
    )


def energy(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        k.alias("id_poste_source"),
        ((k * 23) % 60 + 24).cast("double").alias("puissance_disponible_kva"),
        ((k * 797) % 2000 + F.lit(0.5)).alias("px"),
        (k * 18 + (k * 37) % 17 + F.lit(0.5)).alias("py"),
    )


def chargers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    return read(spark, sf, "labels").select(
        k.alias("id_borne"),
        ((k * 613) % 2000 + F.lit(0.5)).alias("px"),
        (k * 2 + F.lit(0.5)).alias("py"),
    )


def solar(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    return read(spark, sf, "pages").select(
        k.alias("id_pv"),
        ((k * 271) % 2000 + F.lit(0.5)).alias("px"),
        (k * 8 + F.lit(0.5)).alias("py"),
    )


def monuments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("item_id")
    return read(spark, sf, "benchmark").select(
        k.alias("id_monument"),
        ((k * 331) % 2000 + F.lit(2200.5)).alias("px"),
        (k * 45 + F.lit(0.5)).alias("py"),
    )


@layer
def flood_zones(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    placed = _boxed(
        read(spark, sf, "nation"), (k * 420) % 1700, k * 75, F.lit(120), F.lit(60), 0.5
    )
    return placed.select(k.alias("id_ppri"), "minx", "miny", "maxx", "maxy", "ring", "geom")


@layer
def woods(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    placed = _boxed(
        read(spark, sf, "documents"),
        (k * 149) % 1930,
        k * 2,
        k % 25 + 30,
        (k * 7) % 25 + 20,
        0.125,
    )
    return placed.select(k.alias("id_ebc"), "minx", "miny", "maxx", "maxy", "ring", "geom")


@layer
def roads(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    x, y = (k * 389) % 1950 + F.lit(0.6), _div(k, 5) + F.lit(0.6)
    return read(spark, sf, "events").select(
        k.alias("id_troncon"),
        x.alias("minx"), y.alias("miny"), (x + 20).alias("maxx"), y.alias("maxy"),
    ).withColumn("geom", G.line_edges("minx", "miny", "maxx", "maxy"))


@layer
def power_lines(spark: SparkSession, sf: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    x, y = (c * 173 + t * 37) % 1900 + F.lit(0.6), c * 20 + t * 3 + F.lit(0.6)
    return read(spark, sf, "conversations").select(
        (c * 1000 + t).alias("id_hta"),
        x.alias("minx"), y.alias("miny"), x.alias("maxx"), (y + 25).alias("maxy"),
    ).withColumn("geom", G.line_edges("minx", "miny", "maxx", "maxy"))


def establishments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf, "customer").select(
        F.format_string("%014d", k).alias("siret"),
        ((k % 40) * 50 + (k * 41) % 50 + F.lit(0.5)).alias("px"),
        (_div(k, 40) * 50 + (k * 23) % 50 + F.lit(0.5)).alias("py"),
    )


CTE = {
    "obs": """SELECT l_suppkey AS pixel_id, l_shipdate AS ts, l_extendedprice AS v, l_tax AS red,
        l_discount AS nir, l_linenumber AS scl FROM lineitem""",
    "obs_part": """SELECT l_partkey AS pixel_id, l_shipdate AS ts, l_extendedprice AS v FROM lineitem""",
    "axis": """SELECT m::DATE AS month, row_number() OVER (ORDER BY m) - 1 AS mi FROM (
        SELECT unnest(generate_series(date_trunc('month', min(l_shipdate)),
        date_trunc('month', max(l_shipdate)), INTERVAL 1 MONTH)) AS m FROM lineitem)""",
    "monthly": """SELECT p.pixel_id, a.month, a.mi, m.v, coalesce(m.n, 0) AS valid_count
        FROM (SELECT DISTINCT pixel_id FROM obs) p CROSS JOIN axis a LEFT JOIN (
        SELECT pixel_id, date_trunc('month', ts)::DATE AS month, median(v) AS v, count(v) AS n
        FROM obs GROUP BY 1, 2) m ON m.pixel_id = p.pixel_id AND m.month = a.month""",
    "sparse": """SELECT p.pixel_id, a.month, a.mi, m.v FROM (SELECT DISTINCT pixel_id FROM obs_part) p
        CROSS JOIN axis a LEFT JOIN (
        SELECT pixel_id, date_trunc('month', ts)::DATE AS month, median(v) AS v
        FROM obs_part GROUP BY 1, 2) m ON m.pixel_id = p.pixel_id AND m.month = a.month""",
    "deseason": """SELECT pixel_id, month, mi,
        round(v - avg(v) OVER (PARTITION BY pixel_id, month(month)), 8) AS v FROM monthly""",
    "drought": """SELECT pixel_id, month, mi, v,
        (v - avg(v) OVER s) / nullif(stddev_pop(v) OVER s, 0) AS anomaly,
        100.0 * (v - min(v) OVER s) / nullif(max(v) OVER s - min(v) OVER s, 0) AS vci
        FROM monthly WINDOW s AS (PARTITION BY pixel_id, month(month))""",
    "pixel_zone": "SELECT s_suppkey AS pixel_id, s_nationkey AS zone FROM supplier",
    "zones": "SELECT n_nationkey AS zone, n_name AS nom FROM nation",
    "parcels": """SELECT k AS id_parcelle, commune, x AS minx, y AS miny, x + w AS maxx, y + h AS maxy
        FROM (SELECT c_custkey AS k, c_nationkey AS commune,
        50 * (c_custkey % 40) + (c_custkey * 7) % 10 + 0.25::DOUBLE AS x,
        50 * (c_custkey // 40) + (c_custkey * 13) % 8 + 0.25::DOUBLE AS y,
        20 + (c_custkey * 17) % 20 AS w, 20 + (c_custkey * 29) % 22 AS h FROM customer)""",
    "buildings": """SELECT k AS id_batiment, usage, usage AS usage_1, usage_2, sous_type,
        k % 25 AS commune, x AS minx, y AS miny, x + w AS maxx, y + h AS maxy FROM (
        SELECT p_partkey AS k,
        CASE p_size % 4 WHEN 0 THEN 'Commercial et services' WHEN 1 THEN 'Industriel'
        ELSE 'Résidentiel' END AS usage,
        CASE WHEN p_size % 5 = 0 THEN 'Industriel' END AS usage_2,
        CASE WHEN p_size > 45 THEN 'Immeuble' ELSE 'Maison' END AS sous_type,
        50 * ((p_partkey // 2) % 40) + (p_partkey * 11) % 31 + 0.75::DOUBLE AS x,
        50 * ((p_partkey // 2) // 40) + (p_partkey * 19) % 27 + 0.75::DOUBLE AS y,
        6 + (p_partkey * 5) % 9 AS w, 5 + (p_partkey * 3) % 10 AS h FROM part)""",
    "fibre": """SELECT o_orderkey AS id_locale, o_orderpriority AS operateur,
        CASE o_orderstatus WHEN 'F' THEN 'Déployé' WHEN 'O' THEN 'Raccordable'
        ELSE 'Non desservi' END AS statut_deploiement,
        20 * (o_orderkey % 100) + (o_orderkey * 17) % 19 + 0.5::DOUBLE AS px,
        12 * (o_orderkey // 100) + (o_orderkey * 31) % 11 + 0.5::DOUBLE AS py FROM orders""",
    "energy": """SELECT s_suppkey AS id_poste_source,
        (24 + (s_suppkey * 23) % 60)::DOUBLE AS puissance_disponible_kva,
        (s_suppkey * 797) % 2000 + 0.5::DOUBLE AS px,
        18 * s_suppkey + (s_suppkey * 37) % 17 + 0.5::DOUBLE AS py FROM supplier""",
    "chargers": """SELECT doc_id AS id_borne, (doc_id * 613) % 2000 + 0.5::DOUBLE AS px,
        doc_id * 2 + 0.5::DOUBLE AS py FROM labels""",
    "solar": """SELECT page_id AS id_pv, (page_id * 271) % 2000 + 0.5::DOUBLE AS px,
        page_id * 8 + 0.5::DOUBLE AS py FROM pages""",
    "monuments": """SELECT item_id AS id_monument, (item_id * 331) % 2000 + 2200.5::DOUBLE AS px,
        item_id * 45 + 0.5::DOUBLE AS py FROM benchmark""",
    "flood": """SELECT k AS id_ppri, x AS minx, y AS miny, x + 120 AS maxx, y + 60 AS maxy FROM (
        SELECT n_nationkey::BIGINT AS k, (n_nationkey::BIGINT * 420) % 1700 + 0.5::DOUBLE AS x,
        n_nationkey::BIGINT * 75 + 0.5::DOUBLE AS y FROM nation)""",
    "woods": """SELECT k AS id_ebc, x AS minx, y AS miny, x + 30 + k % 25 AS maxx,
        y + 20 + (k * 7) % 25 AS maxy FROM (SELECT doc_id AS k,
        (doc_id * 149) % 1930 + 0.125::DOUBLE AS x, doc_id * 2 + 0.125::DOUBLE AS y FROM documents)""",
    "roads": """SELECT event_id AS id_troncon, (event_id * 389) % 1950 + 0.6::DOUBLE AS minx,
        event_id // 5 + 0.6::DOUBLE AS miny, (event_id * 389) % 1950 + 0.6::DOUBLE + 20 AS maxx,
        event_id // 5 + 0.6::DOUBLE AS maxy FROM events""",
    "hta": """SELECT conv_id * 1000 + turn AS id_hta,
        (conv_id * 173 + turn * 37) % 1900 + 0.6::DOUBLE AS minx,
        conv_id * 20 + turn * 3 + 0.6::DOUBLE AS miny,
        (conv_id * 173 + turn * 37) % 1900 + 0.6::DOUBLE AS maxx,
        conv_id * 20 + turn * 3 + 0.6::DOUBLE + 25 AS maxy FROM conversations""",
    "establishments": """SELECT lpad(c_custkey::VARCHAR, 14, '0') AS siret,
        50 * (c_custkey % 40) + (c_custkey * 41) % 50 + 0.5::DOUBLE AS px,
        50 * (c_custkey // 40) + (c_custkey * 23) % 50 + 0.5::DOUBLE AS py FROM customer""",
}
NEEDS = {
    "monthly": ("obs", "axis"),
    "sparse": ("obs_part", "axis"),
    "deseason": ("monthly",),
    "drought": ("monthly",),
}


def gap(a: str, b: str) -> str:
    """SQL distance of two boxes or a box and a point (a point has no min/max columns)."""
    return (
        f"sqrt(pow(greatest({a}.minx - {b}.maxx, {b}.minx - {a}.maxx, 0), 2)"
        f" + pow(greatest({a}.miny - {b}.maxy, {b}.miny - {a}.maxy, 0), 2))"
    )


def point_gap(a: str, p: str) -> str:
    """SQL distance of box ``a`` and point ``p``."""
    return (
        f"sqrt(pow(greatest({a}.minx - {p}.px, {p}.px - {a}.maxx, 0), 2)"
        f" + pow(greatest({a}.miny - {p}.py, {p}.py - {a}.maxy, 0), 2))"
    )


def meets(a: str, b: str) -> str:
    return (
        f"{a}.minx <= {b}.maxx AND {b}.minx <= {a}.maxx"
        f" AND {a}.miny <= {b}.maxy AND {b}.miny <= {a}.maxy"
    )


def with_(*names: str, **extra: str) -> str:
    """WITH clause of the named stand-ins, what they need, and query-specific tables."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ", ".join(parts) + " "
