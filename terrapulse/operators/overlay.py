"""Overlay of outlines: dissolve, union area, interface line and band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.operators import raster as R
from terrapulse.operators.spatial import cell_join, geom_box
from terrapulse.operators.unnest import unnest
from terrapulse.session import checkpointed, shuffled


def edge_table(features: DataFrame, fid: str, geom: str = "geom") -> DataFrame:
    """One row per edge: ``(fid, eid, e)``."""
    pieces = features.select(F.col(fid).alias("fid"), F.posexplode_outer(geom).alias("eid", "e"))
    return pieces.where(F.col("e").isNotNull())


def split_long_edges(edges: DataFrame, step: float) -> DataFrame:
    """Cut edges into pieces of at most ``step`` metres, so no edge meets an unbounded crowd."""
    e = F.col("e")
    dx, dy = e.getField("x2") - e.getField("x1"), e.getField("y2") - e.getField("y1")
    n = F.greatest(F.ceil(F.hypot(dx, dy) / F.lit(float(step))), F.lit(1).cast("bigint"))
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)
    parts = unnest(edges.withColumn("_n", n), steps, "_i")

    def at(axis: str, i: str) -> str:
        a, b = f"e.{axis}1", f"e.{axis}2"
        return f"CASE WHEN {i} = _n THEN {b} ELSE {a} + ({b} - {a}) * ({i}) / _n END"

    piece = G.segment(at("x", "_i"), at("y", "_i"), at("x", "(_i + 1)"), at("y", "(_i + 1)"))
    number = F.col("eid").cast("bigint") * 1_000_000 + F.col("_i")
    return parts.select("fid", number.alias("eid"), piece.alias("e"))


def _edge_box() -> tuple[Column, Column, Column, Column]:
    e = F.col("e")
    return (
        F.least(e.getField("x1"), e.getField("x2")),
        F.least(e.getField("y1"), e.getField("y2")),
        F.greatest(e.getField("x1"), e.getField("x2")),
        F.greatest(e.getField("y1"), e.getField("y2")),
    )


def merged_spans(spans: DataFrame) -> DataFrame:
    """Union of the intervals ``(t0, t1)`` of each edge as disjoint rows ``(fid, eid, e, t0, t1)``.

    An edge may come in several pieces under one number, so the piece itself is part of the key.
    """
    order = Window.partitionBy("fid", "eid", "e").orderBy("t0", "t1")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("t1").over(before), F.lit(0.0))
    opened = spans.withColumn("reach", reach)
    start = F.greatest(F.col("t0"), F.col("reach"))
    return opened.withColumn("t0", start).where(F.col("t1") > F.col("t0")).drop("reach")


def _span_length() -> Column:
    e = F.col("e")
    size = F.hypot(e.getField("x2") - e.getField("x1"), e.getField("y2") - e.getField("y1"))
    return (F.col("t1") - F.col("t0")) * size


def dissolve_outline(
    features: DataFrame, fid: str, geom: str = "geom", cell: float = 100.0
) -> DataFrame:
    """Directed pieces ``(fid, eid, e)`` of the outline of the union of all features.

    A stretch is dropped when it runs inside another feature, or along one that lies on the other
    side; a stretch several features share the same way is kept from the lowest id.
    """
    edges = edge_table(features, fid, geom)
    others = features.select(F.col(fid).alias("oid"), F.col(geom).alias("ogeom"))
    pairs = cell_join(edges, others, _edge_box(), geom_box("ogeom"), cell).where(
        F.col("fid") != F.col("oid")
    )
    covering = F.when(
        F.col("oid") < F.col("fid"), G.inside_spans("e", "ogeom", "any")
    ).otherwise(G.inside_spans("e", "ogeom", "opposite"))
    covered = unnest(pairs, covering, "s").select(
        "fid", "eid", "e", F.col("s.t0").alias("t0"), F.col("s.t1").alias("t1")
    )
    whole = edges.select("fid", "eid", "e", F.lit(1.0).alias("t0"), F.lit(1.0).alias("t1"))
    order = Window.partitionBy("fid", "eid").orderBy("t0", "t1")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    gaps = covered.unionByName(whole).withColumn(
        "reach", F.coalesce(F.max("t1").over(before), F.lit(0.0))
    )
    free = gaps.where(F.col("t0") > F.col("reach") + F.lit(G.EPS)).withColumn(
        "gap", F.struct(F.col("reach").alias("t0"), F.col("t0").alias("t1"))
    )
    return free.select("fid", "eid", G.cut("e", "gap").alias("e"))


def outline_area(pieces: DataFrame) -> DataFrame:
    """Area enclosed by directed outline pieces (Green's theorem), one row ``area``."""
    e = F.col("e")
    twice = e.getField("x1") * e.getField("y2") - e.getField("x2") * e.getField("y1")
    return pieces.agg(F.coalesce(F.sum(twice) / F.lit(2.0), F.lit(0.0)).alias("area"))


def outline_length(pieces: DataFrame) -> DataFrame:
    e = F.col("e")
    size = F.hypot(e.getField("x2") - e.getField("x1"), e.getField("y2") - e.getField("y1"))
    return pieces.agg(F.coalesce(F.sum(size), F.lit(0.0)).alias("length"))


def clip_edges(edges: DataFrame, polygons: DataFrame, geom: str, cell: float) -> DataFrame:
    """Parts of the edges inside the union of ``polygons``."""
    pairs = cell_join(
        edges, polygons.select(F.col(geom).alias("cgeom")), _edge_box(), geom_box("cgeom"), cell
    )
    spans = unnest(pairs, G.inside_spans("e", "cgeom", "any"), "s").select(
        "fid", "eid", "e", F.col("s.t0").alias("t0"), F.col("s.t1").alias("t1")
    )
    kept = merged_spans(spans).withColumn("span", F.struct("t0", "t1"))
    return kept.select(
        "fid",
        (F.col("eid").cast("bigint") * 1_000 + F.row_number().over(
            Window.partitionBy("fid", "eid", "e").orderBy("t0")
        )).alias("eid"),
        G.cut("e", "span").alias("e"),
    )


def interface_line(
    forest_edges: DataFrame, built: DataFrame, contact_m: float, geom: str = "geom"
) -> DataFrame:
    """Stretches of the forest outline within ``contact_m`` of a building.

    Per outline piece and building edge the stretch in reach is one interval; a stretch inside the
    building counts too. The intervals of a piece are merged, so shared reach counts once.
    """
    pieces = split_long_edges(forest_edges, 2.0 * contact_m)
    walls = built.select(F.col(geom).alias("bgeom")).distinct()
    pairs = cell_join(pieces, walls, _edge_box(), geom_box("bgeom"), 2.0 * contact_m, contact_m)
    near = F.expr(
        f"filter(transform(bgeom, b_il -> {G.near_span.sql('e', 'b_il', contact_m)}), "
        "s_il -> s_il IS NOT NULL)"
    )
    inside = G.inside_spans("e", "bgeom", "any")
    spans = unnest(pairs, F.concat(near, inside), "s").select(
        "fid", "eid", "e", F.col("s.t0").alias("t0"), F.col("s.t1").alias("t1")
    )
    return merged_spans(spans).withColumn("length_m", _span_length())


def interface_band_ha(
    forest: DataFrame,
    built: DataFrame,
    contact_m: float,
    step: float,
    aoi: DataFrame | None = None,
    geom: str = "geom",
) -> DataFrame:
    """Forest area within ``contact_m`` of a building, sampled at cell centres every ``step`` m.

    Buildings are unfolded into cells only where a block of cells holds forest.
    """
    wooded = R.burn_centers(forest, geom, step).select("col", "row").distinct()
    if aoi is not None:
        kept = R.burn_centers(aoi, geom, step).select("col", "row").distinct()
        wooded = wooded.join(shuffled(kept), ["col", "row"], "left_semi")
    wooded = checkpointed(wooded)
    reached = R.cells_within_of(built.select(geom), geom, contact_m, step, wooded).select("col", "row").distinct()
    both = wooded.join(shuffled(reached), ["col", "row"], "left_semi")
    return both.agg((F.count(F.lit(1)) * F.lit(step * step / 10_000.0)).alias("interface_zone_ha"))
