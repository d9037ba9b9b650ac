"""Room left on a parcel: the parcel drawn in by a setback, minus the built footprints.

Measured on scan-lines every ``step`` metres, exact along each line: the setback removes one
interval per parcel edge, and the footprints are cut from what is left. The error is of order
``step`` squared for straight outlines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.operators.unnest import unnest
from terrapulse.session import checkpointed, shuffled


def _line_y(step: float) -> str:
    return f"((row + 0.5D) * {G.num(step)})"


def _rows(lo: Column, hi: Column, step: float) -> Column:
    cell = F.lit(float(step))
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def setback_spans(parcels: DataFrame, key: str, geom: str, setback: float, step: float) -> DataFrame:
    """``(key, row, a, b)``: stretches of each scan-line inside the parcel and off its outline."""
    b = G.bounds(geom)
    framed = parcels.select(
        key, geom, (b["minx"] - 1.0).alias("_lo"), (b["maxx"] + 1.0).alias("_hi")
    )
    lined = unnest(framed, _rows(b["miny"], b["maxy"], step), "row")
    y = _line_y(step)
    # Of an outline few edges are near a line; the margin leaves the rim to the exact test.
    beside = f"filter({geom}, e_sb -> {y} BETWEEN least(e_sb.y1, e_sb.y2) - {setback + 1.0}D AND greatest(e_sb.y1, e_sb.y2) + {setback + 1.0}D)"
    near = f"filter(transform({beside}, e_sb -> {G.near_reach.sql(y, 'e_sb', setback)}), s_sb -> s_sb.a IS NOT NULL)"
    outside = G.span_pairs.sql(f"concat(array(_lo), {G.scan_hits.sql(geom, y)}, array(_hi))")
    # Running end of the blocked stretches; a gap before the next one is free.
    step_on = (
        "named_struct('reach', greatest(acc_sb.reach, s_sb.b), 'free', "
        "CASE WHEN s_sb.a > acc_sb.reach THEN concat(acc_sb.free, "
        "array(named_struct('a', acc_sb.reach, 'b', s_sb.a))) ELSE acc_sb.free END)"
    )
    start = (
        "named_struct('reach', _lo, 'free', cast(array() AS array<struct<a:double,b:double>>))"
    )
    free = F.expr(
        f"aggregate(array_sort(concat({near}, {outside})), {start}, "
        f"(acc_sb, s_sb) -> {step_on}, acc_sb -> acc_sb.free)"
    )
    return unnest(lined, free, "s").select(key, "row", "s.a", "s.b")


def footprint_spans(footprints: DataFrame, key: str, geom: str, step: float) -> DataFrame:
    """``(key, row, a, b)``: disjoint built stretches of each scan-line of each parcel."""
    b = G.bounds(geom)
    lined = unnest(footprints.select(key, geom), _rows(b["miny"], b["maxy"], step), "row")
    hits = G.scan_hits.sql(geom, _line_y(step))
    spans = unnest(lined, G.span_pairs(hits), "s").select(key, "row", "s.a", "s.b")
    order = Window.partitionBy(key, "row").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_reach", reach)
    return opened.select(
        key, "row", F.greatest("a", "_reach").alias("a"), "b"
    ).where(F.col("b") > F.col("a"))


def _measure(spans: DataFrame, key: str, step: float, sign: float) -> DataFrame:
    size = (F.col("b") - F.col("a")) * F.lit(sign * step)
    return spans.groupBy(key).agg(
        F.sum(size).alias("m"),
        F.sum(size * (F.col("a") + F.col("b")) / F.lit(2.0)).alias("mx"),
        F.sum(size * F.expr(_line_y(step))).alias("my"),
    )


def installable_zone(
    parcels: DataFrame,
    footprints: DataFrame,
    key: str,
    geom: str = "geom",
    footprint_geom: str = "footprint",
    setback: float = 5.0,
    step: float = 1.0,
) -> DataFrame:
    """``(key, install_m2, install_x, install_y)``; an empty zone has area 0 and a NULL centroid."""
    # Stored, because both the measure and the cut of the footprints read the spans.
    free = checkpointed(setback_spans(parcels, key, geom, setback, step))
    built = footprint_spans(footprints, key, footprint_geom, step)
    taken = (
        free.join(shuffled(built.withColumnsRenamed({"a": "_a", "b": "_b"})), [key, "row"])
        .select(key, "row", F.greatest("a", "_a").alias("a"), F.least("b", "_b").alias("b"))
        .where(F.col("b") > F.col("a"))
    )
    parts = _measure(free, key, step, 1.0).unionByName(_measure(taken, key, step, -1.0))
    summed = parts.groupBy(key).agg(
        F.sum("m").alias("m"), F.sum("mx").alias("mx"), F.sum("my").alias("my")
    )
    some = F.when(F.col("m") > 1e-9, F.col("m"))
    return parcels.select(key).join(shuffled(summed), key, "left").select(
        key,
        F.coalesce(some, F.lit(0.0)).alias("install_m2"),
        (F.col("mx") / some).alias("install_x"),
        (F.col("my") / some).alias("install_y"),
    )
