"""Joins of outlines of any extent: cells along the edges, spans of whole cells inside.

A box over a long line or a country has far more cells than its outline. Here an edge is keyed by the cells it runs
through, and the inside of a polygon by spans of cells of each row, which are cut into blocks of powers of eight; both
grow with the length of the outline. Two outlines meet in a cell that both run through; a point in a span is inside
without a look at the geometry; a point in a cell of the outline is judged by the edges of its row of cells alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.operators.unnest import unnest
from terrapulse.session import checkpointed, shuffled

#: Spans are cut into blocks of 1, 8, 64, ... cells, up to this power.
RADIX, POWERS = 8, 7
#: Pairs of edges that one key of a join may have; a more crowded cell is dealt over several keys.
CELL_PAIRS = 4_000_000
#: Room for rounding where an edge runs along the side of a cell, in metres.
SLACK = 1e-6


def _at(value: str, cell: float) -> str:
    return f"bigint(floor(({value}) / {G.num(cell)}))"


def edge_rows(features: DataFrame, key: str, geom: str, cell: float) -> DataFrame:
    """``key, cy, x0, x1, e``: for each edge and row of cells that it touches the range of cells there."""
    edges = unnest(features.select(key, geom), F.col(geom), "e").select(key, "e")
    rows = unnest(edges, F.expr(f"sequence({_at(f'least(e.y1, e.y2) - {SLACK}', cell)}, {_at(f'greatest(e.y1, e.y2) + {SLACK}', cell)})"), "cy")

    def x_at(y: str) -> str:
        """Where the edge is at a height, held within its ends."""
        at = f"e.x1 + ({y} - e.y1) * (e.x2 - e.x1) / nullif(e.y2 - e.y1, 0D)"
        return f"least(greatest({at}, least(e.x1, e.x2)), greatest(e.x1, e.x2))"

    low, high = (x_at(f"(cy + {n}) * {G.num(cell)}") for n in (0, 1))
    # A flat edge has no such height: its ends hold. Of a sloped one the part between the row's sides counts.
    flat = "e.y1 = e.y2"
    ends = [f"CASE WHEN {flat} THEN e.x{n} ELSE {x} END" for n, x in ((1, low), (2, high))]
    return rows.select(
        key, "cy",
        F.expr(_at(f"least({ends[0]}, {ends[1]}) - {SLACK}", cell)).alias("x0"),
        F.expr(_at(f"greatest({ends[0]}, {ends[1]}) + {SLACK}", cell)).alias("x1"),
        "e",
    )


def edge_cells(features: DataFrame, key: str, geom: str, cell: float) -> DataFrame:
    """``key, cx, cy, e``: every edge under the cells that it runs through."""
    return unnest(edge_rows(features, key, geom, cell), F.sequence("x0", "x1"), "cx").select(key, "cx", "cy", "e")


def parts_starts(features: DataFrame, key: str, geom: str) -> DataFrame:
    """``key, x, y``: where each ring or part begins."""
    first = f"filter(transform({geom}, (e, i) -> CASE WHEN i = 0 OR e.x1 != {geom}[i - 1].x2 OR e.y1 != {geom}[i - 1].y2 THEN named_struct('x', e.x1, 'y', e.y1) END), p -> p IS NOT NULL)"
    return unnest(features.select(key, geom), F.expr(first), "_start").select(key, "_start.x", "_start.y")


def closed(geom: str) -> Column:
    """Whether the parts of an outline return to where they began; open lines have no inside."""
    sums = [f"aggregate({geom}, 0D, (s, e) -> s + e.{k}2 - e.{k}1)" for k in "xy"]
    return F.expr(" AND ".join(f"abs({s}) < {SLACK}" for s in sums))


def row_covers(polygons: DataFrame, key: str, geom: str, cell: float) -> DataFrame:
    """``key, cy, edges, borders, inside``: of each row of cells the edges, their ranges of cells and the spans between.

    A span of cells without an edge is inside as a whole if the edges that cross the middle of the row before it are
    odd in number.
    """
    rows = edge_rows(polygons.where(closed(geom)), key, geom, cell)
    grouped = rows.groupBy(key, "cy").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "e"))).alias("own"))
    # Ranges that touch or overlap become one.
    merged = F.expr(
        "aggregate(own, cast(array() AS array<struct<x0:bigint,x1:bigint>>), (done, r) -> "
        "CASE WHEN size(done) > 0 AND r.x0 <= element_at(done, -1).x1 + 1 "
        "THEN concat(slice(done, 1, size(done) - 1), array(named_struct('x0', element_at(done, -1).x0, 'x1', greatest(element_at(done, -1).x1, r.x1)))) "
        "ELSE concat(done, array(named_struct('x0', r.x0, 'x1', r.x1))) END)"
    )
    middle = f"((cy + 0.5D) * {G.num(cell)})"
    left = (
        f"size(filter(edges, e -> (e.y1 > {middle}) != (e.y2 > {middle}) AND e.x1 + ({middle} - e.y1) * (e.x2 - e.x1) "
        f"/ nullif(e.y2 - e.y1, 0D) < (borders[i].x1 + 1) * {G.num(cell)}))"
    )
    gaps = (
        "filter(transform(slice(borders, 1, size(borders) - 1), (b, i) -> CASE WHEN "
        f"{left} % 2 = 1 THEN named_struct('x0', b.x1 + 1, 'x1', borders[i + 1].x0 - 1) END), s -> s IS NOT NULL)"
    )
    return grouped.select(key, "cy", F.expr("transform(own, r -> r.e)").alias("edges"), merged.alias("borders")).withColumn("inside", F.expr(gaps))


def _blocks(span: str) -> str:
    """The blocks ``(power, place)`` that make up a span of cells, largest first inside."""

    def floored(power: int, end: str) -> str:
        size = RADIX**power
        up = f"bigint(ceil({span}.x0 / {size}D))"
        down = f"bigint(floor(({span}.x1 + 1) / {size}D)) - 1"
        return up if end == "low" else down

    def listed(power: int, low: str, high: str) -> str:
        return f"CASE WHEN {low} <= {high} THEN transform(sequence({low}, {high}), at -> named_struct('power', {power}, 'at', at)) ELSE cast(array() AS array<struct<power:int,at:bigint>>) END"

    parts = []
    for power in range(POWERS):
        low, high = floored(power, "low"), floored(power, "high")
        if power == POWERS - 1:
            parts.append(listed(power, low, high))
            continue
        upper, last = floored(power + 1, "low"), floored(power + 1, "high")
        split = f"concat({listed(power, low, f'{upper} * {RADIX} - 1')}, {listed(power, f'({last} + 1) * {RADIX}', high)})"
        parts.append(f"CASE WHEN {upper} <= {last} THEN {split} ELSE {listed(power, low, high)} END")
    return f"concat({', '.join(parts)})"


def points_in(points: DataFrame, polygons: DataFrame, point_key: str, key: str, x: str, y: str, geom: str, cell: float) -> DataFrame:
    """``point_key, key`` of the points inside polygons, each pair once for each row of ``points``.

    A point meets the spans under one key for each power; only where it shares a cell with an outline the row's edges
    decide, by the parity of crossings to its right.
    """
    rows = checkpointed(row_covers(polygons, key, geom, cell))
    spots = points.select(point_key, F.col(x).alias("px"), F.col(y).alias("py"), F.expr(_at(x, cell)).alias("cx"), F.expr(_at(y, cell)).alias("cy"))
    held = unnest(rows.select(key, "cy", "inside"), F.expr(f"flatten(transform(inside, s -> {_blocks('s')}))"), "_block").select(key, "cy", "_block.power", "_block.at")
    powers = F.array(*[F.struct(F.lit(p).alias("power"), F.floor(F.col("cx") / RADIX**p).alias("at")) for p in range(POWERS)])
    keyed = spots.withColumn("_block", F.explode(powers)).select(point_key, "cy", "_block.power", "_block.at")
    whole = keyed.join(shuffled(held), ["cy", "power", "at"]).select(point_key, key)
    border = unnest(rows.select(key, "cy", "borders"), F.expr("flatten(transform(borders, r -> sequence(r.x0, r.x1)))"), "cx").select(key, "cy", "cx")
    near = spots.join(shuffled(border), ["cx", "cy"]).join(shuffled(rows.select(key, "cy", "edges")), [key, "cy"])
    judged = near.where(G.contains_point("edges", "px", "py")).select(point_key, key)
    return whole.unionByName(judged)


def _dealt(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``deal``: crowded cells spread over several keys, so that a key's pairs stay bounded."""
    cell = ["cx", "cy"]
    counts = one.groupBy(*cell).agg(F.count("*").alias("n")).join(other.groupBy(*cell).agg(F.count("*").alias("m")), cell)
    crowded = checkpointed(counts.where(F.col("n") * F.col("m") > CELL_PAIRS).select(*cell, F.ceil(F.col("n") * F.col("m") / CELL_PAIRS).cast("int").alias("parts")))
    if crowded.isEmpty():
        return one.withColumn("deal", F.lit(0)), other.withColumn("deal", F.lit(0))
    parts = F.coalesce("parts", F.lit(1))
    left = one.join(crowded, cell, "left").withColumn("deal", F.pmod(F.xxhash64("e"), parts).cast("int")).drop("parts")
    right = other.join(crowded, cell, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left, right


def outline_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_geom: str, right_geom: str, cell: float) -> DataFrame:
    """Distinct ``left_key, right_key`` of features that share a point: outlines meet, or a part lies inside the other."""
    one, other = edge_cells(left, left_key, left_geom, cell), edge_cells(right, right_key, right_geom, cell).withColumnRenamed("e", "f")
    one, other = _dealt(checkpointed(one), checkpointed(other))
    met = one.join(shuffled(other), ["cx", "cy", "deal"]).where(F.expr(G._meet("e", "f"))).select(left_key, right_key)
    inner = points_in(parts_starts(left, left_key, left_geom), right, left_key, right_key, "x", "y", right_geom, cell)
    outer = points_in(parts_starts(right, right_key, right_geom), left, right_key, left_key, "x", "y", left_geom, cell)
    return met.unionByName(inner).unionByName(outer.select(left_key, right_key)).distinct()


def points_near_edges(points: DataFrame, polygons: DataFrame, point_key: str, x: str, y: str, geom: str, radius: float) -> DataFrame:
    """``point_key`` of the points at most ``radius`` from an edge, once for each edge: cells along the edges, nine for a point."""
    size = max(float(radius), 1.0)
    along = edge_cells(polygons.select(F.lit(0).alias("_side"), geom), "_side", geom, size).drop("_side")
    near = F.array(*[F.lit(v).cast("bigint") for v in (-1, 0, 1)])
    spots = points.select(point_key, F.col(x).alias("px"), F.col(y).alias("py"), F.expr(_at(x, size)).alias("qx"), F.expr(_at(y, size)).alias("qy"))
    spots = spots.withColumn("cx", F.explode(F.transform(near, lambda d: F.col("qx") + d))).withColumn("cy", F.explode(F.transform(near, lambda d: F.col("qy") + d)))
    met = spots.join(shuffled(along), ["cx", "cy"])
    return met.where(F.expr(f"{G._point_segment('e', 'px', 'py')} <= {G.num(radius)}")).select(point_key)
