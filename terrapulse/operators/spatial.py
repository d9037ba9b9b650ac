"""Proximity joins as hash equi-joins on grid cells.

Each side is keyed by the square cells its (padded) box touches; a pair meets in several cells but
is reported only by the cell holding the low corner of the common box, so no de-duplicating shuffle
follows. The exact test runs on the pairs that survive the box test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import hexgrid as H
from terrapulse.operators.cover import outline_pairs, points_in
from terrapulse.operators.pyramid import _boxed, candidates, candidates_in_disk, dealt_join
from terrapulse.operators.unnest import unnest
from terrapulse.session import checkpointed, shuffled

Box = tuple[Column, Column, Column, Column]


def point_box(x: str, y: str) -> Box:
    return F.col(x), F.col(y), F.col(x), F.col(y)


def geom_box(geom: str) -> Box:
    b = G.bounds(geom)
    return b["minx"], b["miny"], b["maxx"], b["maxy"]


def columns_box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in ("minx", "miny", "maxx", "maxy"))


def _keyed(df: DataFrame, box: Box, pad: float, cell: float, side: str) -> DataFrame:
    names = [f"_{side}{i}" for i in range(4)]
    shift = (-pad, -pad, pad, pad)
    boxed = df.withColumns({n: c + F.lit(float(s)) for n, c, s in zip(names, box, shift)})

    def cells(lo: str, hi: str) -> Column:
        at = lambda n: F.floor(F.col(n) / F.lit(float(cell)))
        return F.sequence(at(lo), at(hi))

    across = unnest(boxed, cells(names[0], names[2]), "_cx")
    return unnest(across, cells(names[1], names[3]), "_cy")


def cell_join(
    left: DataFrame,
    right: DataFrame,
    left_box: Box,
    right_box: Box,
    cell: float,
    pad: float = 0.0,
) -> DataFrame:
    """Pairs whose boxes, the left one padded by ``pad``, overlap; column names must be disjoint.

    A crowded cell is a skewed join key, which adaptive execution splits.
    """
    low = _keyed(left, left_box, pad, cell, "l")
    high = _keyed(right, right_box, 0.0, cell, "r")
    owner = [
        F.floor(F.greatest(f"_l{i}", f"_r{i}") / F.lit(float(cell))) == F.col(c)
        for i, c in ((0, "_cx"), (1, "_cy"))
    ]
    overlap = (
        (F.col("_l0") <= F.col("_r2"))
        & (F.col("_r0") <= F.col("_l2"))
        & (F.col("_l1") <= F.col("_r3"))
        & (F.col("_r1") <= F.col("_l3"))
    )
    joined = low.join(shuffled(high), ["_cx", "_cy"]).where(owner[0] & owner[1] & overlap)
    return joined.drop("_cx", "_cy", *[f"_{s}{i}" for s in "lr" for i in range(4)])


def within_pairs(
    left: DataFrame,
    right: DataFrame,
    left_box: Box,
    right_box: Box,
    distance: Column,
    radius: float,
    cell: float | None = None,
) -> DataFrame:
    """Pairs at most ``radius`` apart, with their distance ``d``."""
    size = cell or max(float(radius), 1.0)
    pairs = cell_join(left, right, left_box, right_box, size, radius)
    # A filter on a computed column is pushed below it and evaluates the distance a second time;
    # unnesting the array of at most one accepted distance evaluates it once.
    accepted = F.filter(F.array(distance), lambda d: d <= F.lit(float(radius)))
    return unnest(pairs, accepted, "d")


def keep_matched(left: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` with at least one pair."""
    return left.join(shuffled(pairs.select(key).distinct()), key, "left_semi")


def drop_matched(left: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` without a pair."""
    return left.join(shuffled(pairs.select(key).distinct()), key, "left_anti")


def flag_matched(left: DataFrame, pairs: DataFrame, key: str, name: str) -> DataFrame:
    """``left`` with a boolean telling whether a pair exists."""
    hit = pairs.select(key).distinct().withColumn(name, F.lit(True))
    return left.join(shuffled(hit), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def best_pair(pairs: DataFrame, key: str, other: str, attributes: Sequence[str]) -> DataFrame:
    """Nearest partner of each key; ties go to the lowest partner id."""
    packed = F.min_by(F.struct(other, *attributes), F.struct("d", other)).alias("_best")
    best = pairs.groupBy(key).agg(packed, F.min("d").alias("d"))
    return best.select(key, f"_best.{other}", *[f"_best.{a}" for a in attributes], "d")


def hex_disk_pairs(
    left: DataFrame, right: DataFrame, left_cell: str, right_cell: str, k: int
) -> DataFrame:
    """Pairs whose hexagons are at most ``k`` steps apart.

    The key is a ``k`` by ``k`` block of axial coordinates: the right side is copied to 9 blocks
    instead of to the 3k(k+1)+1 cells of a disk.
    """
    block = F.lit(float(max(k, 1)))

    def part(cell: str, axis: str) -> Column:
        return F.floor(F.col(cell).getField(axis) / block)

    near = F.array(*[F.lit(v).cast("bigint") for v in (-1, 0, 1)])
    low = left.withColumns({"_bq": part(left_cell, "q"), "_br": part(left_cell, "r")})
    high = (
        right.withColumn("_dq", F.explode(near))
        .withColumn("_dr", F.explode(near))
        .withColumns(
            {
                "_bq": part(right_cell, "q") + F.col("_dq"),
                "_br": part(right_cell, "r") + F.col("_dr"),
            }
        )
        .drop("_dq", "_dr")
    )
    joined = low.join(shuffled(high), ["_bq", "_br"]).drop("_bq", "_br")
    return joined.where(H.cell_distance(F.col(left_cell), F.col(right_cell)) <= k)


def nearest_in_disk(
    left: DataFrame,
    right: DataFrame,
    key: str,
    other: str,
    attributes: Sequence[str],
    k: int,
    edge: float,
    geom: str = "geom",
    first_radius: float | None = None,
) -> DataFrame:
    """Nearest right point among those whose hexagon is within ``k`` steps of the feature's hexagon.

    ``left`` carries ``key``, ``geom`` and its cell ``cell``; ``right`` carries ``other``, ``px``,
    ``py``, ``pcell`` and the attributes. Rows without any candidate are absent. A short-radius
    join settles every feature with a close point: any point that near is certainly in the disk.
    The features left over meet the hexagons of their disk, and the points of those that can hold the nearest.
    """
    d = G.point_distance(geom, "px", "py")
    box = geom_box(geom)
    reach = F.hypot(box[2] - box[0], box[3] - box[1])
    slim = left.select(key, geom, "cell", reach.alias("_reach"))
    points = right.select(other, "px", "py", "pcell", *attributes)
    radius = float(first_radius or edge / 4.0)
    close = within_pairs(slim, points, box, point_box("px", "py"), d, radius)
    certain = close.where(F.col("d") + F.col("_reach") <= F.lit(H.inner_radius(k, edge)))
    settled = checkpointed(best_pair(certain, key, other, attributes))
    rest = checkpointed(slim.join(shuffled(settled.select(key)), key, "left_anti"))
    asked = rest.select(key, "cell", _boxed("lbox", box))
    few = candidates_in_disk(asked, points, key, other, lambda rows, cells: hex_disk_pairs(rows, cells, "cell", "pcell", k))
    wide = dealt_join(few.join(shuffled(rest), key), points, [other], key).withColumn("d", d)
    return settled.unionByName(best_pair(wide, key, other, attributes))


def nearest(
    left: DataFrame,
    right: DataFrame,
    left_box: Box,
    right_box: Box,
    distance: Column,
    key: str,
    other: str,
    first_radius: float,
    max_radius: float | None = None,
    growth: float = 4.0,
) -> DataFrame:
    """``(key, other, d)`` of the nearest right feature; ties go to the lowest partner id.

    With ``max_radius`` by widening rings: each round joins only the rows still open, at a radius ``growth`` times the
    last, so crowded areas are settled by small cells and only isolated rows look far. Without it the rows that have
    nothing within ``first_radius`` go down a pyramid of occupied cells, so every row finds its partner and meets near
    features only.
    """
    if max_radius is None:
        pairs = within_pairs(left, right, left_box, right_box, distance, float(first_radius))
        close = checkpointed(best_pair(pairs, key, other, []))
        apart = left.join(shuffled(close.select(key)), key, "left_anti")
        few = candidates(apart, right, left_box, right_box, key, other, float(first_radius))
        far = dealt_join(few.join(shuffled(apart), key), right, [other], key).withColumn("d", distance)
        return close.unionByName(best_pair(far, key, other, []))
    radius, found, open_rows = float(first_radius), [], left
    while True:
        radius = min(radius, max_radius)
        pairs = within_pairs(open_rows, right, left_box, right_box, distance, radius)
        best = best_pair(pairs, key, other, [])
        if radius >= max_radius:
            found.append(best)
            break
        best = checkpointed(best)
        found.append(best)
        open_rows = checkpointed(open_rows.join(shuffled(best.select(key)), key, "left_anti"))
        if open_rows.isEmpty():
            break
        radius *= growth
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


#: A feature whose box has more cells than this goes by its outline.
WIDE_CELLS = 64


def _wide(geom: str, cell: float) -> Column:
    b = geom_box(geom)
    spans = [F.floor(high / F.lit(float(cell))) - F.floor(low / F.lit(float(cell))) + 1 for low, high in ((b[0], b[2]), (b[1], b[3]))]
    return F.coalesce(spans[0].cast("double") * spans[1] > WIDE_CELLS, F.lit(False))


def containing_pairs(
    points: DataFrame,
    polygons: DataFrame,
    x: str,
    y: str,
    geom: str,
    cell: float,
    keys: tuple[str, str] | None = None,
) -> DataFrame:
    """(point, polygon) pairs with the point inside the polygon.

    With ``keys`` (of points and polygons) polygons with many cells go by spans of cells inside and the edges of a row,
    so no outline is copied to the cells it covers.
    """

    def by_box(polygons: DataFrame) -> DataFrame:
        pairs = cell_join(points, polygons, point_box(x, y), geom_box(geom), cell)
        return pairs.where(G.contains_point(geom, x, y))

    if keys is None or polygons.where(_wide(geom, cell)).isEmpty():
        return by_box(polygons)
    wide = polygons.where(_wide(geom, cell))
    found = points_in(points, wide, keys[0], keys[1], x, y, geom, cell).join(shuffled(points), keys[0]).join(shuffled(wide), keys[1])
    return by_box(polygons.where(~_wide(geom, cell))).unionByName(found)


def intersecting_pairs(
    left: DataFrame,
    right: DataFrame,
    left_geom: str,
    right_geom: str,
    cell: float,
    keys: tuple[str, str] | None = None,
) -> DataFrame:
    """Pairs of features that share at least one point.

    With ``keys`` (of both sides) features with many cells go by their outline: the cells along it and the spans inside
    it are keys, not all cells of its box.
    """

    def by_box(left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = cell_join(left, right, geom_box(left_geom), geom_box(right_geom), cell)
        return pairs.where(G.intersects(left_geom, right_geom))

    if keys is None:
        return by_box(left, right)
    one, other = _wide(left_geom, cell), _wide(right_geom, cell)
    if left.where(one).select(F.lit(1)).unionAll(right.where(other).select(F.lit(1))).isEmpty():
        return by_box(left, right)
    ends = (*keys, left_geom, right_geom, cell)
    pairs = outline_pairs(left.where(one), right, *ends).unionByName(outline_pairs(left.where(~one), right.where(other), *ends))
    found = pairs.join(shuffled(left), keys[0]).join(shuffled(right), keys[1])
    return by_box(left.where(~one), right.where(~other)).unionByName(found)


def touching(left: DataFrame, zones: DataFrame, key: str, geom: str, zone_geom: str, cell: float) -> DataFrame:
    """Distinct ``key`` of the features that share a point with some zone; equal zones count as one."""
    named = zones.select(F.struct(F.xxhash64(zone_geom), F.size(zone_geom), F.element_at(zone_geom, 1)).alias("_zone_key"), F.col(zone_geom).alias("_zone_geom"))
    own = left.select(key, F.col(geom).alias("_own_geom"))
    met = intersecting_pairs(own, named.where(F.size("_zone_geom") > 0), "_own_geom", "_zone_geom", cell, (key, "_zone_key"))
    return met.select(key).distinct()


def in_box(geom: str, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """Predicate: the feature meets a literal box; the box test comes first and prunes."""
    b = geom_box(geom)
    boxes = (b[0] <= maxx) & (b[2] >= minx) & (b[1] <= maxy) & (b[3] >= miny)
    box = G.box_edges.sql(*[G.num(v) for v in (minx, miny, maxx, maxy)])
    return boxes & G.intersects(geom, box)
