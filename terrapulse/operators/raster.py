"""Grid jobs on long tables: one row per cell, keyed by integer ``(col, row)``.

Cell ``(col, row)`` covers ``[col*step, (col+1)*step) x [row*step, (row+1)*step)``; rows count
upwards. Polygons become cells by scan-lines, so a polygon costs its rows times its edges and not
its cells times its edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions.scoring import clip01
from terrapulse.operators.unnest import unnest
from terrapulse.session import shuffled


#: Columns of a tile of the distance transform.
TILE_COLS = 64


def grid(
    spark: SparkSession, minx: float, miny: float, maxx: float, maxy: float, step: float
) -> DataFrame:
    """Cells covering a box: ``(col, row, x, y)`` with 0-based indexes and cell centres.

    At least one cell in each direction; rows count down from the top edge, as rasters do.
    """
    width = max(1, math.ceil((maxx - minx) / step))
    height = max(1, math.ceil((maxy - miny) / step))
    cells = spark.range(width * height)
    col, row = F.col("id") % width, F.floor(F.col("id") / width)
    return cells.select(
        col.alias("col"),
        row.alias("row"),
        (F.lit(float(minx)) + (col + F.lit(0.5)) * F.lit(float(step))).alias("x"),
        (F.lit(float(maxy)) - (row + F.lit(0.5)) * F.lit(float(step))).alias("y"),
    )


def total_bounds(df: DataFrame, geom: str = "geom") -> DataFrame:
    b = G.bounds(geom)
    return df.agg(
        F.min(b["minx"]).alias("minx"),
        F.min(b["miny"]).alias("miny"),
        F.max(b["maxx"]).alias("maxx"),
        F.max(b["maxy"]).alias("maxy"),
    )


def _center(index: str, step: float) -> str:
    """SQL text of the centre coordinate of a cell index."""
    return f"(({index} + 0.5D) * {G.num(step)})"


def _first_center(at: Column, step: float) -> Column:
    """Lowest index whose cell centre is at or after ``at``."""
    return F.ceil(at / F.lit(float(step)) - F.lit(0.5))


def _scan_rows(df: DataFrame, geom: str, step: float) -> DataFrame:
    b = G.bounds(geom)
    rows = F.sequence(_first_center(b["miny"], step), _first_center(b["maxy"], step))
    return unnest(df, rows, "row")


def burn_centers(df: DataFrame, geom: str, step: float) -> DataFrame:
    """``df`` (without ``geom``) once per cell whose centre lies in the polygon."""
    lined = _scan_rows(df, geom, step)
    hits = G.scan_hits.sql(geom, _center("row", step))
    spans = unnest(lined, G.span_pairs(hits), "_s").drop(geom)
    bounded = spans.withColumns(
        {
            "_lo": _first_center(F.col("_s.a"), step),
            "_hi": _first_center(F.col("_s.b"), step) - 1,
        }
    ).where(F.col("_lo") <= F.col("_hi"))
    return unnest(bounded, F.sequence("_lo", "_hi"), "col").drop("_s", "_lo", "_hi")


def burn_edges(df: DataFrame, geom: str, step: float) -> DataFrame:
    """``df`` (without ``geom``) once per cell an edge of the feature passes through."""
    cell = F.lit(float(step))
    edges = unnest(df, F.col(geom), "_e").drop(geom)
    e = F.col("_e")
    low = F.least(e.getField("y1"), e.getField("y2"))
    high = F.greatest(e.getField("y1"), e.getField("y2"))
    rows = unnest(edges, F.sequence(F.floor(low / cell), F.floor(high / cell)), "row")
    dy = F.nullif(e.getField("y2") - e.getField("y1"), F.lit(0.0))
    bottom = F.greatest(low, F.col("row") * cell)
    top = F.least(high, (F.col("row") + 1) * cell)

    def x_at(y: Column) -> Column:
        t = (y - e.getField("y1")) / dy
        return e.getField("x1") + t * (e.getField("x2") - e.getField("x1"))

    ends = (
        F.coalesce(x_at(bottom), e.getField("x1")),
        F.coalesce(x_at(top), e.getField("x2")),
    )
    cols = F.sequence(F.floor(F.least(*ends) / cell), F.floor(F.greatest(*ends) / cell))
    return unnest(rows, cols, "col").drop("_e")


def burn_touched(df: DataFrame, geom: str, step: float) -> DataFrame:
    """All-touched burn: the centre rule or an edge through the cell."""
    return burn_centers(df, geom, step).unionByName(burn_edges(df, geom, step))


def rasterize_zones(zones: DataFrame, zone_idx: str, geom: str, step: float) -> DataFrame:
    """``(col, row, zone_idx)`` with every touched cell; the later (higher) zone wins."""
    cells = burn_touched(zones.select(zone_idx, geom), geom, step)
    return cells.groupBy("col", "row").agg(F.max(zone_idx).alias(zone_idx))


def presence_mask(features: DataFrame, geom: str, step: float, lines: bool = False) -> DataFrame:
    """Distinct cells covered by polygons (centre rule) or crossed by lines."""
    burn = burn_edges if lines else burn_centers
    return burn(features.select(geom), geom, step).distinct()


def cells_within(df: DataFrame, geom: str, radius: float, step: float) -> DataFrame:
    """``df`` once per cell whose centre is within ``radius`` of the feature."""
    b = G.bounds(geom)
    r = F.lit(float(radius))

    def span(lo: Column, hi: Column) -> Column:
        return F.sequence(_first_center(lo - r, step), _first_center(hi + r, step))

    lined = unnest(df, span(b["miny"], b["maxy"]), "row")
    near = unnest(lined, span(b["minx"], b["maxx"]), "col")
    d = G.point_distance(geom, _center("col", step), _center("row", step))
    return near.where(d <= r).drop(geom)


#: Cells along a side of the blocks by which features are kept from cells that nobody asks for.
BLOCK_CELLS = 32
#: Metres by which a reach along a row is narrowed for cells that need no test, and widened for those that are tested.
MARGIN = 1e-3


def cells_within_of(df: DataFrame, geom: str, radius: float, step: float, wanted: DataFrame) -> DataFrame:
    """``cells_within`` for the blocks that hold ``wanted`` cells (``col, row``), each feature cut into its blocks.

    A feature far from all of them is never unfolded into cells. Along a row of cells the reach of each edge is an interval
    and so is each stretch inside the feature; only cells at the very ends of the intervals are tested one by one.
    """
    b = G.bounds(geom)
    r, side = F.lit(float(radius)), F.lit(BLOCK_CELLS)
    blocks = wanted.select(F.floor(F.col("col") / side).alias("_bc"), F.floor(F.col("row") / side).alias("_br")).distinct()

    def ends(lo: Column, hi: Column) -> tuple[Column, Column]:
        return _first_center(lo - r, step), _first_center(hi + r, step)

    rows, cols = ends(b["miny"], b["maxy"]), ends(b["minx"], b["maxx"])

    def within_block(ends: tuple[Column, Column], block: str) -> Column:
        low = F.greatest(ends[0], F.col(block) * side)
        high = F.least(ends[1], (F.col(block) + 1) * side - 1)
        return F.sequence(low, high)

    cut = unnest(df, F.sequence(*[F.floor(e / side) for e in rows]), "_br")
    cut = unnest(cut, F.sequence(*[F.floor(e / side) for e in cols]), "_bc")
    kept = cut.join(shuffled(blocks), ["_bc", "_br"], "left_semi")
    lined = unnest(kept, within_block(rows, "_br"), "row").withColumn("_y", F.expr(_center("row", step)))

    def cells(reach: float) -> Column:
        """The columns of the block whose centres lie in an interval."""
        edges = f"filter(transform({geom}, e_cw -> {G.near_reach.sql('_y', 'e_cw', reach)}), s_cw -> s_cw.a IS NOT NULL)"
        spans = F.concat(F.expr(edges), G.span_pairs(G.scan_hits.sql(geom, "_y")))
        ends = F.transform(
            spans,
            lambda s: F.struct(
                F.greatest(_first_center(s["a"], step), F.col("_bc") * side).alias("a"),
                F.least(F.floor(s["b"] / F.lit(float(step)) - F.lit(0.5)), (F.col("_bc") + 1) * side - 1).alias("b"),
            ),
        )
        some = F.filter(ends, lambda s: s["a"] <= s["b"])
        return F.array_distinct(F.flatten(F.transform(some, lambda s: F.sequence(s["a"], s["b"]))))

    sure, most = cells(max(0.0, radius - MARGIN)), cells(radius + MARGIN)
    tested = f"filter(array_except(_most, _sure), c_cw -> {G.point_distance.sql(geom, _center('c_cw', step), '_y')} <= {G.num(radius)})"
    found = lined.withColumn("_sure", sure).withColumn("_most", most)
    return unnest(found, F.concat("_sure", F.expr(tested)), "col").drop(geom, "_bc", "_br", "_y", "_sure", "_most")


def slope_percent(elevation: DataFrame, step: float) -> DataFrame:
    """``(col, row, slope)`` of a dense elevation table ``(col, row, z)``.

    Central differences inside, one-sided at the border; a missing neighbour gives 0.
    """

    def gradient(along: str, across: str) -> Column:
        order = Window.partitionBy(across).orderBy(along)
        here = F.struct(F.col(along).alias("i"), F.col("z").alias("z"))
        prev = F.coalesce(F.lag(here).over(order), here)
        following = F.coalesce(F.lead(here).over(order), here)
        rise = following.getField("z") - prev.getField("z")
        run = (following.getField("i") - prev.getField("i")) * F.lit(float(step))
        return rise / F.nullif(run.cast("double"), F.lit(0.0))

    slopes = elevation.withColumn("_gx", gradient("col", "row")).withColumn(
        "_gy", gradient("row", "col")
    )
    steep = F.hypot("_gx", "_gy") * F.lit(100.0)
    return slopes.select("col", "row", F.coalesce(steep, F.lit(0.0)).alias("slope"))


def access_from_cells(
    cells: DataFrame, road_cells: DataFrame, step: float, max_m: float = 500.0
) -> DataFrame:
    """Adds ``access = clip(1 - d/max_m, 0, 1)`` with ``d`` the distance to the nearest road cell.

    Separable distance: the nearest road column within each grid row comes from two ordered
    windows; the best of the rows no further than ``max_m`` (further ones score 0 anyway) is found
    within tiles. A cell is copied to its own tile and, near its rim, to the one beside, so rows
    follow the cells whatever the reach. No road at all gives 0 everywhere.
    """
    reach = int(math.floor(max_m / step))
    height = max(256, 4 * reach)
    marked = cells.join(road_cells.withColumn("_road", F.lit(True)), ["col", "row"], "left")
    order = Window.partitionBy("row").orderBy("col")
    here = F.when(F.col("_road"), F.col("col"))
    left = F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(here, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    along = F.least(F.col("col") - left, right - F.col("col")).cast("long")
    per_row = marked.select(F.col("col").cast("long"), F.col("row").cast("long"), along.alias("dx")).where(F.col("dx") <= reach)
    ends = [F.floor((F.col("row") + d) / height) for d in (-reach, reach)]
    tiled = per_row.withColumn("_tr", F.explode(F.sequence(*ends))).withColumn("_tc", F.floor(F.col("col") / TILE_COLS))
    nearest = tiled.groupBy("_tc", "_tr").applyInArrow(_column_distances(reach, height), "col long, row long, d2 long")
    d = F.sqrt("d2") * F.lit(float(step))
    score = clip01(F.lit(1.0) - d / F.lit(float(max_m)))
    return cells.join(nearest, ["col", "row"], "left").withColumn(
        "access", F.coalesce(score, F.lit(0.0))
    ).drop("d2")


def _column_distances(reach: int, height: int):
    """For a tile the smallest ``dx ** 2 + dy ** 2`` at each of its cells, as the lower envelope of parabolas.

    Sweeps over the tile's columns side by side: of each column the parabolas that are lowest somewhere are kept with
    the rows from where on they are, then every row reads its own.
    """

    def work(key, table):
        import numpy as np
        import pyarrow as pa

        col, row = (table[c].to_numpy().astype("int64") for c in ("col", "row"))
        square = table["dx"].to_numpy().astype("float64") ** 2
        first, low, count = int(col.min()), int(key[1].as_py()) * height - reach, height + 2 * reach
        lanes = np.arange(int(col.max()) - first + 1)
        depth = np.full((count, len(lanes)), np.inf)
        depth[row - low, col - first] = square
        spot, begin = np.zeros((len(lanes), count), int), np.full((len(lanes), count + 1), np.inf)
        top = np.full(len(lanes), -1)
        for at in range(count):
            live = lanes[np.isfinite(depth[at])]
            while len(live):
                held = top[live] >= 0
                under = spot[live, np.maximum(top[live], 0)]
                cross = ((depth[at, live] + at * at) - (depth[under, live] + under * under)) / np.maximum(2.0 * (at - under), 1)
                cross[~held] = -np.inf
                hidden = held & (cross <= begin[live, np.maximum(top[live], 0)])
                top[live[hidden]] -= 1
                done = live[~hidden]
                top[done] += 1
                spot[done, top[done]], begin[done, top[done]] = at, cross[~hidden]
                live = live[hidden]
        out, now = [], np.zeros(len(lanes), int)
        some = lanes[top >= 0]
        for at in range(reach, reach + height):
            while True:
                more = some[(now[some] < top[some]) & (begin[some, np.minimum(now[some] + 1, count)] < at)]
                if not len(more):
                    break
                now[more] += 1
            best = spot[some, now[some]]
            d2 = depth[best, some] + (at - best) ** 2
            near = d2 <= reach * reach
            out.append((some[near] + first, np.full(near.sum(), at + low), d2[near].astype("int64")))
        parts = [np.concatenate(c).astype("int64") for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("col", "row", "d2"), parts, strict=True)))

    return work


def resample_bilinear(
    source: DataFrame, target: DataFrame, source_step: float, origin_x: float = 0.0,
    origin_y: float = 0.0, value: str = "z",
) -> DataFrame:
    """Value of ``source`` at the target cell centres ``(x, y)``; missing gives 0.

    Each target cell asks for its four source cells; the weights are normalised over those that
    hold a value.
    """
    fx = (F.col("x") - F.lit(float(origin_x))) / F.lit(float(source_step)) - F.lit(0.5)
    fy = (F.col("y") - F.lit(float(origin_y))) / F.lit(float(source_step)) - F.lit(0.5)
    wx, wy = fx - F.floor(fx), fy - F.floor(fy)
    corners = F.array(
        *[
            F.struct(
                (F.floor(fx) + i).alias("scol"),
                (F.floor(fy) + j).alias("srow"),
                ((wx if i else F.lit(1.0) - wx) * (wy if j else F.lit(1.0) - wy)).alias("w"),
            )
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    asked = target.select("col", "row", "x", "y", F.explode(corners).alias("c")).select(
        "col", "row", "x", "y", "c.scol", "c.srow", "c.w"
    )
    held = source.select(F.col("col").alias("scol"), F.col("row").alias("srow"), F.col(value).alias("_z"))
    met = asked.join(held, ["scol", "srow"], "left")
    weight = F.sum(F.when(F.col("_z").isNotNull(), F.col("w")))
    summed = F.sum(F.col("w") * F.col("_z")) / F.nullif(weight, F.lit(0.0))
    return met.groupBy("col", "row", "x", "y").agg(F.coalesce(summed, F.lit(0.0)).alias(value))


def exclusion_cells(buildings: DataFrame, geom: str, step: float, radius: float = 100.0) -> DataFrame:
    """Distinct cells whose centre is within ``radius`` of a building."""
    return cells_within(buildings.select(geom), geom, radius, step).distinct()
