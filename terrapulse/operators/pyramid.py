"""Unbounded nearest neighbour by a pyramid of occupied cells with distance bounds.

The right side is put into cells of a bottom size, these into cells eight times as wide, and so on up to a handful. A
cell has the box around its features and the box of one of them, its witness: a feature on the left is no nearer to the
cell's features than to the cell's box, and no farther from the nearest than from the witness. The left side goes down
the pyramid with the few cells that these bounds leave, so it meets near features only, however far they are. Boxes are
those of the features themselves: each has a point on every side of its own.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from terrapulse.session import checkpointed, shuffled

#: Cells of a level along each axis of a cell of the next one.
STEP = 8
#: Cells along an axis at the top, whose bounds go into the plan as constants.
TOP = 16
#: Left rows under one key of a join at most; a more crowded key is dealt over copies of the right rows.
DEALT = 5_000
#: Features under a bottom cell at most, as far as ``FINER`` further levels can tell them apart.
CROWD, FINER = 64, 6

Box = tuple[Column, Column, Column, Column]
_BOX = ("x0", "y0", "x1", "y1")


def _boxed(name: str, box: Box) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(box, _BOX, strict=True)]).alias(name)


def _gap(a: Column, b: Column) -> Column:
    """The distance of two boxes."""
    across = F.greatest(b["x0"] - a["x1"], a["x0"] - b["x1"], F.lit(0.0))
    return F.hypot(across, F.greatest(b["y0"] - a["y1"], a["y0"] - b["y1"], F.lit(0.0)))


def _reach(a: Column, b: Column) -> Column:
    """A distance that two features with these boxes don't exceed, a little widened for rounding.

    Both have a point on each side of their box: those on two parallel sides are as far apart as the sides, and along the
    sides at most as far as the boxes reach.
    """

    def apart(low: str, high: str) -> tuple[Column, Column]:
        sides = [F.abs(a[s] - b[t]) for s in (low, high) for t in (low, high)]
        return F.least(*sides), F.greatest(b[high] - a[low], a[high] - b[low])

    (near_x, far_x), (near_y, far_y) = apart("x0", "x1"), apart("y0", "y1")
    return F.least(F.hypot(far_x, near_y), F.hypot(near_x, far_y)) * (1 + 1e-12) + 1e-9


def _cell(size: float, box: str = "rbox") -> list[Column]:
    middle = ((F.col(f"{box}.x0") + F.col(f"{box}.x1")) / 2, (F.col(f"{box}.y0") + F.col(f"{box}.y1")) / 2)
    return [F.floor(m / F.lit(size)).alias(c) for m, c in zip(middle, ("cx", "cy"), strict=True)]


def _around(box: str = "rbox") -> Column:
    low, high = [F.min(f"{box}.{n}").alias(n) for n in _BOX[:2]], [F.max(f"{box}.{n}").alias(n) for n in _BOX[2:]]
    return F.struct(*low, *high).alias("rbox")


def _cells(features: DataFrame, size: float) -> DataFrame:
    """``cx, cy, n, rbox, witness`` of the cells that hold features."""
    placed = features.select(*_cell(size), "rbox")
    return placed.groupBy("cx", "cy").agg(F.count("*").alias("n"), _around(), F.min("rbox").alias("witness"))


def _parents(cells: DataFrame) -> DataFrame:
    """One row for each cell of the next level with its ``children``, at most ``STEP ** 2``."""
    up = [F.floor(F.col(c) / STEP).alias(c) for c in ("cx", "cy")]
    child = F.struct("cx", "cy", "rbox", "witness").alias("child")
    found = cells.select(*up, child, F.col("rbox").alias("box"), F.col("witness").alias("w"))
    return found.groupBy("cx", "cy").agg(F.collect_list("child").alias("children"), _around("box"), F.min("w").alias("witness"))


def _narrowed(rows: DataFrame, key: str) -> DataFrame:
    """``key, lbox, bound, near`` from rows with an array ``found`` of cells: those that ``bound`` leaves."""
    best = F.array_min(F.transform("found", lambda c: _reach(F.col("lbox"), c["witness"])))
    own = rows.withColumn("bound", F.least("bound", best))
    left = F.filter("found", lambda c: _gap(F.col("lbox"), c["rbox"]) <= F.col("bound"))
    return own.withColumn("found", F.transform(left, lambda c: F.struct(c["cx"].alias("cx"), c["cy"].alias("cy"), _gap(F.col("lbox"), c["rbox"]).alias("gap"))))


def dealt_join(many: DataFrame, few: DataFrame, on: list[str], by: str) -> DataFrame:
    """Inner join where any number of rows of ``many`` may share a key: crowded ones are dealt over copies of ``few``.

    Rows far from everything all ask for the same few cells and features.
    """
    many = checkpointed(many)
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > DEALT)
    # One row for every DEALT rows of the left side at most.
    crowded = F.broadcast(checkpointed(counts.select(*on, F.ceil(F.col("_n") / DEALT).cast("int").alias("_parts"))))
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(crowded, on, "left").withColumn("_deal", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = few.join(crowded, on, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(shuffled(right), [*on, "_deal"]).drop("_deal")


def candidates(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, key: str, other: str, bottom: float) -> DataFrame:
    """``key, other`` of pairs among which are the nearest ones of every ``key`` (all of equal distance)."""
    features = checkpointed(right.select(other, _boxed("rbox", right_box)).where(F.col("rbox.x0").isNotNull()))
    seen = Observation()
    cells = checkpointed(_cells(features, bottom).observe(seen, F.max("n").alias("most"), F.count(F.lit(1)).alias("cells")))
    for _ in range(FINER):
        if (seen.get["most"] or 0) <= CROWD:
            break
        bottom, seen = bottom / STEP, Observation()
        cells = checkpointed(_cells(features, bottom).observe(seen, F.max("n").alias("most"), F.count(F.lit(1)).alias("cells")))
    spread = cells.agg(*[f(c) for c in ("cx", "cy") for f in (F.min, F.max)]).first()
    if spread[0] is None:
        return left.select(key).limit(0).join(right.select(other).limit(0))
    levels, ends = [cells], list(spread)
    while max(ends[1] - ends[0], ends[3] - ends[2]) >= TOP:
        levels.append(checkpointed(_parents(levels[-1])))
        ends = [floor(e / STEP) for e in ends]
    # At most (TOP + 1) ** 2 cells.
    top = [(r.cx, r.cy, tuple(r.rbox), tuple(r.witness)) for r in levels[-1].select("cx", "cy", "rbox", "witness").collect()]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    known = left.sparkSession.createDataFrame([(top,)], f"found array<struct<cx:bigint,cy:bigint,rbox:{box},witness:{box}>>")
    start = left.select(key, _boxed("lbox", left_box)).where(F.col("lbox.x0").isNotNull())
    start = start.join(F.broadcast(known))  # one row of bounded size: a constant of every left row
    rows = _narrowed(start.withColumn("bound", F.lit(float("inf"))), key)
    for children in reversed(levels[1:]):
        asked = rows.select(key, "lbox", "bound", F.explode("found").alias("c")).select(key, "lbox", "bound", "c.cx", "c.cy")
        met = dealt_join(asked, children.select("cx", "cy", F.col("children").alias("found")), ["cx", "cy"], key)
        # Each row keeps what its own bound leaves; the cells of one feature then share the best bound.
        part = _narrowed(met, key)
        gathered = part.groupBy(key).agg(F.first("lbox").alias("lbox"), F.min("bound").alias("bound"), F.flatten(F.collect_list("found")).alias("found"))
        rows = gathered.withColumn("found", F.filter("found", lambda c: c["gap"] <= F.col("bound")))
    asked = rows.select(key, "lbox", "bound", F.explode("found").alias("c")).select(key, "lbox", "bound", "c.cx", "c.cy")
    members = features.select(*_cell(bottom), other, "rbox")
    met = dealt_join(asked, members, ["cx", "cy"], key).where(_gap(F.col("lbox"), F.col("rbox")) <= F.col("bound"))
    # The features met bound the distance closer than the witnesses of their cells.
    return closest(met, key, "rbox", "rbox").select(key, other)


def closest(pairs: DataFrame, key: str, sure: str, box: str) -> DataFrame:
    """The pairs of each key whose ``box`` may be as near as the box ``sure`` of some pair certainly is."""
    best = F.min(_reach(F.col("lbox"), F.col(sure))).over(Window.partitionBy(key))
    bounded = pairs.withColumns({"_gap": _gap(F.col("lbox"), F.col(box)), "_best": best})
    return bounded.where(F.col("_gap") <= F.col("_best")).drop("_gap", "_best")


def candidates_in_disk(asked: DataFrame, points: DataFrame, key: str, other: str, pairs) -> DataFrame:
    """``key, other`` among which are the nearest points of every key's disk of hexagons.

    ``asked`` carries ``key, cell, lbox``, ``points`` ``other, px, py, pcell``; ``pairs`` joins rows and hexagons of a
    disk. A row meets the hexagons of its disk as a box and a witness, and points only in those that these leave.
    """
    placed = points.select(other, "pcell", _boxed("rbox", (F.col("px"), F.col("py"), F.col("px"), F.col("py"))))
    hexagons = checkpointed(placed.groupBy("pcell").agg(_around(), F.min("rbox").alias("witness")))
    left = closest(pairs(asked, hexagons), key, "witness", "rbox").select(key, "lbox", "pcell")
    return closest(dealt_join(left, placed, ["pcell"], key), key, "rbox", "rbox").select(key, other)
