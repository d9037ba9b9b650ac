"""Outline joins, the pyramid of cells, against plain geometry on pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.operators import cover as C
from terrapulse.operators import pyramid as P
from terrapulse.operators import spatial as SP

SEGMENT = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def edges(*rings):
    return [tuple(map(float, (*a, *b))) for ring in rings for a, b in zip(ring, ring[1:])]


def closed_ring(points):
    return [*points, points[0]]


def star(cx, cy, inner, outer, n, turn):
    """A concave outline with ``n`` points."""
    at = [(turn + math.pi * k / n, outer if k % 2 else inner) for k in range(2 * n)]
    return closed_ring([(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in at])


def layer(spark, shapes, key):
    return spark.createDataFrame(list(shapes.items()), f"{key} string, geom {SEGMENT}")


def side(ax, ay, bx, by, x, y):
    d = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    return (d > 0) - (d < 0)


def meets(e, f):
    boxes = all(min(p[k], p[k + 2]) <= max(q[k], q[k + 2]) for k in (0, 1) for p, q in ((e, f), (f, e)))
    return boxes and side(*e, *f[:2]) * side(*e, *f[2:]) <= 0 and side(*f, *e[:2]) * side(*f, *e[2:]) <= 0


def inside(shape, x, y):
    if abs(sum(e[2] - e[0] for e in shape)) + abs(sum(e[3] - e[1] for e in shape)) > 1e-6:
        return False  # an open line
    return sum((e[1] > y) != (e[3] > y) and x < e[0] + (y - e[1]) * (e[2] - e[0]) / (e[3] - e[1]) for e in shape) % 2 == 1


def touch(a, b):
    starts = [[e[:2] for i, e in enumerate(s) if i == 0 or s[i - 1][2:] != e[:2]] for s in (a, b)]
    return any(meets(e, f) for e in a for f in b) or any(inside(b, *p) for p in starts[0]) or any(inside(a, *p) for p in starts[1])


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(5)
    one = {f"s{i}": edges(star(rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(5, 60), rng.uniform(60, 250), rng.randint(3, 7), rng.random())) for i in range(25)}
    one["ring"] = edges(closed_ring([(100, 100), (800, 150), (820, 790), (90, 760)]), closed_ring([(200, 200), (210, 700), (700, 690), (680, 220)]))
    one["line"] = edges([(-50.0, 400.0), (300.0, 420.0), (960.0, 30.0)])
    one["islands"] = edges(closed_ring([(-900, -900), (-890, -900), (-890, -890)]), closed_ring([(450, 450), (455, 450), (455, 455)]))
    other = {f"b{i}": edges(closed_ring([(x := rng.uniform(0, 900), y := rng.uniform(0, 900)), (x + 12, y + 3), (x + 9, y + 15), (x - 2, y + 11)])) for i in range(120)}
    other["on side"] = edges(closed_ring([(100, 100), (100, 90), (110, 90)]))
    other["grid"] = edges(closed_ring([(64.0, 64.0), (128.0, 64.0), (128.0, 128.0), (64.0, 128.0)]))
    return one, other


@pytest.mark.parametrize("cell", [16.0, 40.0, 5000.0])
def test_pairs_that_touch(spark, shapes, cell):
    one, other = shapes
    want = sorted((a, b) for a, x in one.items() for b, y in other.items() if touch(x, y))
    left, right = layer(spark, one, "a"), layer(spark, other, "b").withColumnRenamed("geom", "g")
    got = C.outline_pairs(left, right, "a", "b", "geom", "g", cell)
    assert sorted(map(tuple, got.collect())) == want
    both = SP.intersecting_pairs(left, right, "geom", "g", cell, ("a", "b"))
    assert sorted(map(tuple, both.select("a", "b").collect())) == want and both.columns == ["a", "geom", "b", "g"]
    met = SP.touching(right, left, "b", "g", "geom", cell)
    assert sorted(r.b for r in met.collect()) == sorted({b for _, b in want})


@pytest.mark.parametrize("cell", [8.0, 64.0])
def test_points_in_outlines(spark, shapes, cell):
    one, _ = shapes
    rng = random.Random(6)
    spots = [(i, rng.uniform(-50, 950), rng.uniform(-50, 950)) for i in range(800)] + [(900, 64.0, 64.0), (901, 450.0, 128.0)]
    points, polygons = spark.createDataFrame(spots, "i int, x double, y double"), layer(spark, one, "a")
    want = sorted((i, a) for i, x, y in spots for a, s in one.items() if inside(s, x, y))
    assert sorted(map(tuple, C.points_in(points, polygons, "i", "a", "x", "y", "geom", cell).collect())) == want
    pairs = SP.containing_pairs(points, polygons.where("a <> 'line'"), "x", "y", "geom", cell, ("i", "a"))
    assert sorted(map(tuple, pairs.select("i", "a").collect())) == want
    near = C.points_near_edges(points, polygons, "i", "x", "y", "geom", 20.0).distinct()

    def gap(e, x, y):
        dx, dy = e[2] - e[0], e[3] - e[1]
        t = max(0, min(1, ((x - e[0]) * dx + (y - e[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x - e[0] - t * dx, y - e[1] - t * dy)

    assert sorted(r.i for r in near.collect()) == [i for i, x, y in spots if any(gap(e, x, y) <= 20 for s in one.values() for e in s)]


def test_keys_of_a_long_line_follow_its_length(spark):
    for km in (7, 70):
        line = layer(spark, {"l": edges([(0.0, 0.0), (km * 700.0, km * 714.0)])}, "a")
        cells = C.edge_cells(line, "a", "geom", 100.0).count()
        assert 7 * km < cells < 30 * km  # a box would have 490 and 49 000 for each kilometre


def test_a_country_is_covered_by_its_rim(spark):
    size = 400_000.0
    country = layer(spark, {"c": edges(star(0, 0, size / 2, size, 9, 0.1))}, "a")
    rows = C.row_covers(country, "a", "geom", 1000.0)
    blocks = rows.select(F.explode(F.expr(f"flatten(transform(inside, s -> {C._blocks('s')}))")).alias("b")).select("b.*")
    counts = blocks.agg(F.count("*"), F.sum(F.expr(f"bigint(power({C.RADIX}, power))"))).first()
    area = abs(sum(e[0] * e[3] - e[2] * e[1] for e in edges(star(0, 0, size / 2, size, 9, 0.1)))) / 2 / 1e6
    assert counts[0] < 30_000 < 200_000 < counts[1] < area  # some thousand cells of the rim are not inside as a whole
    centre = spark.createDataFrame([(1, 10.0, 20.0), (2, size, size)], "i int, x double, y double")
    assert [r.i for r in C.points_in(centre, country, "i", "a", "x", "y", "geom", 1000.0).collect()] == [1]


def test_blocks_make_up_a_span(spark):
    rng = random.Random(1)
    spans = [(a := rng.randint(-(8**7), 8**7), a + rng.choice((0, 1, 7, 8, 63, 600, 5000, 10**6))) for _ in range(200)]
    rows = spark.createDataFrame(spans, "x0 long, x1 long").select("x0", "x1", F.expr(C._blocks("struct(x0, x1)")).alias("b")).collect()
    for r in rows:
        held = sorted((b["at"] * 8 ** b.power, (b["at"] + 1) * 8 ** b.power) for b in r.b)
        assert held[0][0] == r.x0 and held[-1][1] == r.x1 + 1 and all(a[1] == b[0] for a, b in zip(held, held[1:]))
        assert len(held) <= 14 * 7


def test_a_crowded_cell_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL_PAIRS", 500)
    rng = random.Random(2)
    def small():
        x, y = rng.uniform(1, 95), rng.uniform(1, 95)
        return edges(closed_ring([(x, y), (x + 4, y + 1), (x + 1, y + 4)]))
    one, other = {f"a{i}": small() for i in range(60)}, {f"b{i}": small() for i in range(60)}
    left, right = layer(spark, one, "a"), layer(spark, other, "b").withColumnRenamed("geom", "g")
    cells = C.edge_cells(left, "a", "geom", 100.0), C.edge_cells(right, "b", "g", 100.0).withColumnRenamed("e", "f")
    dealt = C._dealt(*cells)
    loads = [{r.deal: r["count"] for r in d.groupBy("deal").count().collect()} for d in dealt]
    assert len(loads[0]) > 40 and max(loads[0][k] * loads[1][k] for k in loads[0]) <= 5 * 500
    got = C.outline_pairs(left, right, "a", "b", "geom", "g", 100.0)
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a, x in one.items() for b, y in other.items() if touch(x, y))


def points(spark, rows, names):
    return spark.createDataFrame(rows, f"{names[0]} int, {names[1]} double, {names[2]} double")


def test_far_neighbours_meet_few_candidates(spark):
    rng = random.Random(3)
    lone = [(i, 4e6 + rng.uniform(0, 9e5), rng.uniform(0, 9e5)) for i in range(5000)]
    # A third of the targets in one spot, the rest in towns.
    towns = [(rng.uniform(0, 2e6), rng.uniform(0, 9e5)) for _ in range(30)]
    targets = [(i, 1234.5, 777.25) if i % 3 == 0 else (i, (t := rng.choice(towns))[0] + rng.gauss(0, 800), t[1] + rng.gauss(0, 800)) for i in range(1000)]
    left, right = points(spark, lone, ("l", "lx", "ly")), points(spark, targets, ("r", "px", "py"))
    pairs = P.candidates(left, right, SP.point_box("lx", "ly"), SP.point_box("px", "py"), "l", "r", 50.0)
    rows = pairs.groupBy("l").count().agg(F.count("*"), F.sum("count")).first()
    assert rows[0] == 5000 and rows[1] < 3 * 5000
    found = SP.nearest(left, right, SP.point_box("lx", "ly"), SP.point_box("px", "py"), F.hypot(F.col("lx") - F.col("px"), F.col("ly") - F.col("py")), "l", "r", 50.0)
    best = {i: min((math.hypot(x - a, y - b), k) for k, a, b in targets) for i, x, y in lone[:400]}
    got = {r.l: (r.d, r.r) for r in found.collect()}
    assert len(got) == 5000
    assert all(abs(got[i][0] - d) < 1e-6 and got[i][1] == k for i, (d, k) in best.items())


def test_nearest_outlines_of_any_size(spark, shapes):
    one, other = shapes
    far = {k: [(x1 + 5000, y1, x2 + 5000, y2) for x1, y1, x2, y2 in s] for k, s in list(other.items())[:20]}
    left, right = layer(spark, {**other, **{f"far {k}": s for k, s in far.items()}}, "b"), layer(spark, one, "a").withColumnRenamed("geom", "g")
    got = SP.nearest(left, right, SP.geom_box("geom"), SP.geom_box("g"), G.distance("geom", "g"), "b", "a", 1.0)
    pairs = left.join(right, F.lit(True)).select("b", "a", G.distance("geom", "g").alias("d"))
    want = {r.b: (r.best.d, r.best.a) for r in pairs.groupBy("b").agg(F.min(F.struct("d", "a")).alias("best")).collect()}
    assert {r.b: (r.d, r.a) for r in got.collect()} == want


def test_no_features_and_no_geometry(spark):
    left, none = points(spark, [(1, 2.0, 3.0), (2, None, 1.0)], ("l", "lx", "ly")), points(spark, [], ("r", "px", "py"))
    distance = F.hypot(F.col("lx") - F.col("px"), F.col("ly") - F.col("py"))
    assert SP.nearest(left, none, SP.point_box("lx", "ly"), SP.point_box("px", "py"), distance, "l", "r", 5.0).count() == 0
    some = points(spark, [(7, 500.0, 3.0), (8, None, None)], ("r", "px", "py"))
    got = SP.nearest(left, some, SP.point_box("lx", "ly"), SP.point_box("px", "py"), distance, "l", "r", 5.0)
    assert [(r.l, r.r, r.d) for r in got.collect()] == [(1, 7, 498.0)]


def test_bound_of_far_boxes_is_close(spark):
    """Two features in these boxes are no farther apart, and far boxes give no more than their gap and the way aside."""
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rng = random.Random(4)

    def feature(x, y):
        return [(x + rng.uniform(0, 40), y + rng.uniform(0, 40)) for _ in range(3)]

    def around(spots):
        return tuple(f(s[i] for s in spots) for f in (min, max) for i in (0, 1))

    pairs = [(feature(0, 0), feature(rng.uniform(-90, 90), rng.uniform(-90, 90))) for _ in range(300)]
    rows = [(around(a), around(b), min(math.dist(p, q) for p in a for q in b)) for a, b in pairs]
    rows.append(((0.0, 100_000.0, 40.0, 100_040.0), (0.0, 0.0, 10.0, 14.0), 99_986.0))
    got = spark.createDataFrame(rows, f"a {box}, b {box}, d double").select("d", P._reach(F.col("a"), F.col("b")).alias("reach")).collect()
    assert all(r.d <= r.reach for r in got)
    assert got[-1].reach < got[-1].d + 0.1
