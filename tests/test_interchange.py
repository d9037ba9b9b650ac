"""WKB and WKT against bytes and texts written by hand, and round trips."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G
from terrapulse.functions import interchange as I
from terrapulse.sources.vectors import read_vector, with_edges, write_vector

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
HOLE = [(2.0, 2.0), (2.0, 4.0), (4.0, 4.0), (4.0, 2.0), (2.0, 2.0)]
FAR = [(20.0, 0.0), (24.0, 0.0), (24.0, 4.0), (20.0, 0.0)]


def packed(kind, *parts, order="<", flags=0):
    return struct.pack(order + "BI", order == "<", kind | flags) + b"".join(parts)


def count(n, order="<"):
    return struct.pack(order + "I", n)


def spots(path, order="<", z=()):
    return b"".join(struct.pack(f"{order}{2 + len(z)}d", *p, *z) for p in path)


def ring(path, order="<", z=()):
    return count(len(path), order) + spots(path, order, z)


CASES = {
    "polygon": packed(3, count(2), ring(SQUARE), ring(HOLE)),
    "big end first": packed(3, count(2, ">"), ring(SQUARE, ">"), ring(HOLE, ">"), order=">"),
    "the wrong way round": packed(3, count(2), ring(SQUARE[::-1]), ring(HOLE[::-1])),
    "z": packed(1003, count(2), ring(SQUARE, z=(5.0,)), ring(HOLE, z=(5.0,))),
    "z and m": packed(3003, count(2), ring(SQUARE, z=(5.0, 6.0)), ring(HOLE, z=(5.0, 6.0))),
    "z by a flag, with a system": packed(3, count(2154), count(2), ring(SQUARE, z=(5.0,)), ring(HOLE, z=(5.0,)), flags=0xA0000000),
    "one in a collection": packed(7, count(1), packed(3, count(2), ring(SQUARE), ring(HOLE))),
}


@pytest.mark.parametrize("name", CASES)
def test_polygons_with_a_hole(name):
    assert I.read_wkb(CASES[name]) == [SQUARE, HOLE]


def test_other_types():
    multi = packed(6, count(2), packed(3, count(2), ring(SQUARE), ring(HOLE)), packed(3, count(1), ring(FAR[::-1])))
    assert I.read_wkb(multi) == [SQUARE, HOLE, FAR]
    assert I.read_wkb(packed(2, ring(HOLE[:3]))) == [HOLE[:3]]
    assert I.read_wkb(packed(5, count(2), packed(2, ring(HOLE[:3])), packed(2, ring(SQUARE[:2])))) == [HOLE[:3], SQUARE[:2]]
    assert I.read_wkb(packed(4, count(2), packed(1, spots([(1.0, 2.0)])), packed(1, spots([(3.0, 4.0)])))) == [[(1.0, 2.0)], [(3.0, 4.0)]]
    assert I.read_wkb(packed(1, spots([(float("nan"), float("nan"))]))) == []
    assert I.read_wkb(packed(3, count(0))) == []
    with pytest.raises(ValueError):
        I.read_wkb(packed(8, count(0)))


def test_written_types():
    def kind(paths):
        data = I.write_wkb(I.edges_of(paths))
        return struct.unpack_from("<I", data, 1)[0], I.read_wkb(data)

    assert kind([SQUARE, HOLE]) == (I.POLYGON, [SQUARE, HOLE])
    assert kind([SQUARE, FAR, HOLE]) == (I.MULTI_POLYGON, [SQUARE, HOLE, FAR])
    assert kind([[(1.0, 2.0)]]) == (I.POINT, [[(1.0, 2.0)]])
    assert kind([[(1.0, 2.0)], [(3.0, 4.0)]])[0] == I.MULTI_POINT
    assert kind([HOLE[:3]]) == (I.LINE, [HOLE[:3]])
    assert kind([HOLE[:3], SQUARE]) == (I.COLLECTION, [HOLE[:3], SQUARE])
    assert kind([]) == (I.COLLECTION, [])
    island = [(2.5, 2.5), (3.0, 2.5), (3.0, 3.0), (2.5, 2.5)]
    assert kind([SQUARE, HOLE, island]) == (I.MULTI_POLYGON, [SQUARE, HOLE, island])


@settings(max_examples=60, deadline=None)
@given(st.randoms(use_true_random=False))
def test_edges_in_any_order_make_the_same_rings(rng):
    edges = I.edges_of([SQUARE, HOLE, FAR])
    rng.shuffle(edges)
    found = I.walk(edges)
    same = lambda r: min(tuple(r[k:-1] + r[: k + 1]) for k in range(len(r) - 1))
    assert sorted(map(same, found)) == sorted(map(same, [SQUARE, HOLE, FAR]))
    assert I.read_wkb(I.write_wkb(edges)) and len(I.shapes(edges)[2]) == 2


TEXTS = {
    "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))": [SQUARE, HOLE],
    "SRID=2154;polygon z ((0 0 9,0 10 9,10 10 9,10 0 9,0 0 9),(2 2 9, 4 2 9, 4 4 9, 2 4 9, 2 2 9))": [[SQUARE[0], *SQUARE[:0:-1][::-1]], [HOLE[0], *HOLE[1:]]],
    "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2)), ((20 0, 24 0, 24 4, 20 0)))": [SQUARE, HOLE, FAR],
    "LINESTRING M (2 2 1, 2 4 1, 4 4 1)": [HOLE[:3]],
    "MULTILINESTRING ((2 2, 2 4, 4 4), (0 0, 10 0))": [HOLE[:3], SQUARE[:2]],
    "POINT (1.5e1 -2)": [[(15.0, -2.0)]],
    "MULTIPOINT ((1 2), (3 4))": [[(1.0, 2.0)], [(3.0, 4.0)]],
    "MULTIPOINT (1 2, 3 4)": [[(1.0, 2.0)], [(3.0, 4.0)]],
    "POLYGON EMPTY": [],
}


def as_edges(rows):
    return [tuple(e) for e in rows]


def test_texts(spark):
    df = spark.createDataFrame([(k,) for k in TEXTS] + [(None,)], "wkt string")
    got = {r.wkt: r.geom for r in df.select("wkt", I.wkt_edges("wkt").alias("geom")).collect()}
    assert got.pop(None) is None
    for text, paths in TEXTS.items():
        assert as_edges(got[text]) == [tuple(e.values()) for e in I.edges_of(paths)], text


@pytest.mark.parametrize("encoding", ["wkb", "wkt"])
def test_layers_round_trip(spark, tmp_path, encoding):
    rng = random.Random(3)
    shapes = {1: [SQUARE, HOLE], 2: [SQUARE, HOLE, FAR], 3: [HOLE[:3]], 4: [[(0.1 + 0.2, -1e-7)]], 5: None}
    shapes |= {k: [[(x := rng.uniform(-1e6, 1e6), y := rng.uniform(0, 7e6)), (x + 3.3, y), (x + 1, y + 2), (x, y)]] for k in range(10, 40)}
    rows = [(k, None if p is None else [tuple(e.values()) for e in I.edges_of(p)], "x") for k, p in shapes.items()]
    layer = spark.createDataFrame(rows, f"id int, geom {G.EDGES_TYPE}, geometry_ string").repartition(4)
    path = f"{tmp_path}/layer.parquet"
    write_vector(layer, path, encoding)
    stored = spark.read.parquet(path)
    assert dict(stored.dtypes)["geometry"] == ("binary" if encoding == "wkb" else "string")
    back = read_vector(spark, path)
    assert back.columns == layer.columns
    assert {r.id: r.geom and as_edges(r.geom) for r in back.collect()} == {k: g for k, g, _ in rows}
    area = back.where("id = 2").select(G.area("geom")).first()[0]
    assert area == 100 - 4 + 8


def test_a_layer_of_edges_stays(spark):
    layer = spark.createDataFrame([(1, [(0.0, 0.0, 1.0, 1.0)])], f"id int, geom {G.EDGES_TYPE}")
    assert with_edges(layer).collect() == layer.collect()
    with pytest.raises(ValueError):
        write_vector(layer, "/nowhere", "shape")
    assert with_edges(layer.select("id", F.lit(None).cast("binary").alias("wkb"))).first().geom is None
