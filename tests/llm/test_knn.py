import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapulse.llm.knn import products, runs, top, voronoi_top_k
from terrapulse.llm.vectors import integer_vectors

SCHEMA = "vec_id long, embedding array<double>"


def asked(df):
    return df.withColumn("is_query", F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


def brute(rows, k=5, scale=256):
    """The contract, pair by pair; rows are told apart by their place."""
    whole = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, (own, x) in enumerate(whole):
        if own is None or own % 50:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for p, (i, y) in enumerate(whole) if p != q]
        out += [(own, r, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(df, **sizes):
    return sorted(map(tuple, voronoi_top_k(asked(integer_vectors(df, 256)), **sizes).collect()), key=str)


def clustered(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dim))
    return [(i, (centres[rng.integers(12)] * rng.uniform(0.5, 2) + rng.normal(0, 0.05, dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"pivots": 9, "query_values": 24, "data_values": 160}, {"pivots": 1}, {"pivots": 64, "query_values": 8}])
def test_against_all_pairs(spark, sizes):
    rows = clustered(600, 8)
    assert got(spark.createDataFrame(rows, SCHEMA), **sizes) == brute(rows)


def test_a_third_of_the_rows_alike_and_ties(spark):
    rows = clustered(300, 6, 2) + [(i, [0.5, -0.25, 0.125, 1.0, 0.0, 0.75]) for i in range(300, 450)]
    random.Random(4).shuffle(rows)
    assert got(spark.createDataFrame(rows, SCHEMA), pivots=8, query_values=12, data_values=60) == brute(rows)


def test_edges(spark):
    rows = clustered(120, 4, 3)
    rows += [(50, [1.0, 0.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0, 0.0]), (None, [3.0, 3.0, 3.0, 3.0]), (200, [0.0] * 4), (150, [])]
    rows += [(250, None), (300, [None, 1.0, 1.0, 1.0]), (350, [float("nan"), 1.0, 1.0, 1.0]), (400, [float("inf"), 1.0, 1.0, 1.0]), (450, [2.0]), (500, [1.0, 2.0, 0.5, 0.25, 7.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as vector", "2 as row", "'x' as cell", "3 as is_query_", "4 as rank")
    assert got(df, pivots=5) == brute(rows)


def test_few_rows_and_none(spark):
    few = [(0, [1.0, 2.0]), (7, [0.5, 0.5]), (9, [-1.0, 3.0])]
    assert got(spark.createDataFrame(few, SCHEMA)) == brute(few)
    assert got(spark.createDataFrame(few[:1], SCHEMA)) == []
    assert got(spark.createDataFrame(few[1:], SCHEMA)) == []
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_values_beyond_doubles(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((1e6, 3e6 + 0.25, -2e6)) * rng.uniform(0.9, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, [1e30, 1.0, -1e30, 5.0]), (101, [1e30, 2.0, 1e30, 7.0]), (102, [1e200, 1.0, 1.0, 1.0])]
    limit = (1 << 63) - 1

    def held(found):
        return [(q, r, i, max(-limit - 1, min(limit, s))) for q, r, i, s in found]

    some = rows[:60]
    assert got(spark.createDataFrame(some, SCHEMA)) == sorted(held(brute(some)), key=str)
    found = got(spark.createDataFrame(rows, SCHEMA))
    assert len(found) == 15 and all(-limit - 1 <= s <= limit for *_, s in found)
    assert [r[2] for r in sorted(r for r in found if r[0] == 100)][0] in {i for i, _ in rows}


def test_only_near_cells_are_copied(spark):
    """Far clusters: the bounds must leave most of the copies out."""
    from terrapulse.llm import knn

    rng = np.random.default_rng(8)
    rows = [(i, (np.eye(6)[i % 6] * 100 + rng.normal(0, 0.5, 6)).tolist()) for i in range(1200)]
    seen = []

    def counted(*given):
        work = solve(*given)

        def count(queries, data):
            copies.add(data.num_rows)
            return work(queries, data)

        return count

    solve, copies = knn.solve, spark.sparkContext.accumulator(0)
    knn.solve = counted
    try:
        found = got(spark.createDataFrame(rows, SCHEMA), pivots=36, query_values=24)
    finally:
        knn.solve = solve
    assert found == brute(rows) and not seen
    assert 0 < copies.value < 3 * len(rows)  # six or more groups of queries, so all copies would be 7200 and more


def test_products_and_top():
    big = np.array([[2.0**40, 3.0], [1.0, -5.0]])
    assert products(big, big).tolist() == [[min((1 << 80) + 9, (1 << 63) - 1), (1 << 40) - 15], [(1 << 40) - 15, 26]]
    scores = np.array([[1.0, 3.0, 3.0, -np.inf, 3.0], [5.0, 5.0, 1.0, 5.0, 5.0]])
    for factor in (1.0, 2.0**60):
        spots, values = top(scores * factor, 2)
        assert [sorted(r) for r in spots.tolist()] == [[1, 2], [0, 1]] and (values == [[3 * factor] * 2, [5 * factor] * 2]).all()


def test_runs():
    assert runs([2, 0, 1, 3], {0: 4, 1: 90, 2: 5, 3: 1}, 10) == {2: 0, 0: 0, 1: 1, 3: 2}
