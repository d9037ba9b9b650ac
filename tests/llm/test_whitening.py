import math
from fractions import Fraction

import numpy as np
import pytest

from terrapulse.llm.vectors import integer_vectors
from terrapulse.llm.whitening import centred, squares, whiten

SCHEMA = "vec_id long, embedding array<double>"


def whole(rows):
    """The x-vectors of the contract, by Python's integers."""
    dim = max((len(v) for _, v in rows if v is not None), default=0)
    fit = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(64 * c) + 1_000_000 for c in (*v, *[0.0] * (dim - len(v)))]) for i, v in fit]


def checked(spark, rows, most=32):
    """The result, held against exact fractions of the covariance."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "7 as n", "8 as component", "'v' as vector", "1.5 as i", "2 as j")
    got = whiten(integer_vectors(df, 64, float(1 << 62)), most).toPandas()
    fit = whole(rows)
    n, dim = len(fit), len(fit[0][1])
    sums = [sum(x[d] for _, x in fit) for d in range(dim)]
    y = [[n * x[d] - sums[d] for d in range(dim)] for _, x in fit]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * min(most, dim) and set(got.n) == {n}
    assert sorted(map(str, got.drop_duplicates(["vec_id", "deviation"]).deviation)) == sorted(map(str, {(i, sum(c * c for c in r)): sum(c * c for c in r) for (i, _), r in zip(fit, y)}.values()))
    for c, part in got.groupby("component"):
        assert part.explained.tolist() == pytest.approx([values[c - 1] / np.trace(cov)] * n, rel=1e-9, abs=1e-12)
        if values[c - 1] > 1e-12 * np.trace(cov):
            want = (np.array(y, float) / n) @ vectors[:, c - 1] / values[c - 1] ** 0.5
            own = {i: w for (i, _), w in zip(fit, want)}
            mine = np.array([own[i] for i in part.vec_id])
            sign = np.sign(mine @ part.whitened.to_numpy())
            assert np.allclose(part.whitened, sign * mine, atol=1e-8)
        else:
            assert part.whitened.isna().all()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    return got


def vectors_of(n, dim, seed=1, size=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(0, 1, (dim, dim)) * np.linspace(1, 3, dim)[:, None]
    return [(i, (rng.normal(0, size, dim) @ mix).tolist()) for i in range(n)]


def test_against_fractions(spark):
    checked(spark, vectors_of(400, 7))
    checked(spark, vectors_of(300, 6, 2), most=2)


def test_nulls_and_what_is_not_finite(spark):
    rows = vectors_of(60, 4, 3) + [(70, None), (71, [None, 1.0, 1.0, 1.0]), (72, [float("nan")] * 4), (73, [1.0, float("-inf"), 0.0, 0.0]), (None, [9.0, 8.0, 7.0, 6.0])]
    got = checked(spark, [r for r in rows if r[0] is not None])
    assert set(got.vec_id) == set(range(60))
    assert whiten(integer_vectors(spark.createDataFrame(rows, SCHEMA), 64, float(1 << 62))).where("vec_id is null").count() == 4


def test_short_and_empty_vectors(spark):
    checked(spark, vectors_of(50, 4, 4) + [(90, [1.0, 2.0]), (91, [])])


def test_dependent_dimensions_and_repeated_rows(spark):
    rows = [(i, [v, v, 1.0]) for i, v in enumerate(np.random.default_rng(6).normal(0, 5, 80).tolist())]
    got = checked(spark, rows)
    assert got[got.component == 1].whitened.notna().all()
    assert len(whiten(integer_vectors(spark.createDataFrame([rows[0], rows[0], rows[1]], SCHEMA), 64)).collect()) == 9


def test_one_row_equal_rows_and_none(spark):
    for rows in ([(1, [0.5, 2.0])], [(i, [0.5, 2.0]) for i in range(9)]):
        got = whiten(integer_vectors(spark.createDataFrame(rows, SCHEMA), 64)).collect()
        assert len(got) == 2 * len(rows) and all(r.whitened is None and r.deviation == 0 and r.explained == r.identity_error == 0 for r in got)
    assert whiten(integer_vectors(spark.createDataFrame([], SCHEMA), 64)).collect() == []


def test_large_values_stay_exact(spark):
    rows = [(i, (np.array(v) * 1e9).tolist()) for i, v in vectors_of(50, 3, 7)]
    got = whiten(integer_vectors(spark.createDataFrame(rows, SCHEMA), 64, float(1 << 62))).toPandas()
    assert got.deviation.isna().all()  # beyond a long
    assert got.identity_error[0] < 1e-9
    one = [(i, (np.array(v) * 1e4).tolist()) for i, v in vectors_of(50, 3, 8)]
    checked(spark, one)


def test_squares_on_every_path():
    rng = np.random.default_rng(9)
    for size in (1 << 10, 1 << 40, 1 << 51, 1 << 60):
        values = rng.integers(-size, size, (700, 3))
        assert squares(values).tolist() == [sum(int(v) ** 2 for v in column) for column in values.T]
    values = np.array([[5, 1 << 61], [7, -(1 << 61)]])
    assert centred(values, 10, np.array([12, 0], object)).tolist() == [[38, 10 << 61], [58, -10 << 61]]
