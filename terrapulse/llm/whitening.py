"""Embedding whitening: an exact covariance by polarisation, its eigenvectors, whitened vectors."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed, query, table
from terrapulse.llm.vectors import integer_vectors, longest, matrix

COMPONENTS = 32
#: Components of the vectors that are worked on at once.
SLICE_VALUES = 1 << 19
#: Below this share of the trace an eigenvalue is rounding.
LEAST = 1e-13

_LONG = (1 << 63) - 1
_BITS, _LOW = 26, (1 << 26) - 1
#: Sums leave a task in two decimals, ``high * BASE + low``: any number of tasks can be added up exactly.
BASE = 1 << 96
_WIDE = Context(prec=80)
PAIRS = "i int, j int, high decimal(38,0), low decimal(38,0)"
_PAIRS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])


def slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(1024, SLICE_VALUES // dim))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def centred(values: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S``, exact: as longs where these hold it with room for a sum of two, else as Python's integers."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    if 2 * n * max(most, 1) < 1 << 61 and all(abs(int(s)) < 1 << 61 for s in sums):
        return values * n - sums.astype("int64")
    return values.astype(object) * n - sums


def squares(values: np.ndarray) -> np.ndarray:
    """The exact sums of squares of the columns, as Python's integers; at most 1024 rows."""
    if values.dtype == object:
        return (values * values).sum(axis=0) if len(values) else np.zeros(values.shape[1], object)
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    if most * most * len(values) < 1 << 62:
        return (values * values).sum(axis=0).astype(object)
    if most >= 1 << 52:
        return squares(values.astype(object))
    high, low = values >> _BITS, values & _LOW
    parts = [(a * b).sum(axis=0).astype(object) for a, b in ((high, high), (high, low), (low, low))]
    return (parts[0] << (2 * _BITS)) + (parts[1] << (_BITS + 1)) + parts[2]


def _rows(triples) -> pa.RecordBatch:
    out = [{"i": i, "j": j, "high": Decimal(v // BASE, _WIDE), "low": Decimal(v % BASE, _WIDE)} for i, j, v in triples]
    return pa.RecordBatch.from_pylist(out, schema=_PAIRS)


def _added(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Exact totals by position; their number depends on the dimensions alone."""
    totals = rows.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {(r.i, r.j): int(r.high) * BASE + int(r.low) for r in totals}


def sums_of(rows: DataFrame, dim: int) -> np.ndarray:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for batch in slices(batches, dim):
            total = total + _values(batch, dim).astype(object).sum(axis=0)
        yield _rows((d, d, int(s)) for d, s in enumerate(total))

    found = _added(rows.mapInArrow(work, PAIRS))
    return np.array([found.get((d, d), 0) for d in range(dim)], object)


def _values(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The x-vectors of a batch; the stored ones are short of the constant, which their missing ends have as well."""
    return matrix(batch["vector"], dim).astype("int64") + OFFSET


#: Added to every component: it shows whether sums are centred before they are multiplied.
OFFSET = 1_000_000


def covariances(rows: DataFrame, n: int, sums: np.ndarray) -> list[list[int]]:
    """``n ** 3`` times the covariance matrix, exact, by polarisation.

    Every task adds up the squared centred values of each dimension and of the sum of each pair of dimensions; half of
    what the pair's total exceeds the two single ones by is the pair's cross product.
    """
    dim = len(sums)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = np.zeros(dim, object)
        pairs = [np.zeros(dim - d - 1, object) for d in range(dim)]
        for batch in slices(batches, dim):
            y = centred(_values(batch, dim), n, sums)
            single = single + squares(y)
            for d in range(dim - 1):
                pairs[d] = pairs[d] + squares(y[:, d + 1 :] + y[:, d : d + 1])
        yield _rows((d, d, int(s)) for d, s in enumerate(single))
        for d in range(dim):
            yield _rows((d, d + 1 + e, int(s)) for e, s in enumerate(pairs[d]))

    found = _added(rows.mapInArrow(work, PAIRS))
    out = [[0] * dim for _ in range(dim)]
    for (i, j), total in found.items():
        out[i][j] = out[j][i] = total if i == j else (total - found[i, i] - found[j, j]) // 2
    return out


def components(products: list[list[int]], n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvectors as columns and eigenvalues by falling eigenvalue, at most ``most``, and the trace."""
    whole = np.array([[p / n**3 for p in row] for row in products])  # Python's division of integers rounds once
    values, vectors = np.linalg.eigh(whole)
    order = np.argsort(-values, kind="stable")[:most]
    trace = sum(products[d][d] for d in range(len(products))) / n**3
    return vectors[:, order], values[order], trace


def _identity_error(rows: DataFrame, project, dim: int, width: int, n: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity.

    A task's products are centred on its own mean; what the means differ by is added as products of means, which are
    all next to zero.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, inner = 0, np.zeros(width), np.zeros((width, width))
        for batch in slices(batches, dim):
            w = project(batch)[1]
            own = w.mean(axis=0)
            gap, both = own - mean, count + len(w)
            inner += (w - own).T @ (w - own) + np.outer(gap, gap) * (count * len(w) / both)
            mean, count = mean + gap * (len(w) / both), both
        i, j = np.indices((width, width)).reshape(2, -1)
        outer = (np.outer(mean, mean) * count).ravel()
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(inner.ravel() + outer), pa.array((mean * count)[i])]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "product", "sum"])

    found = rows.mapInArrow(work, "i int, j int, product double, sum double").groupBy("i", "j").agg(F.sum("product").alias("product"), F.sum("sum").alias("sum")).collect()
    means = np.zeros(width)
    for r in found:
        means[r.i] = r["sum"] / n
    return max((abs(r.product / n - means[r.i] * means[r.j] - (r.i == r.j)) for r in found), default=0.0)


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component up to ``most``.

    ``rows`` holds ``vec_id, vector`` with whole numbers, ``OFFSET`` short of the fitted values. All rows are fitted;
    what reaches the driver are sums by dimension and pair of dimensions. Repeated rows and null ids stay, shorter
    vectors are read as ending in zeros (empty ones as zeros only). Where a component has no variance (one row, equal
    rows, dependent dimensions) ``whitened`` is null and the identity is measured over the other components. A
    ``deviation`` beyond a long is null. An empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = checkpointed(rows)
    n, dim = rows.count(), max(longest(rows), 1)
    if not n:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    sums = sums_of(rows, dim)
    vectors, values, trace = components(covariances(rows, n, sums), n, most)
    explained = [float(v) / trace if trace else 0.0 for v in values]
    kept = [c for c, share in enumerate(explained) if share > LEAST]
    weights = vectors[:, kept] / np.sqrt(values[kept])[None]
    width, every = len(kept), len(values)

    def project(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = centred(_values(batch, dim), n, sums)
        return y, (y / n).astype(float) @ weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, dim):
            y, w = project(batch)
            most_y = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
            whole = (y * y).sum(axis=1) if y.dtype != object and most_y * most_y * dim < 1 << 62 else (y.astype(object) ** 2).sum(axis=1)
            deviation = [int(v) if v <= _LONG else None for v in whole]
            full = np.full((len(w), every), np.nan)
            full[:, kept] = w
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, full.size + 1, every), pa.int32()), pa.array(full.ravel()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "all"])

    error = float(_identity_error(rows, project, dim, width, n)) if width else 0.0
    found = rows.mapInArrow(work, "vec_id long, deviation long, all array<double>")
    shares = F.array(*[F.lit(e) for e in explained])
    found = found.select("vec_id", "deviation", F.posexplode("all").alias("at", "value"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.nanvl("value", F.lit(None).cast("double")).alias("whitened"),
        F.get(shares, "at").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Entries whose scaled value nears the end of a long can't be held as one: they count as not finite.
    return whiten(integer_vectors(table(spark, sf_dir, "embeddings"), 64, float(1 << 62)))
