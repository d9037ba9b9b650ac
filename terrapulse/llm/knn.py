"""Exact top-k search by inner product: a Voronoi kNN join with distance bounds from summaries."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed, query, table
from terrapulse.llm.vectors import integer_vectors, longest, matrix

#: Pivots at most; the tables that a plan carries hold at most a few numbers for each pair of them.
PIVOTS = 256
#: Components of the queries and of the data that one task compares with each other.
QUERY_VALUES, DATA_VALUES = 1 << 18, 1 << 20
#: Rows of the data that a task multiplies at once.
CHUNK = 1024

PLACED = "row long, vec_id long, is_query boolean, cell int, distance double, vector array<double>"
FOUND = "row long, query_id long, vec_id long, score long"
_LONG = (1 << 63) - 1
_EXACT = float(1 << 53)


class Pivots:
    """Distances to the pivots in the space where the nearest vector has the largest inner product.

    A vector x of the data gets the further component ``sqrt(longest ** 2 - |x| ** 2)``, a query gets 0: then the
    squared distance of the two is ``|q| ** 2 + longest ** 2 - 2 * score``.
    """

    def __init__(self, points: np.ndarray, square: float):
        self.points, self.square = points, square
        self.squares = (points * points).sum(axis=1)
        self.heights = np.sqrt(np.maximum(square - self.squares, 0))

    def distances(self, rows: np.ndarray, data: bool) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (rows * rows).sum(axis=1)
            height = np.sqrt(np.maximum(self.square - squares, 0)) if data else np.zeros(len(rows))
            flat = squares[:, None] + self.squares[None] - 2 * (rows @ self.points.T)
            return np.sqrt(np.maximum(flat + (height[:, None] - self.heights[None]) ** 2, 0))


def chain(points: np.ndarray) -> list[int]:
    """An order of the pivots in which neighbours are near: always on to the nearest one not yet visited."""
    order, left = [0], np.ones(len(points), bool)
    while len(order) < len(points):
        left[order[-1]] = False
        gaps = ((points - points[order[-1]]) ** 2).sum(axis=1)
        order.append(int(np.where(left, gaps, np.inf).argmin()) if left.any() else 0)
    return order


def runs(order: list[int], loads: dict[int, int], size: int) -> dict[int, int]:
    """Consecutive cells put together up to ``size`` rows: the number of each cell's run; a larger cell is one alone."""
    of, run, filled = {}, 0, 0
    for cell in order:
        load = loads.get(cell, 0)
        if filled and filled + load > size:
            run, filled = run + 1, 0
        of[cell], filled = run, filled + load
    return of


def top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` largest of each row, equal ones from the left; -inf marks what is none."""
    n = scores.shape[1]
    k = min(k, n)
    finite = np.where(np.isfinite(scores), np.abs(scores), 0).max(initial=0)
    if (finite + 1) * n < _EXACT:  # one number holds score and position
        keys = scores * n + np.arange(n - 1, -1, -1)[None]
        best = np.argpartition(-keys, k - 1, axis=1)[:, :k]
    else:
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return best, np.take_along_axis(scores, best, axis=1)


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products, held at the ends of a long; doubles while these are exact, else Python's integers."""
    with np.errstate(over="ignore"):
        bound = np.sqrt((queries**2).sum(axis=1).max(initial=0) * (data**2).sum(axis=1).max(initial=0))
    if bound < _EXACT:
        return queries @ data.T
    whole = [[int(c) for c in row] for row in data]
    exact = [[max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(q, x, strict=True)))) for x in whole] for q in ([int(c) for c in row] for row in queries)]
    return np.array(exact, object).reshape(len(queries), len(data))


def solve(pivots: Pivots, dim: int, k: int):
    """The local join of a block of queries with a block of the data: the best ``k`` of the block for each query.

    The data is gone through by cells; a query skips the chunks whose distance bound is beyond what it has found.
    """

    def work(queries: pa.Table, data: pa.Table) -> pa.Table:
        data = data.sort_by([("cell", "ascending"), ("vec_id", "ascending")])  # null ids come last
        wanted, found = matrix(queries["vector"], dim), matrix(data["vector"], dim)
        rows, ids, cells = data["row"].to_numpy(), data["vec_id"].to_pylist(), data["cell"].to_numpy()
        own, away = queries["row"].to_numpy(), data["distance"].to_numpy()
        limits = queries["limit"].to_numpy().copy()
        reach = pivots.distances(wanted, False)
        squares = (wanted * wanted).sum(axis=1) + pivots.square
        best: list[list[tuple]] = [[] for _ in range(len(wanted))]
        for start in range(0, len(found), CHUNK):
            part = slice(start, start + CHUNK)
            bound = np.full(len(wanted), np.inf)
            for cell in np.unique(cells[part]):
                ring = away[part][cells[part] == cell]
                gap = np.maximum(np.maximum(reach[:, cell] - ring.max(), ring.min() - reach[:, cell]), 0)
                bound = np.minimum(bound, gap)
            live = np.flatnonzero(~(bound > limits))
            if not len(live):
                continue
            scores = products(wanted[live], found[part])
            at = {row: i for i, row in enumerate(rows[part].tolist())}
            exact = scores.dtype == object
            if exact:
                picked = [_picked(own[q], scores[i], rows[part], ids[part], k) for i, q in enumerate(live)]
            else:
                for i, q in enumerate(live):
                    if own[q] in at:
                        scores[i, at[own[q]]] = -np.inf
                # Positions have to follow the ids, the chunk follows the cells.
                by_id = sorted(range(len(scores[0])), key=lambda i: (ids[start + i] is None, ids[start + i] or 0))
                spots, values = top(scores[:, by_id], k)
                picked = [[(-int(v), ids[start + by_id[s]]) for s, v in zip(*pair, strict=True) if v > -np.inf] for pair in zip(spots.tolist(), values.tolist(), strict=True)]
            for q, more in zip(live.tolist(), picked, strict=True):
                best[q] = sorted(best[q] + more, key=lambda p: (p[0], p[1] is None, p[1] or 0))[:k]
                if len(best[q]) == k and not exact:
                    limits[q] = min(limits[q], _outside(max(squares[q] + 2.0 * best[q][-1][0], 0.0) ** 0.5))
        flat = [(int(own[q]), name, b[1], -b[0]) for q, name in enumerate(queries["vec_id"].to_pylist()) for b in best[q]]
        columns = list(zip(*flat, strict=True)) if flat else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["row", "query_id", "vec_id", "score"])

    return work


def _picked(own: int, scores: np.ndarray, rows: np.ndarray, ids: list, k: int) -> list[tuple]:
    """The best of one query, compared as Python's integers."""
    every = [(-int(s), i) for s, r, i in zip(scores, rows.tolist(), ids, strict=True) if r != own]
    return sorted(every, key=lambda p: (p[0], p[1] is None, p[1] or 0))[:k]


def _outside(distance):
    """A bound with room for the rounding of the distances."""
    return distance * (1 + 1e-9) + 1e-6


def place(rows: DataFrame, pivots: Pivots, dim: int) -> DataFrame:
    """Every row with its number, its cell (that of the nearest pivot) and the distance to the pivot, stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = pivots.distances(matrix(batch["vector"], dim), True)
            cell = away.argmin(axis=1)
            columns = [batch["row"], batch["vec_id"], batch["is_query"], pa.array(cell, pa.int32())]
            columns += [pa.array(np.take_along_axis(away, cell[:, None], axis=1)[:, 0]), batch["vector"]]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "is_query", "cell", "distance", "vector"])

    return checkpointed(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(work, PLACED))


def summaries(placed: DataFrame, k: int) -> list:
    """For each cell its rows, its queries, the range of its distances and its ``k + 1`` smallest distances."""
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("distance"))
    near = placed.select("cell", "distance").withColumn("nth", nth).where(F.col("nth") <= k + 1)
    near = near.groupBy("cell").agg(F.sort_array(F.collect_list("distance")).alias("near"))
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("queries"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    return counts.join(near, "cell").collect()


def bounded(queries: DataFrame, pivots: Pivots, dim: int, cells: list, k: int, group: dict[int, int], blocks: dict[int, int]) -> tuple[DataFrame, list]:
    """The queries with their group, block and ``limit``: a distance within which ``k`` rows other than their own lie.

    Also, for each group and cell, the range of the distances from its queries to the pivot and the largest limit.
    """
    near = np.full((len(pivots.points), k + 1), np.inf)
    for c in cells:
        near[c.cell, : len(c.near)] = c.near
    near[np.isnan(near)] = np.inf

    def limit(reach: np.ndarray) -> np.ndarray:
        out = np.empty(len(reach))
        for start in range(0, len(reach), 512):
            sums = (reach[start : start + 512, :, None] + near[None]).reshape(-1, near.size)
            out[start : start + 512] = np.partition(np.nan_to_num(sums, nan=np.inf), min(k, near.size - 1), axis=1)[:, min(k, near.size - 1)]
        return _outside(out)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = pivots.distances(matrix(batch["vector"], dim), False)
            own = [group[c] for c in batch["cell"].to_pylist()]
            block = [r % blocks[g] for r, g in zip(batch["spread"].to_pylist(), own, strict=True)]
            columns = [batch["row"], batch["vec_id"], batch["vector"], pa.array(own, pa.int32()), pa.array(block, pa.int32()), pa.array(limit(reach))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "vector", "group", "block", "limit"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = pivots.distances(matrix(batch["vector"], dim), False)
            own, most, out = np.array([group[c] for c in batch["cell"].to_pylist()]), limit(reach), []
            for g in np.unique(own):
                mine = reach[own == g]
                out += [(int(g), c, a, b, float(most[own == g].max())) for c, (a, b) in enumerate(zip(mine.min(axis=0).tolist(), mine.max(axis=0).tolist(), strict=True))]
            yield pa.RecordBatch.from_pylist([dict(zip(("group", "cell", "low", "high", "limit"), r, strict=True)) for r in out], schema=pa.schema([("group", pa.int32()), ("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("limit", pa.float64())]))

    spread = queries.withColumn("spread", F.pmod(F.xxhash64("row"), F.lit(1 << 30)))
    marked = spread.mapInArrow(mark, "row long, vec_id long, vector array<double>, group int, block int, limit double")
    found = spread.mapInArrow(ranges, "group int, cell int, low double, high double, limit double")
    return marked, found.groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("limit").alias("limit")).collect()


def voronoi_top_k(rows: DataFrame, k: int = 5, pivots: int = PIVOTS, query_values: int = QUERY_VALUES, data_values: int = DATA_VALUES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` other rows of the largest integer inner product.

    ``rows`` holds ``vec_id, vector, is_query``, the vectors as whole numbers. Every row belongs to the cell of its
    nearest pivot. The cells' summaries give each query a distance within which its answers lie; a row is copied only
    to the groups of queries that its distance to the pivot leaves possible, and each group searches its copies in
    blocks of a bounded size. Cells and groups of any size are dealt over many blocks, so no task holds a crowded one.

    All rows are candidates but the query's own (rows of a repeated id find each other); fewer than ``k`` others give
    fewer rows; ties go to the smaller id, null ids come last. Vectors of different lengths are compared as if the
    shorter ended in zeros, an empty one scores 0. Scores beyond a long are held at its ends. A table without a query
    or without a row gives no rows.
    """
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("queries"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c)).alias("square")).first()
    if not size.n or not size.queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(longest(rows), 1)
    sample = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").select("vector").limit(min(pivots, ceil(size.n**0.5)))
    points = np.zeros((0, dim))
    for r in sample.collect():
        points = np.vstack([points, np.pad(np.array(r.vector, float), (0, dim - len(r.vector)))])
    centre = Pivots(np.unique(points, axis=0), float(size.square))

    placed = place(rows, centre, dim)
    cells = summaries(placed, k)
    order = [c for c in chain(np.column_stack([centre.points, centre.heights])) if any(s.cell == c for s in cells)]
    query_rows = max(1, query_values // dim)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data_rows = max(1, min(data_values // dim, ceil(size.n / parts)))
    group = runs(order, {c.cell: c.queries for c in cells}, query_rows)
    asked: dict[int, int] = {}
    for c in cells:
        asked[group[c.cell]] = asked.get(group[c.cell], 0) + c.queries
    blocks = {g: max(1, ceil(n / query_rows)) for g, n in asked.items()}
    marked, ranges = bounded(placed.where("is_query"), centre, dim, cells, k, group, blocks)

    # The data's blocks: runs of cells, a large cell over several of them.
    of, shares, first, used = runs(order, {c.cell: c.n for c in cells}, data_rows), {}, {}, 0
    load: dict[int, int] = {}
    for c in cells:
        load[of[c.cell]] = load.get(of[c.cell], 0) + c.n
    for run in sorted(load):
        shares[run], first[run], used = ceil(load[run] / data_rows), used, used + ceil(load[run] / data_rows)
    table_of: dict[int, list] = {c.cell: [] for c in cells}
    wanted: dict[int, set] = {g: set() for g in blocks}
    ring = {c.cell: c for c in cells}
    for r in ranges:
        if r.cell in ring:
            gap = max(r.low - ring[r.cell].high, ring[r.cell].low - r.high)
            if not gap > r.limit:
                table_of[r.cell].append((r.group, r.low, r.high, r.limit, blocks[r.group]))
                wanted[r.group].add(of[r.cell])
    bounds = spark.createDataFrame(
        [(c, first[of[c]], shares[of[c]], t) for c, t in table_of.items()],
        "cell int, first int, shares int, near array<struct<group:int, low:double, high:double, limit:double, blocks:int>>",
    )
    possible = F.filter("near", lambda g: F.isnan("distance") | ~(F.greatest(g["low"] - F.col("distance"), F.col("distance") - g["high"]) > g["limit"]))
    copies = placed.join(F.broadcast(bounds), "cell").withColumn("part", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("shares"))).cast("int"))
    copies = copies.withColumn("to", F.explode_outer(possible)).where("to is not null").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("to.blocks") - 1)))
    copies = copies.select(F.col("to.group").alias("group"), "block", "part", "row", "vec_id", "cell", "distance", "vector")
    spans = spark.createDataFrame(
        [(g, [(first[u], first[u] + shares[u] - 1) for u in sorted(w)]) for g, w in wanted.items()], "group int, spans array<struct<start:int, stop:int>>"
    )
    asking = marked.join(F.broadcast(spans), "group").withColumn("span", F.explode_outer("spans")).where("span is not null")
    asking = asking.withColumn("part", F.explode(F.sequence("span.start", "span.stop"))).select("group", "block", "part", "row", "vec_id", "vector", "limit")
    keys = ["group", "block", "part"]
    found = asking.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(solve(centre, dim, k), FOUND)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query(
    "op11_voronoi_top_k",
    """
    WITH x AS (
        SELECT vec_id, [floor(256 * c::DOUBLE) FOR c IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
    ), pairs AS (
        SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
        FROM x AS q JOIN x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op11_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(table(spark, sf_dir, "embeddings"), 256)
    return voronoi_top_k(rows.withColumn("is_query", F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))))
