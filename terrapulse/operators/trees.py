"""Random forests: a task grows one tree, or of more rows than fit into it a part of one below a node."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.session import checkpointed, ship, shuffled

#: Rows and values of them (16 MB) that tasks get whole by a broadcast; larger samples are shuffled to them.
LOCAL_ROWS, LOCAL_VALUES = 10_000, 1 << 21
#: Values that a task grows a tree from. Nodes with more are split first, by counts over all rows between ``CUTS`` values
#: of a column.
TASK_VALUES, CUTS = 1 << 23, 31
#: Trees grown one after the other from the same rows, where no node had to be split first.
TREES = 4

NODES = "tree long, feature binary, threshold binary, child binary, share binary"


def best_split(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int) -> tuple[int, float] | None:
    """The column and threshold of the largest gain in Gini impurity; none without a gain."""
    order = np.argsort(x, axis=0, kind="stable")
    held = np.take_along_axis(x, order, 0)
    left = np.zeros((*order.shape, classes))
    np.put_along_axis(left, y[order][..., None], weight[order][..., None], 2)
    left = left.cumsum(axis=0)
    whole = left[-1, 0]
    left = left[:-1]
    right = whole - left
    score = (left**2).sum(axis=2) / left.sum(axis=2) + (right**2).sum(axis=2) / right.sum(axis=2)
    score[~(held[:-1] < held[1:])] = -1.0
    at, column = np.unravel_index(score.argmax(), score.shape)
    if score[at, column] <= (whole**2).sum() / whole.sum() * (1 + 1e-12):
        return None
    low, high = held[at, column], held[at + 1, column]
    middle = low + (high - low) / 2
    return int(column), float(middle if low <= middle < high else low)


def ranks(x: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones of its column."""
    out = np.empty(x.shape, "u2" if len(x) <= 1 << 16 else "u4", order="F")
    for column in range(x.shape[1]):
        out[:, column] = np.unique(x[:, column], return_inverse=True)[1]
    return out


def ordered(numbers: np.ndarray) -> np.ndarray:
    """The stable order of natural numbers, by 16 bits at a time, which numpy sorts in linear time."""
    order = np.argsort(numbers.astype("u2"), kind="stable")
    top, shift = int(numbers.max(initial=0)), 16
    while top >> shift:
        order = order[np.argsort((numbers[order] >> shift).astype("u2"), kind="stable")]
        shift += 16
    return order


def best_splits(x: np.ndarray, rank: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, node: np.ndarray, columns: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``best_split`` for all nodes of a level: the ``ranks`` of ``x``, the ``node`` of each of ``rows``, the ``columns`` a node sees, its class ``totals``.

    Along the sorted rows of a node the squares of the class counts on both sides grow by terms of the row's own class.
    """
    classes, size, square = totals.shape[1], totals.sum(axis=1), (totals**2).sum(axis=1)
    best, column, threshold = square / size * (1 + 1e-12), np.full(len(totals), -1, "i4"), np.zeros(len(totals))

    def before(heads: np.ndarray, running: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What a running sum held before the group of each row."""
        return (running[heads] - own[heads])[np.cumsum(heads) - 1]

    for k in range(columns.shape[1]):
        held = rank[rows, columns[node, k]]
        order = ordered(held)
        order = order[ordered(node[order])]
        held, at, own, w = held[order], node[order], y[rows[order]], weight[rows[order]]
        head = np.append(True, at[1:] != at[:-1])
        group = at * classes + own
        dealt = ordered(group)
        run = np.cumsum(w[dealt])
        run = run - before(np.append(True, group[dealt][1:] != group[dealt][:-1]), run, w[dealt])
        met = np.empty(len(w))
        met[dealt] = run - w[dealt]
        left, grown, cross = (np.cumsum(c) - before(head, np.cumsum(c), c) for c in (w, (2 * met + w) * w, totals[at, own] * w))
        right = np.maximum(size[at] - left, 0.5)
        score = grown / left + (square[at] - 2 * cross + grown) / right
        score[~np.append((at[1:] == at[:-1]) & (held[:-1] < held[1:]), False)] = -1.0
        top = np.maximum.reduceat(score, np.flatnonzero(head))
        place = np.flatnonzero(score == top[at])
        first = np.empty(len(totals), "i8")
        first[at[place[::-1]]] = place[::-1]
        better = np.flatnonzero(top > best)
        place = order[first[better, None] + np.arange(2)]
        low, high = x[rows[place], columns[better, k, None]].astype("f8").T
        middle = low + (high - low) / 2
        best[better], column[better], threshold[better] = top[better], columns[better, k], np.where((low <= middle) & (middle < high), middle, low)
    return column, threshold


def grow(x: np.ndarray, y: np.ndarray, classes: int, depth: int, seed: list[int], weight: np.ndarray | None = None, rank: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """One tree over a bootstrap of the rows, or rows of the ``weight`` given: per node its feature (-1: leaf), threshold and left child (the right one follows; of a leaf its place among the leaves), and the class shares of the leaves.

    A node sees the root of the number of features, and is a leaf if those give no gain. All nodes of a level are split
    at once.
    """
    rng = np.random.default_rng(seed)
    if weight is None:
        weight = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x))
    weight, tried, rank = weight.astype("f8"), int(np.ceil(np.sqrt(x.shape[1]))), ranks(x) if rank is None else rank
    features, thresholds, children, leaves, n_leaves, known = [], [], [], [], 0, 1
    rows = np.flatnonzero(weight)
    node = np.zeros(len(rows), "i8")
    for level in range(depth + 1):
        count = int(node.max()) + 1 if len(node) else 0
        if not count:
            break
        totals = np.bincount(node * classes + y[rows], weight[rows], count * classes).reshape(count, classes)
        feature, threshold = np.full(count, -1, "i4"), np.zeros(count)
        mixed = np.flatnonzero(np.count_nonzero(totals, axis=1) > 1) if level < depth else np.zeros(0, "i8")
        if len(mixed):
            number = np.full(count, -1, "i8")
            number[mixed] = np.arange(len(mixed))
            kept = number[node] >= 0
            rows, node = rows[kept], node[kept]
            columns = rng.random((len(mixed), x.shape[1])).argpartition(tried - 1, axis=1)[:, :tried]
            feature[mixed], threshold[mixed] = best_splits(x, rank, y, weight, rows, number[node], columns, totals[mixed])
        split = feature >= 0
        place = np.cumsum(split) - 1
        child = np.where(split, known + 2 * place, n_leaves + np.cumsum(~split) - 1).astype("i4")
        leaves.append((totals[~split] / totals[~split].sum(axis=1, keepdims=True)).astype("f4"))
        features.append(feature)
        thresholds.append(threshold)
        children.append(child)
        known, n_leaves = known + 2 * int(split.sum()), n_leaves + int((~split).sum())
        kept = split[node]
        rows, node = rows[kept], node[kept]
        node = 2 * place[node] + ~(x[rows, feature[node]] <= threshold[node])
    return np.concatenate(features), np.concatenate(thresholds), np.concatenate(children), np.concatenate(leaves)


def ends(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The node of a tree that each row ends in."""
    feature, threshold, child = tree[:3]
    node, open_rows = np.zeros(len(x), "i4"), np.arange(len(x))
    while len(open_rows := open_rows[feature[node[open_rows]] >= 0]):
        at = node[open_rows]
        node[open_rows] = child[at] + ~(x[open_rows, feature[at]] <= threshold[at])
    return node


def shares(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Mean class shares of the leaves that each row ends in."""
    return sum(share[child[ends((feature, threshold, child), x)]].astype("f8") for feature, threshold, child, share in trees) / len(trees)


def predicted(scored: DataFrame) -> DataFrame:
    """``probability`` and ``prediction`` from ``_shares``."""
    best = F.array_position("_shares", F.array_max("_shares")) - 1
    return scored.withColumns({"probability": array_to_vector("_shares"), "prediction": best.cast("double")}).drop("_shares")


class LocalForest:
    """The trees of a fit; ``transform`` adds what Spark's model adds: ``probability`` and ``prediction``."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self.trees)

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = np.array(batch.to_pylist(), "f8").reshape(len(batch), -1)
                yield pa.array(list(shares(shared.value, x)) if len(x) else [], pa.list_(pa.float64()))

        score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return predicted(df.withColumn("_shares", F.arrow_udf("array<double>")(score)(vector_to_array("features"))))


def fits(rows: int, width: int) -> bool:
    return rows <= LOCAL_ROWS and rows * width <= LOCAL_VALUES


def train(samples: DataFrame, label: str, order: str, trees: int, depth: int, seed: int = 42) -> LocalForest:
    """A forest of ``features`` and the class numbers in ``label``, for samples that ``fits`` takes."""
    spark = samples.sparkSession
    ship(spark)
    table = samples.orderBy(order).select(vector_to_array("features").alias("x"), F.col(label).cast("int").alias("y")).toArrow()
    x, y = np.array(table["x"].to_pylist(), "f8").reshape(table.num_rows, -1), table["y"].to_numpy()
    shared, classes = spark.sparkContext.broadcast((x, y)), int(y.max()) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch["id"].to_pylist():
                parts = [pa.array([part.tobytes()], pa.binary()) for part in grow(*shared.value, classes, depth, [seed, tree])]
                yield pa.RecordBatch.from_arrays([pa.array([tree]), *parts], names=["tree", "feature", "threshold", "child", "share"])

    grown = spark.range(0, trees, 1, trees).mapInArrow(work, NODES).toArrow().sort_by("tree").to_pylist()
    return LocalForest(
        [
            (np.frombuffer(t["feature"], "i4"), np.frombuffer(t["threshold"], "f8"), np.frombuffer(t["child"], "i4"), np.frombuffer(t["share"], "f4").reshape(-1, classes))
            for t in grown
        ]
    )


def _read(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch["x"].flatten(), "f8").reshape(-1, width)


def _bytes(x: np.ndarray) -> bytes:
    """Single precision if that tells the values."""
    short = x.astype("f4")
    return (short if (short == x).all() else x).tobytes()


def _values(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, "f4" if len(data) == 4 * rows * width else "f8").reshape(rows, width)


def bootstrap(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row counts in a tree, by a digest of its key: as drawn with return from many rows (Poisson)."""
    mixed = key.view("u8") ^ np.uint64((seed << 32 | tree) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        mixed = (mixed ^ mixed >> np.uint64(33)) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(33)
    odds = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(16)])
    return np.searchsorted(odds, (mixed >> np.uint64(11)) / float(1 << 53), side="right")


def _binary(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"tree": pa.int64(), "node": pa.int64(), "group": pa.int64(), "at": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()], names=list(columns))


class Upper:
    """The upper part of a tree, down to nodes whose rows fit into a task."""

    def __init__(self, rows: int):
        self.feature, self.threshold, self.child, self.level, self.rows = [-1], [0.0], [0], [0], [rows]
        self.done: set[int] = set()  # nodes that no split gains from

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, "i4"), np.array(self.threshold), np.array(self.child, "i4")

    def large(self, rows: int, depth: int) -> list[int]:
        return [n for n, f in enumerate(self.feature) if f < 0 and self.rows[n] > rows and self.level[n] < depth and n not in self.done]

    def split(self, node: int, feature: int, threshold: float, left: int, right: int) -> None:
        self.feature[node], self.threshold[node], self.child[node] = feature, threshold, len(self.feature)
        self.feature, self.threshold, self.child = self.feature + [-1, -1], self.threshold + [0.0, 0.0], self.child + [0, 0]
        self.level, self.rows = self.level + [self.level[node] + 1] * 2, self.rows + [left, right]


def split_upper(stored: DataFrame, uppers: list[Upper], classes: int, width: int, depth: int, seed: int) -> None:
    """Splits nodes by counts of all their rows until each has so few that a task holds them."""
    least, tried = max(1, TASK_VALUES // width), int(np.ceil(np.sqrt(width)))
    if not any(u.large(least, depth) for u in uppers):
        return
    odds = [(k + 1) / (CUTS + 1) for k in range(CUTS)]
    found = stored.select(*[F.percentile_approx(F.get("x", F.lit(k)), odds, 1000).alias(f"c{k}") for k in range(width)]).first()
    cuts = [np.unique(found[k]) for k in range(width)]
    rng = np.random.default_rng([seed, width])
    while asked := {(t, n): rng.choice(width, tried, replace=False) for t, u in enumerate(uppers) for n in u.large(least, depth)}:
        arrays = {t: uppers[t].arrays() for t, _ in asked}

        def counted(batches: Iterator[pa.RecordBatch], asked=asked, arrays=arrays) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros((tried, CUTS + 1, classes)) for k in asked}
            for batch in batches:
                x, y, key = _read(batch, width), batch["y"].to_numpy(), batch["key"].to_numpy()
                for tree, upper in arrays.items():
                    weight, node = bootstrap(key, seed, tree), ends(upper, x)
                    for (t, n), columns in asked.items():
                        if t == tree and len(rows := np.flatnonzero((node == n) & (weight > 0))):
                            for count, column in zip(sums[t, n], columns, strict=True):
                                place = np.searchsorted(cuts[column], x[rows, column]) * classes + y[rows]
                                count += np.bincount(place, weight[rows], count.size).reshape(count.shape)
            yield _binary({"tree": [t for t, _ in sums], "node": [n for _, n in sums], "counts": [c.tobytes() for c in sums.values()]})

        def chosen(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for t, n, data in zip(*(batch[c].to_pylist() for c in ("tree", "node", "counts")), strict=True):
                    sums[t, n] = sums.get((t, n), 0.0) + np.frombuffer(data).reshape(tried, CUTS + 1, classes)
            out = []
            for (t, n), counts in sums.items():
                left = counts.cumsum(axis=1)[:, :-1]
                whole = counts[0].sum(axis=0)
                right = whole - left
                sizes = left.sum(axis=2), right.sum(axis=2)
                score = sum((side**2).sum(axis=2) / np.maximum(size, 0.5) for side, size in zip((left, right), sizes, strict=True))
                score[(sizes[0] == 0) | (sizes[1] == 0)] = -1.0
                k, cut = np.unravel_index(score.argmax(), score.shape)
                if score[k, cut] > (whole**2).sum() / whole.sum() * (1 + 1e-12):
                    column = asked[t, n][k]
                    out.append((t, n, int(column), float(cuts[column][cut]), int(sizes[0][k, cut]), int(sizes[1][k, cut])))
            names = ("tree", "node", "feature", "threshold", "low", "high")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)

        counts = stored.mapInArrow(counted, "tree long, node long, counts binary").repartition(32, "tree", "node")
        rows = counts.mapInArrow(chosen, "tree long, node long, feature long, threshold double, low long, high long").collect()
        gained = {(r.tree, r.node): r for r in rows}
        for (t, n) in asked:
            if row := gained.get((t, n)):
                uppers[t].split(n, row.feature, row.threshold, row.low, row.high)
            else:
                uppers[t].done.add(n)


class StoredForest:
    """Trees in parts, each below a node of an upper tree, as rows of a stored table; ``transform`` as ``LocalForest``'s."""

    def __init__(self, parts: DataFrame, uppers: list[Upper], width: int, classes: int):
        self.parts, self.uppers, self.width, self.classes = parts, [u.arrays() for u in uppers], width, classes

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.uppers)

    def transform(self, df: DataFrame) -> DataFrame:
        """Blocks of rows meet every part of the forest; neither is sent through the driver."""
        ship(df.sparkSession)
        uppers, width, classes = self.uppers, self.width, self.classes
        kept = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    yield _binary({"group": [batch["_row"][0].as_py()], "rows": [batch["_row"].to_numpy().tobytes()], "x": [_bytes(_read(batch, width))]})

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple[bytes, np.ndarray]] = {}
            for batch in batches:
                for group, rows, data, tree, node, *part in zip(*(batch[c] for c in ("group", "rows", "x", "tree", "node", "feature", "threshold", "child", "share")), strict=True):
                    rows = rows.as_py()
                    x = _values(data.as_py(), len(rows) // 8, width)
                    met = np.flatnonzero(ends(uppers[tree.as_py()], x) == node.as_py())
                    _, held = sums.setdefault(group.as_py(), (rows, np.zeros((len(x), classes))))
                    held[met] += shares([tuple(np.frombuffer(p.as_py(), k) for p, k in zip(part, KINDS, strict=True))[:3] + (np.frombuffer(part[3].as_py(), "f4").reshape(-1, classes),)], x[met])
            for group, (rows, held) in sums.items():
                yield _binary({"group": [group], "rows": [rows], "sums": [held.tobytes()]})

        def added(group: pa.Table) -> pa.Table:
            rows = np.frombuffer(group["rows"][0].as_py(), "i8")
            total = sum(np.frombuffer(s.as_py()) for s in group["sums"]).reshape(-1, classes) / len(uppers)
            return pa.table({"_row": pa.array(rows), "_shares": pa.array(list(total), pa.list_(pa.float64()))})

        packed = checkpointed(kept.select("_row", vector_to_array("features").alias("x")).mapInArrow(blocks, "group long, rows binary, x binary"))
        sums = packed.hint("shuffle_replicate_nl").crossJoin(self.parts).mapInArrow(score, "group long, rows binary, sums binary")
        found = sums.groupBy("group").applyInArrow(added, "_row long, _shares array<double>")
        return predicted(kept.join(shuffled(found), "_row", "left").drop("_row"))


KINDS = ("i4", "f8", "i4", "f4")


def train_stored(samples: DataFrame, label: str, order: str, trees: int, depth: int, width: int, seed: int = 42) -> StoredForest:
    """A forest as ``train``'s of samples of any size: all rows go to the tasks that grow trees, or parts of trees, from them."""
    ship(samples.sparkSession)
    stored = checkpointed(samples.select(F.xxhash64(order).alias("key"), F.col(label).cast("int").alias("y"), vector_to_array("features").alias("x")))
    size = stored.agg(F.count(F.lit(1)).alias("rows"), F.max("y").alias("last")).first()
    classes, uppers = size["last"] + 1, [Upper(size["rows"]) for _ in range(trees)]
    split_upper(stored, uppers, classes, width, depth, seed)
    arrays = [u.arrays() for u in uppers]
    levels = [u.level for u in uppers]
    # Trees and node of each group of rows. What no split of an upper node gains from is a leaf, counted as such below.
    whole = [t for t in range(trees) if len(uppers[t].feature) == 1]
    groups = [(whole[k : k + TREES], 0) for k in range(0, len(whole), TREES)]
    groups += [([t], n) for t in range(trees) if len(uppers[t].feature) > 1 for n, f in enumerate(uppers[t].feature) if f < 0]
    leaves = {(t, n) for t in range(trees) for n in uppers[t].done}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, y, x = batch["key"].to_numpy(), batch["y"].to_numpy(), _read(batch, width)
            ended: dict[int, np.ndarray] = {}
            for number, (members, node) in enumerate(groups):
                tree = members[0]
                if len(arrays[tree][0]) == 1:
                    rows = np.arange(len(x))
                else:
                    if tree not in ended:
                        ended = {tree: np.where(bootstrap(key, seed, tree) > 0, ends(arrays[tree], x), -1)}
                    rows = np.flatnonzero(ended[tree] == node)
                if len(rows):
                    # Of a leaf the classes are enough.
                    data = b"" if (tree, node) in leaves else _bytes(x[rows])
                    yield _binary({"group": [number], "key": [key[rows].tobytes()], "y": [y[rows].tobytes()], "x": [data]})

    def grown(table: pa.Table) -> pa.Table:
        members, node = groups[table["group"][0].as_py()]
        key, y = (np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in (("key", "i8"), ("y", "i4")))
        leaf = (members[0], node) in leaves
        x = np.zeros((len(key), width), "f4") if leaf else np.concatenate([_values(d.as_py(), len(k.as_py()) // 8, width) for d, k in zip(table["x"], table["key"], strict=True)])
        order, out = np.lexsort((y, key)), []
        key, y, x = key[order], y[order], x[order]
        rank = ranks(x)
        for tree in members:
            below = 0 if leaf else depth - levels[tree][node]
            out.append((tree, node, *(p.tobytes() for p in grow(x, y, classes, below, [seed, tree, node], bootstrap(key, seed, tree), rank))))
        return pa.Table.from_batches([_binary(dict(zip(("tree", "node", "feature", "threshold", "child", "share"), map(list, zip(*out, strict=True)), strict=True)))])

    dealt = stored.mapInArrow(deal, "group long, key binary, y binary, x binary").repartition(len(groups), "group")
    parts = dealt.groupBy("group").applyInArrow(grown, "tree long, node long, feature binary, threshold binary, child binary, share binary")
    return StoredForest(checkpointed(parts), uppers, width, classes)
