"""SimHash near duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed, query, ship, table, texts
from terrapulse.llm.components import components

BITS = 64
PRINT = "doc_id long, print long"
#: Rows of one key that a task compares with each other; larger keys are split by further bits, whole results kept.
KEY_ROWS = 4096
#: What a key row costs against comparing one pair of rows.
ROW_COST = 50


def fingerprint(text: str, words: int = 4) -> int:
    """The majority bits of the XXH64 digests of word shingles, as an unsigned number; 0 where there is no word."""
    import xxhash

    tokens = text.encode("utf-8").lower().split()  # bytes: only A-Z fold, only ASCII white space splits
    if not tokens:
        return 0
    shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))) or [b" ".join(tokens)]
    counts, digest = np.zeros(BITS, "int64"), xxhash.xxh64_intdigest
    for start in range(0, len(shingles), 1 << 16):
        hashes = np.array([digest(s, 42) for s in shingles[start : start + (1 << 16)]], "<u8")
        counts += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, print`` of every row; the print is the signed form of the unsigned number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text, words) for text in batch["text"].to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints)], names=["doc_id", "print"])

    return texts(docs).mapInArrow(work, PRINT)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of prints and, for each pair of bits, how many prints have both: sums over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = _bits(batch["print"].to_numpy()).astype("f4")
            total += len(bits)
            both += bits.T @ bits
        cells = np.append(both.ravel(), total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    rows = prints.select("print").mapInArrow(work, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for row in rows:
        cells[row.cell] = row.n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(prints).view("u1").reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(total: int, both: np.ndarray, count: int) -> list[list[int]]:
    """Bits in ``count`` parts of nearly equal width, each grown from a seed by the bit most correlated with it."""
    share = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    likeness = np.abs((both / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(likeness, 0)
    left, parts = list(range(BITS)), []
    for k in range(count):
        width = len(left) // (count - k)
        part = [max(left, key=lambda b: (likeness[b, left].max(), -b))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: (likeness[b, part].mean(), -b)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def within(differ: np.ndarray) -> np.ndarray:
    """The probability of at most 0, 1, ... differing bits, the bits differing independently."""
    chance = np.array([1.0])
    for p in differ:
        chance = np.append(chance * (1 - p), 0) + np.append(0, chance * p)
    return np.cumsum(chance)


def allocate(costs: list[list[float]], spare: int) -> tuple[float, list[int]]:
    """Thresholds of least cost, by dynamic programming over the parts.

    ``costs[i][t + 1]`` is the cost of threshold ``t`` for part ``i``, -1 leaving the part out; thresholds sum up to
    ``spare``.
    """

    @cache
    def best(part: int, left: int) -> tuple[float, tuple[int, ...]]:
        if part == len(costs):
            return (0.0, ()) if left == 0 else (float("inf"), ())
        found = []
        for t in range(-1, len(costs[part]) - 1):
            cost, rest = best(part + 1, left - t)
            found.append((costs[part][t + 1] + cost, (t, *rest)))
        return min(found)

    cost, thresholds = best(0, spare)
    return cost, list(thresholds)


def plan(total: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds: of every number of parts, the one whose keys and candidates cost least.

    Two prints at most ``distance`` bits apart are at most ``t`` bits apart in some part, if the thresholds ``t`` of
    all parts sum up to ``distance - parts + 1``.
    """
    share = np.diag(both) / max(total, 1)
    differ, best = 2 * share * (1 - share), None
    for count in range(1, distance + 2):
        parts, costs = correlated_parts(total, both, count), []
        for part in parts:
            near = within(differ[part])
            pairs = [total * total / 2 * near[t] for t in range(distance + 1)]
            rows = [total * ball(len(part), -(-t // 2)) for t in range(distance + 1)]
            costs.append([0.0, *(p + ROW_COST * r for p, r in zip(pairs, rows, strict=True))])
        cost, thresholds = allocate(costs, distance - count + 1)
        if best is None or cost < best[0]:
            best = cost, [(p, t) for p, t in zip(parts, thresholds, strict=True) if t >= 0]
    return best[1]


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


KEY = "key long, print long, used long"


def probe_keys(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """For each part every value within half the threshold: prints within the threshold share one of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch["print"].to_numpy().view("u8")
            for number, (part, threshold) in enumerate(parts):
                mask = np.bitwise_or.reduce([np.uint64(1 << b) for b in part])
                for radius in range(-(-threshold // 2) + 1):
                    for flipped in combinations(part, radius):
                        flip = np.uint64(sum(1 << b for b in flipped))
                        yield _key_batch(_mix(((prints & mask) ^ flip), number), prints, np.full(len(prints), mask))

    return prints.select("print").mapInArrow(work, KEY)


def narrower(keys: DataFrame, distance: int) -> DataFrame:
    """Split keys: of ``distance + 1`` blocks of the bits not used so far, two near prints agree on one at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, prints, used = (batch[c].to_numpy().view("u8") for c in ("key", "print", "used"))
            for mask in np.unique(used):
                rows, free = used == mask, [b for b in range(BITS) if not int(mask) >> b & 1]
                for number, block in enumerate(np.array_split(free, distance + 1)):
                    own = np.uint64(sum(1 << int(b) for b in block))
                    yield _key_batch(_mix(key[rows] ^ _mix(prints[rows] & own, number), 99), prints[rows], used[rows] | own)

    return keys.mapInArrow(work, KEY)


def _mix(values: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixer; prints whose keys meet by chance are compared in vain, nothing else."""
    with np.errstate(over="ignore"):
        values = (values ^ np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return values ^ (values >> np.uint64(32))


def _key_batch(key: np.ndarray, prints: np.ndarray, used: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view("i8")) for x in (key, prints, used)], names=["key", "print", "used"])


def linked(key: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in one task: each print that has a near one under its key, and the smallest print it hangs together with.

    Rows of a key are compared at growing offsets in key order; only joins between trees not yet joined are kept, so
    the result is at most one row for each print however dense a group is.
    """
    values, node = np.unique(prints, return_inverse=True)
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.array([], int)
    ends = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
    parent, at = np.arange(len(values)), np.arange(len(key))
    offset = 1
    unsigned = values.view("u8")
    while len(at := at[at + offset < ends[at]]):
        one, other = node[at], node[at + offset]
        near = np.bitwise_count(unsigned[one] ^ unsigned[other]) <= distance
        one, other = one[near], other[near]
        while len(one):
            # Hook the larger root onto the smaller, then shorten all paths.
            one, other = parent[one], parent[other]
            apart = one != other
            one, other = one[apart], other[apart]
            np.minimum.at(parent, np.maximum(one, other), np.minimum(one, other))
            while (parent != (short := parent[parent])).any():
                parent = short
        offset += 1
    joined = np.flatnonzero(np.bincount(parent, minlength=len(values))[parent] > 1)
    return values[joined], values[parent[joined]]


def links(prints: DataFrame, distance: int = 4, key_rows: int = KEY_ROWS) -> DataFrame:
    """Edges ``a, b`` between distinct prints that join exactly those hanging together by near pairs."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b["key"].to_numpy(), b["print"].to_numpy()) for b in batches]
        if parts:
            a, b = linked(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ship(prints.sparkSession)
    total, both = bit_statistics(prints)
    keys, found = probe_keys(prints, plan(total, both, distance)), []
    while True:
        crowded = checkpointed(keys.groupBy("key").count().where(F.col("count") > key_rows).select("key"))
        split = bool(crowded.take(1))
        plain = keys.join(crowded, "key", "left_anti") if split else keys
        found.append(plain.select("key", "print").repartition("key").mapInArrow(verify, "a long, b long"))
        if not split:
            break
        # A crowded key with too few free bits left holds few distinct prints, so splitting ends.
        keys = checkpointed(narrower(keys.join(crowded, "key", "left_semi"), distance))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the print and the smallest doc_id reachable over near prints.

    Exact copies and equal prints are one class, so links are sought between distinct prints only. Texts without a
    word (null, empty, white space) have print 0 and link like any other. Repeated rows and null ids keep their rows;
    a component of null ids only has a null id. An empty table gives no rows, other columns are ignored.
    """
    own = checkpointed(fingerprints(docs, words))
    classes = checkpointed(own.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("print"), distance)).withColumnsRenamed({"node": "print", "component": "root"})
    placed = classes.join(roots, "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    placed = checkpointed(placed)
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    member = placed.join(smallest, "root").select("print", "component_id")
    return own.join(member, "print").select("doc_id", hex16(F.col("print")).alias("fingerprint"), "component_id")


def hex16(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
