"""Near copies by the Jaccard similarity of five-word shingles: banded prints, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed, texts
from terrapulse.llm.components import components

WORDS = 5
#: Prints of a text: 32 bands of five minima of mixed shingle digests. Two texts of similarity s share a band with the
#: probability 1 - (1 - s**5)**32, so at 0.8 a pair in 300 000 is missed and fewer above.
BANDS, ROWS = 32, 5

#: Classes under a key that are compared as pairs of rows; more are compared within tasks, by tiles of at most so many
#: classes and shingles.
FEW = 8
TILE_CLASSES, TILE_SHINGLES = 1024, 1 << 21

_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 63, (BANDS * ROWS, 1), "u8") * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str) -> np.ndarray:
    """The distinct XXH64 digests of the word shingles, sorted; a shorter text is one shingle, a text without words none."""
    import xxhash

    tokens = text.encode("utf-8").lower().split()  # as the prints of op5: only A-Z fold, only ASCII white space splits
    if not tokens:
        return np.zeros(0, "u8")
    found = map(b" ".join, zip(*(tokens[i:] for i in range(WORDS)), strict=False)) if len(tokens) >= WORDS else [b" ".join(tokens)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 42) for s in found], "u8"))


def node_of(own: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())


def bands(own: np.ndarray) -> np.ndarray:
    """One key for each band; none for an empty set."""
    if not len(own):
        return np.zeros(0, "i8")
    least = np.full(BANDS * ROWS, np.iinfo("u8").max, "u8")
    with np.errstate(over="ignore"):
        for start in range(0, len(own), 2048):
            mixed = own[None, start : start + 2048] * _MULTIPLIERS
            mixed ^= mixed >> np.uint64(32)
            mixed *= _SECOND
            np.minimum(least, mixed.min(axis=1), out=least)
        key = np.arange(1, BANDS + 1, dtype="u8")
        for part in least.reshape(BANDS, ROWS).T:
            key = (key ^ part) * _SECOND
            key ^= key >> np.uint64(32)
    return key.view("i8")


def prints(docs: DataFrame) -> DataFrame:
    """``doc_id, node, size, bands`` of every row; rows of the same shingles have the same node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text) for text in batch["text"].to_pylist()]
            columns = [batch["doc_id"], pa.array([node_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            columns.append(pa.array([bands(s) for s in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "size", "bands"])

    return texts(docs).mapInArrow(work, "doc_id long, node binary, size long, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` for the wanted ``nodes`` (``node, first``), computed again from their texts only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text) for text in batch["text"].to_pylist()]
            columns = [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.view("i8") for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles"])

    wanted = nodes.select("first").distinct()
    rows = texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").select("text")
    own = rows.mapInArrow(work, "node binary, shingles array<long>").join(nodes.select("node"), "node", "left_semi")
    return own.dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (``a, b``) whose shingles have a Jaccard similarity of 4/5 or more."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.distinct().join(one, "a").join(other, "b").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The shingles that each two of ``sets`` share; only the part above the diagonal is filled.

    Shingles of two sets and more become columns of bits, a few megabytes of them at a time.
    """
    many = len(sets)
    owner = np.repeat(np.arange(many), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1
    place = np.cumsum(common) - 1
    shared = common[column]
    owner, column = owner[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both, width = np.zeros((many, many), "i4"), max(64, (1 << 25) // many // 64 * 64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [start, start + width])
        flags = np.zeros((many, min(width, -(-(int(column[high - 1]) + 1 - start) // 64) * 64)), bool)
        flags[owner[low:high], column[low:high] - start] = True
        bits = np.packbits(flags, axis=1).view("u8")
        for i in range(many - 1):
            both[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype="i4")
    return both


def forest(sets: list[np.ndarray], roots: list[bytes]) -> list[tuple[int, int]]:
    """Links of similarity 0.8 or more, one for each two groups that they put together; ``roots`` tell what is so far."""
    sizes = np.array([len(s) for s in sets])
    near = 9 * overlaps(sets) >= 4 * (sizes[:, None] + sizes[None])
    _, label = np.unique(np.array(roots, object), return_inverse=True)
    out = []
    for i in range(len(sets) - 1):
        met = i + 1 + np.flatnonzero(near[i, i + 1 :])
        met = met[label[met] != label[i]]
        names, first = np.unique(label[met], return_index=True)
        out += [(i, int(met[f])) for f in first]
        if len(names):
            label[np.isin(label, names)] = label[i]
    return out


def linked(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` of similarity 0.8 or more that put together the classes under the keys of ``crowded``.

    ``key, node, size, root, n, total``: a key with ``n`` classes is cut into blocks, and each two blocks meet in one
    task, which compares their sets as bits and sends a forest. Rows and their copies grow with the blocks of a key.
    """
    blocks = F.ceil(F.greatest(F.col("n") / TILE_CLASSES, F.col("total") / TILE_SHINGLES)).cast("long")
    dealt = crowded.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def send() -> pa.RecordBatch:
            pairs = forest([h[2] for h in held], [h[1] for h in held])
            return pa.RecordBatch.from_arrays([pa.array([held[p[e]][0] for p in pairs], pa.binary()) for e in (0, 1)], names=["a", "b"])

        for batch in batches:
            lists = batch["shingles"]
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            names = zip(*(batch[c].to_pylist() for c in ("key", "i", "j")), strict=True)
            for at, (name, node, root) in enumerate(zip(names, batch["node"].to_pylist(), batch["root"].to_pylist(), strict=True)):
                if name != tile:
                    if len(held) > 1:
                        yield send()
                    tile, held = name, []
                held.append((node, root, values[ends[at] : ends[at + 1]].copy()))
        if len(held) > 1:
            yield send()

    met = dealt.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.select("key", "i", "j", "node", "root", "shingles").mapInArrow(work, "a binary, b binary")


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id``: the smallest doc_id reachable over pairs of similarity 0.8 or more.

    Texts of the same shingles are one class. Of the classes under a band key each is compared with the smallest. What
    doesn't hang together yet is compared with each other: under a key of few classes as pairs of rows, under a crowded
    one within tasks that send a forest, so rows follow the classes and not their pairs. Texts without a word, null
    ones among them, are copies of each other. Repeated rows and null ids keep their rows; a component of null ids only
    has a null id; an empty table gives no rows; other columns are ignored.
    """
    own = checkpointed(prints(docs))
    classes = own.groupBy("node").agg(F.min("doc_id").alias("first"))
    rows = own.dropDuplicates(["node"]).select("node", "size", F.explode_outer("bands").alias("key")).where("key is not null")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    keys = checkpointed(rows.join(shared.select("key", "least"), "key"))
    nodes = checkpointed(keys.select("node").distinct().join(classes, "node"))
    sets = checkpointed(sets_of(docs, nodes))
    stars = checkpointed(verified(keys.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")), sets))
    roots = components(stars).withColumnRenamed("component", "root")
    rooted = keys.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    load = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("total"))
    rooted = checkpointed(rooted.join(load.where("low <> high").select("key", "n", "total"), "key"))
    some = rooted.where(F.col("n") <= FEW)
    one = some.select("key", F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("size").alias("a_size"))
    other = some.select("key", F.col("node").alias("b"), F.col("root").alias("b_root"), F.col("size").alias("b_size"))
    alike = "a_root < b_root and 9 * least(a_size, b_size) >= 4 * (a_size + b_size)"
    rest = checkpointed(verified(one.join(other, "key").where(alike).select("a", "b"), sets))
    crowd = checkpointed(linked(rooted.where(F.col("n") > FEW), sets))
    placed = components(stars.unionByName(rest).unionByName(crowd)).withColumnRenamed("component", "root")
    placed = checkpointed(classes.join(placed, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.select("doc_id", "node").join(placed.join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
