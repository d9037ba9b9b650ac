"""Sum-of-squares packing of documents into token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed, query, ship, table, texts
from terrapulse.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Pieces that one task packs together. The last sequences of a block stay partly empty, so a block should be large;
#: its memory is a few numbers for each piece.
BLOCK_PIECES = 50_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece.

    Pieces are placed from the longest to the shortest (ties in the order given). Let ``n[g]`` be the number of open
    bins with residual gap ``g``: a piece goes where the sum of ``n[g] ** 2`` becomes smallest, a new bin being one
    of the choices and the tightest gap winning a tie.
    """
    bins, offsets = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts, made = np.zeros(capacity + 1, "int64"), 0
    for at in np.argsort(-lengths, kind="stable"):
        size = int(lengths[at])
        # counts[0] and counts[capacity] stay zero: full and unopened bins don't enter the sum.
        change = 2 * counts[: capacity + 1 - size] - 2 * counts[size:] + 2
        change[0] -= 1
        change[-1] -= 1
        change[:-1][counts[size:-1] == 0] = np.iinfo("int64").max
        gap = size + int(change.argmin())
        if gap == capacity:
            bins[at], made = made, made + 1
        else:
            bins[at] = open_bins[gap].pop()
            counts[gap] -= 1
        offsets[at] = capacity - gap
        if gap > size:
            open_bins[gap - size].append(bins[at])
            counts[gap - size] += 1
    return bins, offsets


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Every document's ids followed by ``end_id``, cut only where they exceed ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = words.ids(text) + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ROW, strict=True)], schema=ROW)

    return texts(docs).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, block: int = BLOCK_PIECES) -> DataFrame:
    """Place every piece of every document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Pieces are dealt by a hash of their identity to blocks of about ``block`` pieces, and each block is packed by
    ``sum_of_squares``; pieces of full length are sequences of their own. An empty or null text is one piece of the
    end id alone, repeated rows and null ids are packed as rows, an empty table gives no rows, other columns are
    ignored. The token ids themselves are again those of ``pieces_of``, from ``start`` for ``length``.
    """
    spark = docs.sparkSession
    ship(spark)
    # Encoding is the costly step and its rows are few numbers: stored, it feeds both the count and the packing.
    pieces = checkpointed(pieces_of(docs, vocabulary, capacity, end_id))
    full, open_pieces = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-open_pieces.count() // block))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        # The order among equals must not depend on the order of arrival, which a rerun may change.
        order = [("block", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        rows = pa.Table.from_batches(parts).sort_by(order)
        numbers = rows["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            group = rows.slice(begin, end - begin)
            bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
            group = group.drop_columns("block").append_column("sequence_id", pa.array((int(numbers[begin]) << 32) + bins))
            yield from group.append_column("offset", pa.array(offsets)).to_batches()

    # Rows that repeat each other must not meet in one block, hence the row's own number.
    spreading = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = open_pieces.withColumn("block", F.pmod(spreading, F.lit(blocks)))
    packed = dealt.repartition(blocks, "block").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
    # Blocks are numbered from 0, so negative numbers are free for the sequences of one piece.
    alone = -1 - F.monotonically_increasing_id()
    return packed.unionByName(full.withColumns({"sequence_id": alone, "offset": F.lit(0).cast("long")}))


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
