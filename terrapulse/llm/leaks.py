"""Benchmark decontamination by latent semantic retrieval and longest common subsequences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed, query, ship, table, texts

#: Words of a passage, and of the blocks at which passages begin.
PASSAGE, BLOCK = 64, 16
#: Words outside the benchmark share so many columns by their digest.
OTHERS = 1 << 12
#: Latent dimensions, and columns by which the random projection exceeds them.
RANK, EXCESS = 128, 16
#: Items of fewer words say too little for a subsequence; they are searched as phrases, word by word.
LEAST_WORDS = 5
#: An item counts as leaked if so much of it is a subsequence of a stretch at most ``STRETCH`` times as long, and half of
#: its last words (the answer) with it, or if nearly all of it is.
SHARE, VERBATIM, STRETCH, ANSWER = 0.6, 0.9, 1.6, 0.5
#: The scaled cosine that makes a candidate: the passage's component along the item, in lengths of the item, so that the
#: words around a leaked item don't dilute it. A passage that tells the whole item has 1 and what its other words add.
CANDIDATE = 0.5
#: Items searched in one pass over the documents.
ITEMS = 1000
#: How much the items weigh in the matrix against the passages of the documents, in sums of squares: the space must hold them.
ITEM_WEIGHT = 4

#: Words whose latent vectors are added up at once, and passages that are multiplied with the items at once.
GROUP_WORDS, GROUP_PASSAGES = 1 << 15, 1 << 13
#: Passages that are fitted at once.
FIT_PASSAGES = 1 << 12
#: Parts of the columns whose sums over all tasks are added up apart.
PARTS = 64

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _word_signs() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() or c == ord("_") for c in range(0x110000)), bool, 0x110000)


#: For every code point whether it belongs to words (``\w``), set with first use; weights of the code points of a word.
_SIGNS: list[np.ndarray] = []
_WEIGHTS = np.random.default_rng(11).integers(0, 1 << 64, 1 << 10, "u8") | np.uint64(1)


def word_digests(text: str) -> np.ndarray:
    """A 64-bit digest of each word of a lower-case text, in order: weighted sums of code points, for all words at once."""
    if not _SIGNS:
        _SIGNS.append(_word_signs())
    try:
        raw = text.encode("latin-1")
        codes, inside = np.frombuffer(raw, "u1"), np.frombuffer(raw.translate(_SIGNS[0][:256].tobytes()), bool)
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        inside = _SIGNS[0].take(codes)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, "u8")
    # What follows a word counts as nothing.
    values = (codes.astype("u8") + np.uint64(1)) * inside
    within = np.arange(len(codes) - starts[0]) - np.repeat(starts - starts[0], np.diff(starts, append=len(codes)))
    sums = np.add.reduceat(values[starts[0] :] * _WEIGHTS.take(within & len(_WEIGHTS) - 1), starts - starts[0])
    return (sums ^ sums >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)


class Columns:
    """The columns of a text's words: one of its own for words of the benchmark, a shared one for all others.

    Words are told apart by their digests; the subsequence check reads the words themselves.
    """

    def __init__(self, own: dict[str, int]):
        self.own, self.count = own, len(own) + OTHERS
        digests = np.concatenate([np.zeros(0, "u8"), *map(word_digests, own)])
        order = np.argsort(digests)
        self.digests, self.places = digests[order], np.fromiter(own.values(), "i4", len(own))[order]
        self.last = np.zeros(self.count, "i8")
        #: Of this type are the columns of a stored text.
        self.kind = np.dtype("<u2" if self.count < 1 << 16 else "<i4")

    def __reduce__(self):
        return Columns, (self.own,)

    def of(self, text: str) -> np.ndarray:
        digests = word_digests(text.lower())
        out = (len(self.own) + (digests >> np.uint64(40)) % np.uint64(OTHERS)).astype("i4")
        if self.own:
            at = np.searchsorted(self.digests, digests)
            at[at == len(self.digests)] = 0
            known = self.digests[at] == digests
            out[known] = self.places[at[known]]
        return out

    def met(self, text: str) -> np.ndarray:
        """Each column of a text once."""
        return self.distinct(self.of(text))

    def distinct(self, ids: np.ndarray) -> np.ndarray:
        at = np.arange(len(ids))
        self.last[ids] = at
        return ids[self.last[ids] == at]


def read(docs: DataFrame, columns: Columns, *kept: str) -> DataFrame:
    """The columns of the words of each text, in order, as bytes (``ids``), beside what is ``kept`` of ``docs``.

    They are stored, since frequencies, fit and search all read them.
    """

    @F.arrow_udf("binary")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([columns.of(text).astype(columns.kind).tobytes() for text in batch.to_pylist()], pa.binary())

    return checkpointed(docs.select(*kept, found("text").alias("ids")))


def frequencies(stored: DataFrame, columns: Columns) -> tuple[int, int, np.ndarray]:
    """The number of documents, of their passages, and of documents with a word of each column: sums over all rows and words."""
    size = columns.count

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 2, "i8")
        for batch in batches:
            for data in batch["ids"].to_pylist():
                ids = np.frombuffer(data, columns.kind)
                counts[columns.distinct(ids)] += 1
                counts[-1] += -(-len(ids) // PASSAGE)
            counts[-2] += len(batch)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype("i4")), pa.array(counts[met])], names=["column", "n"])

    counts = np.zeros(size + 2, "i8")
    for row in stored.select("ids").mapInArrow(work, "column int, n long").groupBy("column").agg(F.sum("n").alias("n")).collect():
        counts[row.column] = row.n
    return int(counts[-2]), int(counts[-1]), counts[:-2]


def row_sums(rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """For each row of ``chosen`` the sum of the rows of that number."""
    out = np.zeros((len(chosen), rows.shape[1]), rows.dtype)
    for low in range(0, len(chosen), 512):
        part = out[low : low + 512]
        for numbers in chosen[low : low + 512].T:
            part += rows.take(numbers, axis=0)
    return out


def add_passages(ids: np.ndarray, idf: np.ndarray, weighted: np.ndarray, gram: np.ndarray, back: np.ndarray) -> None:
    """Adds ``Y'Y`` and ``A'Y`` of passages, ``Y = A thin``: ``ids`` has a passage in a row, filled up with the column of no word.

    A row of ``A`` holds the TF-IDF weights of a passage at length one. ``weighted`` is ``thin`` times ``idf``; both end
    in zeros for no word, and so does what is added for it to ``back``.
    """
    held = np.sort(ids, axis=1)
    head = np.ones(held.shape, bool)
    head[:, 1:] = held[:, 1:] != held[:, :-1]
    at = np.flatnonzero(head)
    square = (idf[held.ravel()[at]] * np.diff(at, append=held.size)) ** 2
    length = np.maximum(np.sqrt(np.bincount(at // held.shape[1], square, len(ids))), 1e-9).astype("f4")[:, None]
    y = row_sums(weighted, ids) / length
    gram += y.T @ y
    # The passages of each column's words, dealt to slots of eight with none in what is left over.
    y = np.vstack([y / length, np.zeros((1, y.shape[1]), "f4")])
    order = np.argsort(ids.ravel(), kind="stable")
    column = ids.ravel()[order]
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    sizes = np.diff(first, append=len(order))
    slots = -(-sizes // 8)
    begin = np.cumsum(slots) - slots
    chosen = np.full(slots.sum() * 8, len(ids), "i4")
    chosen[np.arange(len(order)) + np.repeat(begin * 8 - first, sizes)] = order // ids.shape[1]
    sums = np.add.reduceat(row_sums(y, chosen.reshape(-1, 8)), begin, axis=0)
    back[column[first]] += sums * idf[column[first], None]


def latent_space(stored: DataFrame, items: list[list[str]], columns: Columns, idf: np.ndarray, passages: int) -> np.ndarray:
    """The right singular vectors of TF-IDF passages: all of the documents' and the benchmark's own, ``columns x RANK``.

    A randomised SVD: the matrix stays distributed by rows, and what leaves a task are sums over rows. The items, which
    hold most of the weight, orient the random projection; one pass over all passages gives the small factor whose SVD
    is exact.
    """
    width = RANK + EXCESS
    owned = [columns.of(" ".join(i)) for i in items]

    def told(thin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The Gram matrix of ``Y = A thin`` and ``A'Y`` over the items."""
        gram, back = np.zeros((width, width)), np.zeros((columns.count, width))
        for start in range(0, len(owned), 256):
            rows = np.zeros((len(owned[start : start + 256]), columns.count), "f4")
            for row, ids in zip(rows, owned[start : start + 256], strict=True):
                np.add.at(row, ids, idf[ids])
            rows *= np.sqrt(ITEM_WEIGHT * max(passages, 1) / len(items)) / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
            y = rows @ thin
            gram += y.T @ y
            back += rows.T @ y
        return gram, back

    start = np.random.default_rng(7).standard_normal((columns.count, width)).astype("f4")
    # For the passages, whose directions are not known yet, the projection stays random.
    oriented, _ = np.linalg.qr(told(start)[1] + start * (max(passages, 1) / columns.count))
    oriented = oriented.astype("f4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, back = np.zeros((width, width)), np.zeros((columns.count + 1, width))
        weights = np.append(idf, 0.0)
        weighted = (np.vstack([oriented, np.zeros((1, width), "f4")]) * weights[:, None]).astype("f4")
        group, held = [], 0

        def add() -> None:
            filled = np.full((sum(-(-len(ids) // PASSAGE) for ids in group), PASSAGE), columns.count, columns.kind)
            flat, low = filled.reshape(-1), 0
            for ids in group:
                flat[low : low + len(ids)] = ids
                low += -(-len(ids) // PASSAGE) * PASSAGE
            for low in range(0, len(filled), FIT_PASSAGES):
                add_passages(filled[low : low + FIT_PASSAGES], weights, weighted, gram, back)

        for batch in batches:
            for data in batch["ids"].to_pylist():
                if data:
                    group.append(np.frombuffer(data, columns.kind))
                    held += len(group[-1])
                if held >= FIT_PASSAGES * PASSAGE:
                    add()
                    group, held = [], 0
        if group:
            add()
        parts = [part.astype("f4").tobytes() for part in np.array_split(np.vstack([gram, back[:-1]]), PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                sums[part] = sums.get(part, 0.0) + np.frombuffer(data, "f4").astype("f8")
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "sums"])

    sums = stored.select("ids").mapInArrow(work, "part int, sums binary").repartition(PARTS, "part").mapInArrow(added, "part int, sums binary")
    parts = {row.part: np.frombuffer(row.sums).reshape(-1, width) for row in sums.collect()}
    gram, back = told(oriented)
    if parts:
        both = np.concatenate([parts[k] for k in sorted(parts)])
        gram, back = gram + both[:width], back + both[width:]
    # Y = Q R with R'R = Y'Y, so Q'A = inv(R') (A'Y)'.
    values, vectors = np.linalg.eigh(gram)
    good = values > max(values.max(), 0) * 1e-9
    small = (back @ vectors[:, good]) / np.sqrt(values[good])
    right, _, _ = np.linalg.svd(small, full_matrices=False)
    out = np.zeros((columns.count, RANK), "f4")
    out[:, : min(RANK, right.shape[1])] = right[:, :RANK]
    return out


def prefix_lcs(item: list[str], words: list[str]) -> list[int]:
    """The longest common subsequence of ``item`` with each prefix of ``words``, by bit-parallel steps."""
    masks: dict[str, int] = {}
    for at, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << at
    full = (1 << len(item)) - 1
    free, out = full, []
    for word in words:
        if mask := masks.get(word):
            met = free & mask
            free = ((free + met) | (free - met)) & full
        out.append(len(item) - free.bit_count())
    return out


@dataclass
class Match:
    share: float
    answer: float
    start: int
    end: int


def confirm(item: list[str], words: list[str], low: int, high: int, weights: list[float] | None = None) -> Match | None:
    """Whether ``item`` is told in ``words[low:high]``: the shortest stretch found with its best subsequence.

    ``SHARE`` must hold for the item's words and for their ``weights`` as well, lest common words make up a match.
    """
    region = words[low:high]
    grown = prefix_lcs(item, region)
    best = grown[-1] if grown else 0
    if best < SHARE * len(item):
        return None
    end = grown.index(best) + 1
    back = prefix_lcs(item[::-1], region[:end][::-1])
    start = end - (back.index(best) + 1)
    told = region[start:end]
    tail = item[-max(3, len(item) // 5) :]
    answer = prefix_lcs(tail, told)[-1] / len(tail)
    match = Match(best / len(item), answer, low + start, low + end)
    near = len(told) <= STRETCH * len(item)
    if weights:
        held = set(told)
        near = near and sum(w for word, w in zip(item, weights, strict=True) if word in held) >= SHARE * sum(weights)
    return match if near and (match.share >= VERBATIM or answer >= ANSWER) else None


@dataclass
class Index:
    """What a task needs to search texts: the items, their latent vectors and the columns' weights."""

    ids: list[int]
    items: list[list[str]]
    columns: Columns
    weighted: np.ndarray  # latent vector of each column times its idf, and a last one of zeros
    vectors: np.ndarray  # latent vectors of the items over the squares of their lengths
    least: np.ndarray  # the scaled cosine that makes a candidate
    weights: list[list[float]]  # the idf of the items' words
    short: dict[str, list[tuple[int, list[str]]]] = field(default_factory=dict)  # items that are phrases, by first word

    def candidates(self, texts: list[str], read: list[bytes] | None = None) -> Iterator[tuple[int, int, int]]:
        """``(text, item, first word)`` of every passage whose cosine suggests an item: all words of all passages count.

        ``read`` has the stored columns of the texts.
        """
        group: list[tuple[int, np.ndarray]] = []
        held = 0
        for number, text in enumerate(texts):
            ids = self.columns.of(text) if read is None else np.frombuffer(read[number], self.columns.kind)
            if len(ids):
                group.append((number, ids))
                held += len(ids)
            if held >= GROUP_WORDS:
                yield from self._suggested(group)
                group, held = [], 0
        if group:
            yield from self._suggested(group)

    def _suggested(self, group: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
        sizes = np.array([len(ids) for _, ids in group])
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(group)), blocks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        ids = np.concatenate([ids for _, ids in group])
        # Every text is filled up to whole blocks with the column of no word, the last one.
        filled = np.full(len(owner) * BLOCK, len(self.weighted) - 1, "i4")
        filled[np.arange(len(ids)) + np.repeat((np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(sizes) - sizes), sizes)] = ids
        sums, step = np.empty((len(owner), self.weighted.shape[1]), "f4"), GROUP_WORDS // BLOCK
        for low in range(0, len(owner), step):
            words = filled[low * BLOCK : (low + step) * BLOCK].reshape(-1, BLOCK)
            part = sums[low : low + step]
            part[:] = 0
            for at in range(BLOCK):
                part += self.weighted.take(words[:, at], axis=0)
        wide = PASSAGE // BLOCK
        whole = sums.copy()
        for shift in range(1, min(wide, len(sums))):
            same = owner[:-shift] == owner[shift:]
            whole[:-shift][same] += sums[shift:][same]
        kept = np.flatnonzero(place < np.maximum(1, blocks - wide + 1)[owner])
        for low in range(0, len(kept), GROUP_PASSAGES):
            part = kept[low : low + GROUP_PASSAGES]
            at, item = np.nonzero(whole[part] @ self.vectors.T >= self.least)
            found = part[at]
            yield from zip([group[o][0] for o in owner[found]], item.tolist(), (place[found] * BLOCK).tolist(), strict=True)

    def search(self, texts: list[str], read: list[bytes] | None = None) -> list[list[tuple[int, Match]]]:
        """For each text the items that it tells, each with its best match."""
        suggested: dict[int, list[tuple[int, int]]] = {}
        if self.items:
            for number, item, start in self.candidates(texts, read):
                suggested.setdefault(number, []).append((item, start))
        out = [self._phrases(words_of(t)) if self.short else [] for t in texts]
        for number, pairs in suggested.items():
            words, found = words_of(texts[number]), {}
            for item, start in sorted(pairs):
                size = len(self.items[item])
                low, high = max(0, start - size), start + PASSAGE + size
                match = confirm(self.items[item], words, low, high, self.weights[item])
                if match and (item not in found or match.share > found[item].share):
                    found[item] = match
            out[number] += [(self.ids[i], m) for i, m in sorted(found.items())]
        return out

    def _phrases(self, words: list[str]) -> list[tuple[int, Match]]:
        """The short items whose words stand in a text one after the other, each where it first does."""
        found: dict[int, Match] = {}
        for at, word in enumerate(words) if not self.short.keys().isdisjoint(words) else ():
            for number, phrase in self.short.get(word, ()):
                if number not in found and words[at : at + len(phrase)] == phrase:
                    found[number] = Match(1.0, 1.0, at, at + len(phrase))
        return sorted(found.items())


def build(docs: DataFrame, benchmark: list[tuple[int, str]], *kept: str) -> tuple[Index, DataFrame] | None:
    """The index of a block of items, and ``docs`` as they were read for it; all passages of all rows are fitted."""
    told = [(i, w) for i, w in ((i, words_of(t or "")) for i, t in benchmark) if w]
    listed = [(i, w) for i, w in told if len(w) >= LEAST_WORDS]
    short: dict[str, list[tuple[int, list[str]]]] = {}
    for number, words in told:
        if len(words) < LEAST_WORDS:
            short.setdefault(words[0], []).append((number, words))
    if not told:
        return None
    items = [w for _, w in listed]
    columns = Columns({w: k for k, w in enumerate(dict.fromkeys(w for i in items for w in i))})
    if not listed:
        return Index([], [], columns, *[np.zeros((0, 0), "f4")] * 3, [], short), docs.select(*kept, F.lit(b"").alias("ids"))
    stored = read(docs, columns, *kept)
    total, passages, counts = frequencies(stored, columns)
    idf = np.log((total + 1) / (counts + 0.5)).clip(0.01)
    space = latent_space(stored, items, columns, idf, passages)
    weighted = (space * idf[:, None]).astype("f4")
    owned = [columns.of(" ".join(i)) for i in items]
    vectors = np.array([weighted[o].sum(axis=0) for o in owned])
    # Of a long item a passage holds a part only.
    least = CANDIDATE * np.minimum(1, (PASSAGE - BLOCK) / np.array([len(i) for i in items]))
    vectors /= np.maximum((vectors**2).sum(axis=1, keepdims=True), 1e-9)
    return Index([i for i, _ in listed], items, columns, np.vstack([weighted, np.zeros_like(weighted[:1])]), vectors.astype("f4"), least.astype("f4"), [idf[o].tolist() for o in owned], short), stored


def indexed(docs: DataFrame, benchmark: DataFrame, *kept: str) -> Iterator[tuple[Index, DataFrame]]:
    """One index for each block of the benchmark, which is the stated query set, with the rows read for it."""
    ship(docs.sparkSession)
    rows = benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator()
    held: list[tuple[int, str]] = []
    for row in rows:
        held.append((row.item_id, row.text))
        if len(held) == ITEMS:
            if built := build(texts(docs), held, *kept):
                yield built
            held = []
    if held and (built := build(texts(docs), held, *kept)):
        yield built


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[Index]:
    for index, _ in indexed(docs, benchmark):
        yield index


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, share, answer, first_word, last_word``: each item that a document's text tells.

    ``share`` of the item's words is a subsequence of the stretch of words named, ``answer`` of its last words too; an
    item of fewer than ``LEAST_WORDS`` words is told where these stand one after the other. Of several stretches the
    one with the largest share is reported, of equal ones the first. Texts of any length are searched as a whole. A null
    or empty text tells nothing, nor does an item without a word; repeated rows are reported as often, null ids keep
    null; without items or documents there are no rows; other columns are ignored.
    """
    kind = "doc_id long, item_id long, share double, answer double, first_word long, last_word long"
    found = docs.sparkSession.createDataFrame([], kind)
    for index, stored in indexed(docs, benchmark, "doc_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("answer", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
            for batch in batches:
                rows = []
                for doc_id, found in zip(batch["doc_id"].to_pylist(), shared.value.search(batch["text"].to_pylist(), batch["ids"].to_pylist()), strict=True):
                    rows += [(doc_id, i, m.share, m.answer, m.start, m.end - 1) for i, m in found]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        found = found.unionByName(stored.mapInArrow(work, kind))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose text tells no item of ``benchmark``.

    Null and empty texts tell nothing and stay, repeated rows stay or go together, long texts are searched as a whole;
    without items all rows stay.
    """
    for index in indexes(docs, benchmark):
        docs = docs.where(_tells_nothing(docs.sparkSession.sparkContext.broadcast(index))("text"))
    return docs


def _tells_nothing(shared: Broadcast):
    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([not found for found in shared.value.search([t or "" for t in batch.to_pylist()])], pa.bool_())

    return clean


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
