"""Toxicity: noisy-channel restoration under a character language model, then a linear model over the restored words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed, query, ship, table, texts

# The letters that the character model tells apart; number 0 is everything that ends a word.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿß"
SIZE = 64
OTHER = SIZE - 1
# What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "¡": "i"}
#: Log costs of the channel: a sign for a letter, a sign that means nothing, a letter drawn out or doubled.
SIGN_COST, LOST_COST, STRETCH_COST, DOUBLE_COST = -0.7, -3.0, -0.5, -1.0
#: The log cost of a word end in a spaced-out phrase.
SPLIT_COST = -2.0
#: The labelled rows that the linear model is fitted on at most (a bounded, documented sample: those with the smallest
#: digests of their id), and the log likelihood ratio that a feature needs.
LABELLED_ROWS, EVIDENCE = 12_000, 9.0

_WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.escape("".join(SIGNS))
#: Letters and signs without a break, whatever stands around them: id1ot, $tupid, "l0ser/, idiooot.
_RUN = re.compile(rf"(?:[^\W\d_]|[{_SIGN}])+")
_LETTER = re.compile(r"[^\W\d_]")
_DISGUISED = re.compile(rf"[{_SIGN}]|([^\W\d_])\1\1")
#: A letter twice may be one that is drawn out or belong to the word: both readings count.
_DOUBLED = re.compile(r"([^\W\d_])\1")
#: Single letters (or signs for them) with underlines or marks between: i_d_i_o_t.
_MARKED = re.compile(rf"(?<!\w)(?:[^\W\d_]|[{_SIGN}])(?:[.*_-](?:[^\W\d_]|[{_SIGN}])){{3,}}(?!\w)")
#: The same with white space or any other separator between, of one or several words: i d i o t, i/d/i/o/t, i, d, i, o, t.
_SPACED = re.compile(rf"(?<![\w'’])(?:[^\W\d_]|[{_SIGN}])([^\w'’]{{1,4}})(?:[^\W\d_]|[{_SIGN}])(?:\1(?:[^\W\d_]|[{_SIGN}])){{2,}}(?!\w)")
_SEPARATOR = re.compile(rf"[^\w{_SIGN}]+")
#: Characters that show nothing: soft hyphens, zero-width spaces and joiners, direction marks.
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
#: After so many undecided characters what all readings have in common is looked for and put out.
UNDECIDED = 4096

_CODES = np.zeros(0x250, "u1")
for _number, _letter in enumerate(LETTERS, 1):
    _CODES[ord(_letter)] = _number


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], OTHER)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all letter trigrams of all rows: ``counts[a, b, c]``.

    Each task sends the trigrams it has met, so what is gathered grows with the corpus, up to the table's fixed size.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIZE**3, "i8")
        for batch in batches:
            held, size, ends = [], 0, np.zeros(2, "u1")
            for text in [*batch["text"].to_pylist(), None]:
                if text is not None:
                    held += [ends, codes(text)]
                    size += len(text)
                if held and (text is None or size > 1 << 20):
                    # Two word ends stand before a text and one, of the next two, after it.
                    c = np.concatenate([*held, ends]).astype("i4")
                    grams = c[:-2] * SIZE**2 + c[1:-1] * SIZE + c[2:]
                    counts += np.bincount(grams, minlength=SIZE**3)
                    held, size = [], 0
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype("i4")), pa.array(counts[met])], names=["gram", "n"])

    rows = texts(docs).select("text").mapInArrow(work, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3, "f8")
    for row in rows:
        counts[row.gram] = row.n
    return counts.reshape(SIZE, SIZE, SIZE)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a letter after two others, backing off to one and to none."""
    one = counts.sum(axis=(0, 1)) + 0.1
    one /= one.sum()
    two = counts.sum(axis=0) + 20 * one
    two /= two.sum(axis=1, keepdims=True)
    three = counts + 5 * two[None, :, :]
    return np.log(three / three.sum(axis=2, keepdims=True)).astype("f4")


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters what it may stand for, with the channel's log cost."""
    out, at, token = [], 0, token.lower()
    for char, run in groupby(token):
        n = len(list(run))
        if char.isalpha():
            if n == 1:
                choices = [(char, 0.0)]
            elif n == 2:
                choices = [(2 * char, 0.0), (char, DOUBLE_COST)]
            else:
                choices = [(char, STRETCH_COST), (2 * char, STRETCH_COST)]
        elif char in SIGNS:
            choices = [(letter * k, SIGN_COST * k) for letter in SIGNS[char] for k in range(1, min(n, 2) + 1)]
            # At the end of a word an exclamation mark is one.
            choices.append(("", 0.0 if char == "!" and at + n == len(token) else LOST_COST))
        elif char.isspace():
            choices = [("", 0.0), (" ", SPLIT_COST)]
        else:
            choices = [("", 0.0)]
        out.append(choices)
        at += n
    return out


def _code(letter: str) -> int:
    point = ord(letter)
    return int(_CODES[point]) if point < len(_CODES) else OTHER


def _settled(reached: dict) -> tuple[tuple | None, dict]:
    """The longest path that all states begin with, and the states with the rest of theirs."""
    chains = []
    for _, path in reached.values():
        chain = []
        while path is not None:
            chain.append(path)
            path = path[0]
        chains.append(chain[::-1])
    same = 0
    for nodes in zip(*chains):
        if any(n is not nodes[0] for n in nodes):
            break
        same += 1
    if not same:
        return None, reached
    made: dict[int, tuple] = {}
    rest = {}
    for (state, (score, _)), chain in zip(reached.items(), chains, strict=True):
        path = None
        for node in chain[same:]:
            path = made.setdefault(id(node), (path, node[1]))
        rest[state] = (score, path)
    return chains[0][same - 1], rest


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest words behind a token: Viterbi search of its lattice, the state being the last two letters.

    What all states have in common is put out as soon as one is left, and looked for at intervals beyond that: readings
    of a long token are the same but for their last letters, so little is held of it.
    """
    done, states, undecided = [], {(0, 0): (0.0, None)}, 0

    def spelled(path) -> str:
        parts = []
        while path is not None:
            path, letters = path
            parts.append(letters)
        return "".join(reversed(parts))

    for choices in lattice(token):
        if len(states) == 1 and len(choices) == 1:
            # One way to go on: its probability is a part of every reading, only the last two letters count.
            a, b = next(iter(states))
            letters = choices[0][0]
            for letter in letters:
                a, b = b, _code(letter)
            done.append(letters)
            states = {(a, b): (0.0, None)}
            continue
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for letters, cost in choices:
                x, y, total = a, b, score + cost
                for letter in letters:
                    c = _code(letter)
                    total += float(model[x, y, c])
                    x, y = y, c
                if (x, y) not in reached or total > reached[x, y][0]:
                    reached[x, y] = (total, (path, letters) if letters else path)
        undecided += 1
        if undecided % UNDECIDED == 0:
            common, reached = _settled(reached)
            done.append(spelled(common))
        if len(reached) == 1:
            (state, (score, path)), undecided = next(iter(reached.items())), 0
            done.append(spelled(path))
            reached = {state: (score, None)}
        states = reached
    if len(states) == 1:
        return "".join(done)
    best = max(states, key=lambda s: states[s][0] + float(model[(*s, 0)]))
    return "".join(done) + spelled(states[best][1])


def _decoded(model: np.ndarray):
    return lambda m: decode(m[0], model) if _LETTER.search(m[0]) else m[0]


def restore_token(token: str, model: np.ndarray) -> str:
    if not _DISGUISED.search(token) and not _MARKED.search(token):
        return token
    decoded = _decoded(model)
    return _RUN.sub(lambda m: decoded(m) if _DISGUISED.search(m[0]) else m[0], _MARKED.sub(decoded, token))


def readings(token: str, model: np.ndarray) -> str:
    """A token with disguised words spelled out; of one with doubled letters both as it stands and as decoded."""
    restored = restore_token(token, model)
    if restored == token and _DOUBLED.search(token):
        return f"{token} {_RUN.sub(lambda m: decode(m[0], model) if _DOUBLED.search(m[0]) else m[0], token)}"
    return restored


def restore(text: str, model: np.ndarray) -> str:
    """``text`` with disguised words spelled out; everything else stays."""
    text = _SPACED.sub(_decoded(model), _UNSEEN.sub("", text))
    return "".join(restore_token(part, model) for part in re.split(r"(\s+)", text))


class Restorer:
    """The distinct words of restored texts; what stands between white space is restored once while in the cache.

    Letter statistics don't always tell where a word of a spaced-out phrase ends, so the phrase is also read as one word,
    and the ``telling`` words within that are found whatever their borders. Two words side by side that make a telling
    one are that word if the letter statistics prefer it to the two.
    """

    def __init__(self, model: np.ndarray, telling: list[str] = (), capacity: int = 400_000):
        self.model, self.telling, self.capacity, self.known = model, telling, capacity, {}
        self.whole = frozenset(telling)

    def phrase(self, spaced: str) -> str:
        if not _LETTER.search(spaced):
            return spaced
        whole = decode(_SEPARATOR.sub("", spaced), self.model)
        return " ".join([decode(spaced, self.model), whole, *(w for w in self.telling if w in whole)])

    def read(self, token: str) -> tuple[str, ...]:
        word = token.rstrip(".,;:?")
        # Letters without a double and the marks that end a sentence have one reading.
        if word.isalpha() and not _DOUBLED.search(word):
            return (word,)
        return tuple(_WORD.findall(readings(token, self.model)))

    def words(self, text: str) -> set[str]:
        text = _SPACED.sub(lambda m: self.phrase(m[0]), text.lower() if text.isascii() else _UNSEEN.sub("", text.lower()))
        if len(self.known) > self.capacity:
            self.known.clear()
        out, known, tokens = set(), self.known, text.split()
        distinct = set(tokens)
        found = list(map(known.get, distinct))
        if None in found:
            for token in distinct:
                if token not in known:
                    known[token] = self.read(token)
            found = list(map(known.__getitem__, distinct))
        out.update(*found)
        if self.whole:
            joined = self.whole.intersection(map(str.__add__, tokens, tokens[1:]))
            if joined - out:
                pairs = {a + b: f"{a} {b}" for a, b in zip(tokens, tokens[1:]) if a + b in joined}
                out.update(w for w, pair in pairs.items() if decode(pair, self.model) == w)
        return out


def features(word: str) -> tuple[str, str]:
    """A word and its beginning: inflected and compound forms share the latter."""
    return word, "^" + word[:4]


@dataclass
class Model:
    letters: np.ndarray
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.restorer = Restorer(self.letters, [f for f in self.weights if len(f) > 3 and not f.startswith("^")])

    def score(self, text: str) -> float:
        weights, weight, total = self.weights, self.weights.get, self.bias
        weighed = [w for w in self.restorer.words(text) if w in weights or "^" + w[:4] in weights]
        # In a fixed order, so that the sum doesn't depend on the process.
        for word in sorted(weighed):
            one, other = features(word)
            total += weight(one, 0.0) + weight(other, 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def is_held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def telling(with_feature: np.ndarray, toxic_with: np.ndarray, rate: float, evidence: float) -> np.ndarray:
    """Features found in toxic rows more often than chance gives: the log likelihood ratio of their share exceeds ``evidence``."""
    share = np.clip(toxic_with / np.maximum(with_feature, 1), 1e-9, 1 - 1e-9)
    ratio = with_feature * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    return (share > rate) & (ratio > evidence)


def fit_weights(found: list[list[str]], labels: np.ndarray, penalty: float = 1e-5, rounds: int = 400) -> tuple[dict[str, float], float]:
    """Logistic regression over the telling binary features (those ``found`` in each row), by gradient descent with adaptive steps and an L2 penalty.

    Weights are not negative: clean words around an insult don't make up for it.
    """
    rate = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(rate / (1 - rate)))
    if len(labels) == 0 or labels.min() == labels.max():
        return {}, bias
    names = sorted({f for row in found for f in row})
    number = {f: n for n, f in enumerate(names)}
    row = np.repeat(np.arange(len(found), dtype="i4"), [len(f) for f in found])
    column = np.array([number[f] for r in found for f in r], "i8")
    w, b, first, second = np.zeros(len(names)), bias, np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(row, w[column], len(labels)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        gradient = np.append(np.bincount(column, error[row], len(names)) + penalty * w, error.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return {f: float(x) for f, x in zip(names, w, strict=True) if x > 0}, float(b)


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    """A model from the labels that are not held out; letter statistics come from all rows of ``docs``."""
    letters = language_model(trigram_counts(docs))
    known = labels.where(~is_held_out("doc_id") & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters)
        for batch in batches:
            found = [sorted({f for w in restorer.words(text) for f in features(w)}) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(found, pa.list_(pa.string()))], names=["toxic", "found"])

    # At most ``labelled_rows`` ids, so the broadcast is bounded and texts are not moved.
    joined = texts(docs).join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int"), "text")
    sample = checkpointed(joined.mapInArrow(work, "toxic int, found array<string>").withColumn("toxic", (F.col("toxic") > 0).cast("int")))
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = (toxic + 1) / (total + 2)
    counts = sample.select("toxic", F.explode_outer("found").alias("feature")).where("feature is not null").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    # Others can't reach the evidence: a feature's ratio is largest if all its rows are toxic.
    able = counts.where((F.col("n") * float(-np.log(rate)) > EVIDENCE) & (F.col("toxic") > F.col("n") * float(rate))).toArrow()
    tells = telling(able["n"].to_numpy().astype("f8"), able["toxic"].to_numpy().astype("f8"), rate, EVIDENCE)
    useful = {f for f, t in zip(able["feature"].to_pylist(), tells, strict=True) if t}
    kept = F.array_intersect("found", F.array(*map(F.lit, sorted(useful)))) if useful else F.array().cast("array<string>")
    rows = sample.select("toxic", kept.alias("found")).toArrow()
    weights, bias = fit_weights(rows["found"].to_pylist(), rows["toxic"].to_numpy().astype("f8"))
    return Model(letters, weights, bias)


def scorer(spark: SparkSession, model: Model):
    """A column function: the score of a whole text, a null text as the empty one."""
    ship(spark)
    shared = spark.sparkContext.broadcast((model.letters, model.weights, model.bias))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for batch in batches:
            yield pa.array([own.score(t or "") for t in batch.to_pylist()], pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Labels of rows whose crc32(doc_id) is divisible by 5 are never learned from, and language, source, label and id
    are no inputs of a score. A null or empty text has the score of no word; repeated rows and null ids keep their
    rows; with no labels, or one class only, every score is the base rate; an empty table gives no rows; other columns
    are ignored.
    """
    score = scorer(docs.sparkSession, fit(docs, labels))
    rows = texts(docs).select("doc_id", is_held_out("doc_id").alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
