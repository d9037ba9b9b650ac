import math
import pickle
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from terrapulse.llm import leaks
from terrapulse.llm.leaks import SHARE, STRETCH, find_leaks, prefix_lcs, without_leaks, words_of


def plain_lcs(a, b):
    grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
    return grid[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.lists(st.sampled_from("abcde"), max_size=15))
def test_subsequences(item, words):
    assert prefix_lcs(item, words) == [plain_lcs(item, words[: k + 1]) for k in range(len(words))]


def corpus(seed=4):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "that"]
    rare = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(4, 9))) for _ in range(3000)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)]

    items = [(i, " ".join(prose(rng.choice([8, 15, 30, 50, 120])))) for i in range(60)]
    docs, planted = [], set()
    for d in range(300):
        words = prose(rng.randint(0, 400))
        if d % 3 == 0:
            item, text = rng.choice(items)
            told = text.split()
            if d % 2 == 0:  # a paraphrase: some words go, some come
                told = [w for w in told if rng.random() > 0.12]
                for _ in range(len(told) // 10):
                    told.insert(rng.randrange(len(told)), rng.choice(rare))
            at = rng.randint(0, len(words))
            words[at:at] = told
            planted.add((d, item))
        docs.append((d, " ".join(words).capitalize() + "."))
    return docs, items, planted


def plainly(docs, items):
    """Every stretch of every text against every item, by the plain table of subsequences."""
    out, df = set(), {}
    for _, text in docs:
        for w in set(words_of(text)):
            df[w] = df.get(w, 0) + 1
    for d, text in docs:
        words = words_of(text)
        for i, t in items:
            item = words_of(t)
            span = int(STRETCH * len(item))
            if not set(item) & set(words):
                continue
            for s in range(0, max(1, len(words) - span + 1), max(1, len(item) // 8)):
                part = words[s : s + span]
                if len(set(part) & set(item)) < 0.5 * SHARE * len(set(item)):
                    continue
                share = prefix_lcs(item, part)[-1] / len(item)
                idf = [math.log((len(docs) + 1) / (df.get(w, 0) + 0.5)) for w in item]
                if sum(x for w, x in zip(item, idf, strict=True) if w in part) < SHARE * sum(idf):
                    continue
                tail = item[-max(3, len(item) // 5) :]
                if share >= 0.9 or share >= SHARE and prefix_lcs(tail, part)[-1] / len(tail) >= 0.5:
                    out.add((d, i))
                    break
    return out


def test_recall_and_precision(spark):
    docs, items, planted = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()}
    want = plainly(docs, items)
    assert len(got & want) >= 0.95 * len(want) and len(got & planted) >= 0.9 * len(planted)
    assert not {d for d, _ in got} - {d for d, _ in planted}
    verbatim = {p for p in planted if p[0] % 2}
    assert verbatim <= got
    kept = {r.doc_id for r in without_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert without_leaks(df, bench).columns == df.columns


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (None, f"so {item.upper()}!"), (3, item), (3, item), (4, item.replace("five", "5")), (5, "one two")]
    rows += [(10 + k, f"filler text number {k} about nothing") for k in range(20)]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "one two"), (7, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()), key=str)
    assert got == sorted([(None, 7), (3, 7), (3, 7), (4, 7), *[(i, 9) for i in (None, 3, 3, 4, 5)]], key=str)  # 9 is a phrase


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0
    assert without_leaks(docs, bench.limit(0)).count() == 1



def test_candidates_of_paraphrases(spark):
    """The search alone, before any check of words in order: told items with so many of their words replaced."""
    from terrapulse.llm.common import texts
    from terrapulse.llm.leaks import indexes

    rng = random.Random(11)
    docs, items, _ = corpus()
    items = [i for i in items if len(words_of(i[1])) >= 15]
    other = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(6)) for _ in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    (index,) = indexes(df, spark.createDataFrame(items, "item_id long, text string"))
    prose = [" ".join(rng.choice(d[1].split() or ["x"]) for _ in range(60)) for d in docs[: len(items)]]
    for share, least in ((0.0, 1.0), (0.2, 0.95), (0.35, 0.9)):
        told = []
        for (_, text), around in zip(items, prose, strict=False):
            words = [rng.choice(other) if rng.random() < share else w for w in words_of(text)]
            told.append(f"{around} {' '.join(words)} {around}")
        met = {(n, i) for n, i, _ in index.candidates(told)}
        assert sum((n, n) in met for n in range(len(told))) >= least * len(told), share


def test_very_long_text_and_phrases(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    item = " ".join(f"item{k}" for k in range(30))
    words[120_000:120_000] = item.split()
    words[70_000:70_000] = ["Rare", "phrase."]
    rows = [(1, " ".join(words)), (2, "a rare phrases"), (3, "RARE, phrase"), (4, "ab c")]
    bench = spark.createDataFrame([(1, item), (2, "rare phrase"), (3, "c"), (4, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.last_word) for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1): (120_002, 120_031), (1, 2): (70_000, 70_001), (3, 2): (0, 1), (4, 3): (1, 1)}


def test_columns_of_words():
    """Words as the subsequence check reads them; those of the benchmark have columns of their own, equal ones the same."""
    rng = random.Random(5)
    columns = pickle.loads(pickle.dumps(leaks.Columns({"one": 0, "two": 1, "été": 2})))
    shared = {}
    for _ in range(500):
        text = "".join(rng.choice(["one", "Two", "x", "y_", "ÉTÉ", "İ", "-", "'", "\ud800", "\u0301", "ΑΣ", " ", " ", "\n", "w" * 3000, str(rng.randrange(99))]) for _ in range(rng.randrange(30)))
        words, found = words_of(text), columns.of(text).tolist()
        assert len(words) == len(found) and sorted(columns.met(text).tolist()) == sorted(set(found))
        for word, column in zip(words, found, strict=True):
            own = columns.own.get(word)
            assert column == own if own is not None else 3 <= column < columns.count
            assert shared.setdefault(word, column) == column
    digests = [int(leaks.word_digests(w)[0]) for w in shared]
    assert len(set(digests)) == len(digests) > 500 and len(set(shared.values())) > 0.7 * min(len(shared), leaks.OTHERS)
    assert leaks.Columns({}).of("a b").tolist() == [c - 3 for c in columns.of("a b").tolist()]


def test_columns_remember_no_words():
    """A task's memory holds the columns, not the words it has met."""
    columns = leaks.Columns({"one": 0})
    held = len(pickle.dumps(vars(columns)))
    columns.of(" ".join(f"word{i}" for i in range(100_000)))
    assert len(pickle.dumps(vars(columns))) == held


def test_all_passages_are_fitted(spark):
    """Words that change places between two passages change the latent space, wherever these stand in a long text."""
    words = [f"w{k % 400}" for k in range(64 * 16)]
    moved = list(words)
    moved[64:74], moved[192:202] = words[192:202], words[64:74]
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60, 90)))], "item_id long, text string")
    found = [next(leaks.indexes(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string"), bench)) for w in (words, words, moved)]
    spaces = [i.weighted[:-1] @ i.weighted[:-1].T for i in found]
    assert abs(spaces[0] - spaces[1]).max() < 1e-6 * abs(spaces[0]).max() and abs(spaces[0] - spaces[2]).max() > 1e-3 * abs(spaces[0]).max()


def test_sums_of_passages():
    rng = np.random.default_rng(3)
    count, width = 50, 7
    ids, idf, thin = rng.integers(0, count, (20, 64)), rng.random(count) + 0.1, rng.standard_normal((count, width)).astype("f4")
    ids[3, 40:], ids[11, 1:] = count, count
    gram, back = np.zeros((width, width)), np.zeros((count + 1, width))
    leaks.add_passages(ids.astype("i4"), np.append(idf, 0.0), np.vstack([thin * idf[:, None], np.zeros((1, width))]).astype("f4"), gram, back)
    rows = np.zeros((20, count + 1))
    for row, passage in zip(rows, ids, strict=True):
        np.add.at(row, passage, np.append(idf, 0.0)[passage])
    rows = rows[:, :-1] / np.linalg.norm(rows, axis=1, keepdims=True)
    y = rows @ thin
    assert abs(gram - y.T @ y).max() < 1e-4 and abs(back[:-1] - rows.T @ y).max() < 1e-4
