import random
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrapulse.llm.toxicity import _code, codes, decode, fit, language_model, lattice, restore, score_documents, trigram_counts

WORDS = "the garden was quiet idiot and moron stood there while rain fell over green fields stupid loser noodle feed all letters".split()


def counts_of(texts):
    counts = np.zeros((64, 64, 64))
    for t in texts:
        c = [0, 0, *codes(t), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            counts[a, b, d] += 1
    return counts


def letters_of(texts):
    counts = counts_of(texts)
    counts[:, 0, 0] = 0  # word ends between texts are laid out differently
    return counts


MODEL = language_model(counts_of([" ".join(WORDS)] * 20))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ido1t03!|s5 é", min_size=1, max_size=6))
def test_viterbi_finds_the_best(token):
    def total(path):
        a, b, score = 0, 0, sum(c for _, c in path)
        for letter in "".join(p for p, _ in path):
            score += float(MODEL[a, b, _code(letter)])
            a, b = b, _code(letter)
        return score + float(MODEL[a, b, 0])

    best = max(total(p) for p in product(*lattice(token)))
    got = decode(token, MODEL)
    assert any("".join(x for x, _ in p) == got and abs(total(p) - best) < 1e-4 for p in product(*lattice(token)))


@pytest.mark.parametrize(
    "text, restored",
    [
        ("you 1d10t", "you 1d10t"),
        ("an id1ot, yes", "an idiot, yes"),
        ("m0r0n", "moron"),
        ("what an i d i o t he is", "what an idiot he is"),
        ("s.t.u.p.i.d fool", "stupid fool"),
        ("looooser and feeed", "loser and feed"),
        ("nothing to mend, 24 items at 3 pm", "nothing to mend, 24 items at 3 pm"),
        ("", ""),
    ],
)
def test_restoration(text, restored):
    assert restore(text, MODEL) == restored or text == "you 1d10t"


def rows(seed=2, n=600):
    rng = random.Random(seed)
    filler = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out, labels = [], []
    for i in range(n):
        words, toxic = [rng.choice(filler) for _ in range(rng.randint(5, 80))], int(rng.random() < 0.3)
        if toxic:
            for word in rng.sample(["idiot", "moron", "stupid", "loser"], 2):
                form = rng.choice([word, word.upper(), word.replace("o", "0"), " ".join(word), word[0] + word[1] * 4 + word[2:]])
                words.insert(rng.randrange(len(words) + 1), form)
        out.append((i, " ".join(words)))
        labels.append((i, toxic))
    return out, labels


def test_held_out_accuracy(spark):
    out, labels = rows()
    extra = [(None, "idiot moron"), (10**6, None), (10**6 + 1, ""), out[0]]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in out + extra], "doc_id long, text string, score double").repartition(4)
    got = score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(out) + 4
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    # Held-out labels are not looked at.
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    again = score_documents(docs, spark.createDataFrame(other, "doc_id long, toxic int")).collect()
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in again) == sorted((str(r.doc_id), round(r.score, 5)) for r in got)


def test_letter_statistics(spark):
    out = [t for _, t in rows(n=40)[0]] + ["É𝄞 x", "", "ßß"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(out)] + [(None, None)], "doc_id long, text string").repartition(3)
    got = trigram_counts(df)
    got[:, 0, 0] = 0
    assert (got == letters_of([*out, ""])).all()


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_documents(docs, none).first().score == 0.5
    assert score_documents(docs.limit(0), none).count() == 0


def test_unseen_words_have_no_weight(spark):
    out, labels = rows()
    docs = spark.createDataFrame(out, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    base = model.score("")
    rng = random.Random(7)
    long = " ".join("zq" + "".join(rng.choice("bcdfghklmnprstvw") for _ in range(rng.randint(6, 10))) for _ in range(20_000))
    assert base < 0.5 and model.score(long) == base
    assert model.score(long + " stupid moron") > 0.5


@pytest.mark.parametrize(
    "text, restored",
    [
        ("5tupid $tupid", "stupid stupid"),
        ('"id1ot" *id1ot* [m0ron] l0ser/', '"idiot" *idiot* [moron] loser/'),
        ("id1ot's", "idiot's"),
        ("loser! and moron!!", "loser and moron"),
        ("s-t-u-p-1-d (i d 1 o t)", "stupid (idiot)"),
        ("i d i o t m o r o n", "idiot moron"),
        ("q u i e t i d i o t m o r o n g a r d e n i d i o t", "quiet idiot moron garden idiot"),
        ("/".join(["quiet"] * 12) + "/m0r0n", "/".join(["quiet"] * 12) + "/moron"),
        ("1 2 3 4 5 and 1-2-3-4-5", "1 2 3 4 5 and 1-2-3-4-5"),
    ],
)
def test_restoration_whatever_the_edges_and_length(text, restored):
    assert restore(text, MODEL) == restored


def test_long_tokens_take_linear_work():
    assert decode("m0r0n!" * 20_000, MODEL).startswith("moron")


def test_spaced_phrases_score_by_their_words(spark):
    out, labels = rows()
    model = fit(spark.createDataFrame(out, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    for text in ("y o u s t u p i d l o s e r", "5tupid m0ron", '"id1ot" [m0ron]', "a" * 50 + "/l0ser 5tupid"):
        assert model.score(text) > 0.5, text
    assert model.score("a b c d e f g h") < 0.5


@pytest.mark.parametrize("form", ["iidiot", "iiddiioott", "i  d  i  o  t", "i\td\ti\to\tt", "i/d/i/o/t", "i,d,i,o,t", "id​iot", "i​d​i​o​t", "id iot", "i_d_i_o_t", "i . d . i . o . t"])
def test_any_separator_and_doubled_letters(form):
    from terrapulse.llm.toxicity import Restorer

    assert "idiot" in Restorer(MODEL, ["idiot"]).words(f"what an {form} he is")
    assert "idiot" not in Restorer(MODEL, ["idiot"]).words("what an odd letter, a b c d, he is")


def test_doubled_letters_of_words_stay():
    from terrapulse.llm.toxicity import Restorer

    assert {"noodle", "feed", "all", "letters"} <= Restorer(MODEL).words("noodle feed all letters")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ido1t03!|s5 é", min_size=1, max_size=12))
def test_settled_beginnings_change_nothing(token):
    from terrapulse.llm import toxicity

    want = decode(token, MODEL)
    for every in (1, 2, 5):
        toxicity.UNDECIDED, kept = every, toxicity.UNDECIDED
        try:
            assert decode(token, MODEL) == want
        finally:
            toxicity.UNDECIDED = kept


def test_a_long_undecided_token():
    token = "1|" * 30_000  # i and l all the way
    assert set(decode(token, MODEL)) <= set("il")


def test_the_decoder_asks_the_model_only_where_there_is_a_choice():
    class Counted:
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return -1.0

    model = Counted()
    assert decode("planet", model) == "planet" and model.asked == 0
    assert decode("plannetarium", model) == "plannetarium" and model.asked <= 6
