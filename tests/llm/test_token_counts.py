import array

import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terrapulse.llm.token_counts import CACHE, count_tokens
from terrapulse.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
WORDS = WordEncoder(PATH, capacity=20)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAzZ é̱́H's,.!<|endoftext|>\t\n\xa0　ΣßİK1٣…»«%"), st.characters(codec="utf-8"))))
@example("<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b")
@example("H̱ ẖ Å it's IT'S word, word,, wo,rd ...word Σας")
@example("ﬁne… naïve» don't.")
@example("İSTANBUL BELEDİYESİ, TATİLİ. İ! aİ? İ& İ")
def test_ids_are_those_of_the_library(text):
    import array

    for _ in range(2):
        assert array.array("I", WORDS.ids(text)).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_counts_and_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = [(1, "One  two\nthree", 5), (2, "One two three", 6), (3, None, 7), (4, "", 8), (None, "x " * 3000, 9), (1, "One  two\nthree", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, count_tokens(docs, PATH, cache).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(PLAIN.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in rows), key=str)
    assert got == want
    assert spark.read.parquet(cache).count() == 3  # distinct normalised contents
    assert sorted(map(tuple, count_tokens(docs, PATH, cache).collect()), key=str) == want
    assert spark.read.parquet(cache).count() == 3  # nothing new, nothing encoded


def test_empty_table(spark, tmp_path):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "c")).count() == 0


def test_other_versions_are_not_reused(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    count_tokens(docs, PATH, cache).collect()
    stored = spark.read.schema(CACHE).parquet(cache).collect()
    wrong = spark.createDataFrame([("other", r.digest, 99) for r in stored], CACHE)
    wrong.write.mode("append").parquet(cache)
    assert count_tokens(docs, PATH, cache).first().n_tokens == 2


if __name__ == "__main__":
    pytest.main([__file__])


def test_words_that_return_stay_in_the_cache():
    words, asked = WordEncoder(PATH, capacity=20), []
    call = words._call
    words._call = lambda text: asked.extend(text.split()) or call(text)
    for n in range(60):
        text = f"house w{n}x"
        assert words.ids(text) == array.array("I", PLAIN.encode(text, add_special_tokens=False).ids).tobytes()
        assert len(words.known) + len(words.older) <= 20 + 4
    assert asked.count("house") == 1
