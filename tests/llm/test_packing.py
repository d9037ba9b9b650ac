import array
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terrapulse.llm.packing import pack, sum_of_squares

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def place_plainly(lengths, capacity):
    """The rule, piece by piece, with every choice tried."""
    gaps, bins = [], [0] * len(lengths)
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        def cost(choice):
            after = [g for b, g in enumerate(gaps) if b != choice] + [(gaps[choice] if choice < len(gaps) else capacity) - lengths[at]]
            return sum(after.count(g) ** 2 for g in set(after) if g)

        choices = [b for b, g in enumerate(gaps) if g >= lengths[at]] + [len(gaps)]
        best = min(choices, key=lambda b: (cost(b), gaps[b] if b < len(gaps) else capacity, -b))
        if best == len(gaps):
            gaps.append(capacity)
        gaps[best] -= lengths[at]
        bins[at] = best
    return gaps


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=25))
def test_each_choice_is_the_least_sum_of_squares(lengths):
    bins, offsets = sum_of_squares(np.array(lengths, "int64"), 16)
    used = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths, strict=True):
        used[b].append((o, n))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 16
    assert sorted(16 - sum(n for _, n in p) for p in used.values()) == sorted(place_plainly(lengths, 16))


def test_pieces_and_places(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["one", "two,", "Three"], rng.integers(0, 60)))) for i in range(200)]
    rows += [(500, "long words " * 300), (501, None), (502, ""), (None, "no id"), (3, rows[3][1]), (2**60 + 1, "big id")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, length int")
    got = pack(docs, PATH, capacity=64, block=50).collect()
    want = []
    for i, text in rows:
        ids = PLAIN.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(i, p, s, len(ids[s : s + 64]), zlib.crc32(array.array("I", ids[s : s + 64]).tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.1 * sum(r.length for r in got) / 64 + 5


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
