import hashlib
from itertools import groupby

from hypothesis import example, given, settings
from hypothesis import strategies as st

from terrapulse.llm.chat import Template, escape, format_chats, parse, read_back, segments, unescape

TEXT = st.text(alphabet=st.one_of(st.sampled_from("\\#</turn>\n: @aU"), st.characters(codec="utf-8")), max_size=40)
TEMPLATE = Template()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "User", "a: b"]), TEXT), TEXT), max_size=5))
@example([("user", "\\### Assistant: </turn> ok"), ("assistant", " </turn>\n### User: \\")])
@example([("\\:", "####"), ("@", "\\\\#### </turn>\n")])
def test_round_trip(turns):
    parts = [(t, loss) for t, loss, _ in segments(iter(turns), TEMPLATE)]
    assert [(r, t) for r, t, _ in parse(iter(parts), TEMPLATE)] == turns
    assert [u for _, _, u in parse(iter(parts), TEMPLATE)] == [t if r == "assistant" else "" for r, t in turns]
    whole = "".join(t for t, _ in parts)  # joined to one piece, marks alone tell the turns apart
    assert whole.count(" </turn>\n") >= len(turns)
    assert all(unescape(escape(t)) == t for _, t in turns)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 5, None, "x"), (None, 0, "user", "q"), (None, 1, "assistant", "r" * 50_000)]
    rows += [(4, 0, "system", "s"), (4, 1, "user", "u"), (4, 1, "user", "u"), (4, 2, "assistant", "é</turn>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(3)
    got = {r.conv_id: r for r in read_back(format_chats(df)).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or ""))
    for conv, group in groupby(ordered, key=lambda r: r[0]):
        turns = [(r or "", t or "") for _, _, r, t in group]
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(turns) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert row.formatted_chars == sum(len(s[0]) for s in segments(iter(turns), TEMPLATE))
    assert len(got) == 5
    assert {i: got[i].violation for i in got} == {None: None, 1: None, 2: "assistant after start", 3: "(none) after start", 4: "user after user"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_chats(empty)).count() == 0
