import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from terrapulse.llm.components import components
from terrapulse.llm.simhash import allocate, fingerprint, linked, links, near_duplicates, plan


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    root = {n: n for n in nodes}
    for a in nodes:
        for b in nodes:
            if near(a, b):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {n: new if r == old else r for n, r in root.items()}
    return root


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbÉ é\xa0\t\n", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == plain_print(text)


def test_allocation_is_the_best():
    costs = [[0, 5, 9, 30, 31], [0, 1, 50, 60, 70], [0, 4, 4, 100, 200]]
    def cost(ts):
        return sum(c[t + 1] for c, t in zip(costs, ts, strict=True))

    from itertools import product

    want = min(cost(t) for t in product(range(-1, 4), repeat=3) if sum(t) == 2)
    got, thresholds = allocate(costs, 2)
    assert got == want == cost(thresholds) and sum(thresholds) == 2


def test_links_lose_nothing(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base[:40]:
        for _ in range(6):
            prints.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5))))
    crowd = rng.getrandbits(64)  # all alike in the low half
    prints |= {(crowd & 0xFFFFFFFF) | rng.getrandbits(32) << 32 for _ in range(300)}
    signed = sorted(int(np.array([p], "u8").view("i8")[0]) for p in prints)
    want = plain_components(signed, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    for key_rows in (4096, 20):
        got = {r.node: r.component for r in components(links(df, 4, key_rows)).collect()}
        assert {p: got.get(p, p) for p in signed} == want


def test_plan_follows_size():
    half = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    assert sum(t for _, t in plan(1000, 1000 * half, 4)) == 4 - len(plan(1000, 1000 * half, 4)) + 1
    assert len(plan(10**10, 10**10 * half, 4)) < len(plan(10**5, 10**5 * half, 4))


def test_linked_is_a_forest():
    prints = np.array([0, 1, 3, 7, 7 << 40, 15], "i8")
    a, b = linked(np.array([1, 1, 1, 1, 1, 2], "i8"), prints, 1)
    assert sorted(zip(a, b, strict=True)) == [(0, 0), (1, 0), (3, 0), (7, 0)]


def test_documents(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(9, text), (4, text), (7, text + " tail"), (1, "something else entirely different here"), (2, None), (3, ""), (5, " \t"), (None, text), (1, "something else entirely different here")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    want = plain_components(range(len(rows)), lambda a, b: bin(plain_print(rows[a][1] or "") ^ plain_print(rows[b][1] or "")).count("1") <= 4)
    smallest = {r: min((rows[i][0] for i in want if want[i] == r and rows[i][0] is not None), default=None) for r in want.values()}
    expect = sorted([(i, f"{plain_print(t or ''):016x}", smallest[want[k]]) for k, (i, t) in enumerate(rows)], key=str)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == expect


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_chain(spark):
    edges = spark.range(1, 200).selectExpr("id as a", "id - 1 as b")
    got = components(edges).collect()
    assert len(got) == 200 and {r.component for r in got} == {0}
