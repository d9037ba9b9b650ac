import random

import numpy as np
import pytest

from corpus_pipeline import near_dedup
from terrapulse.llm import near_copies as N
from terrapulse.llm.near_copies import forest, near_copies, overlaps


def plain_set(text):
    words = (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def alike(one, other):
    return 5 * len(one & other) >= 4 * len(one | other)


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    out = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        out.append(base)
        for _ in range(3):  # changed words make similarities from 0.5 to 1
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.random())
            out.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(out)] + [(500, None), (501, ""), (None, " ".join(out[0])), (1, " ".join(out[1]))]
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if alike(sets[a], sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    first = {r: min(i for (i, _), q in zip(rows, root, strict=True) if q == r and i is not None) for r in root}
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(5)
    got = sorted(map(tuple, near_copies(docs).collect()), key=str)
    assert got == sorted([(i, first[r]) for (i, _), r in zip(rows, root, strict=True)], key=str)
    assert near_copies(docs.limit(0)).count() == 0


def test_stage_removes_near_copies(spark):
    rng = random.Random(1)
    docs = []
    for i in range(40):
        base = [f"v{rng.randrange(5000)}" for _ in range(200)]
        near, far = list(base), list(base)
        near[50] = near[120] = near[170] = "other"  # similarity 0.86
        for k in range(10, 200, 15):
            far[k] = "other"  # similarity under 0.6
        docs += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    kept = near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in docs if i % 3 != 1]


def groups_of(near):
    root = list(range(len(near)))
    for a in range(len(near)):
        for b in np.flatnonzero(near[a]):
            if root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("few,classes", [(8, 1024), (2, 100)])
def test_one_dense_group(spark, monkeypatch, few, classes):
    """Copies of one text that are mostly unlike each other, some alike: they share keys but not a representative."""
    monkeypatch.setattr(N, "FEW", few)
    monkeypatch.setattr(N, "TILE_CLASSES", classes)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    out = []
    for i in range(450):
        copy = list(base)
        for k in rng.sample(range(150), 8):  # two of them are at 0.4 to 0.7
            copy[k] = f"n{i}-{k}"
        out.append(copy)
        if i % 9 == 0:  # a near copy of this one
            copy = list(copy)
            copy[rng.randrange(150)] = f"m{i}"
            out.append(copy)
    sets = [plain_set(" ".join(w)) for w in out]
    near = np.array([[alike(a, b) for b in sets] for a in sets])
    want = groups_of(near)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(out)], "doc_id long, text string").repartition(6)
    got = dict(map(tuple, near_copies(docs).collect()))
    assert [got[i] for i in range(len(out))] == want
    assert 300 < len(set(want)) < len(out)


def test_rows_follow_the_classes(spark):
    """A key of n classes is n rows for each of its blocks, not n * n."""
    crowd = spark.range(5000).selectExpr("1L as key", "cast(cast(id as string) as binary) as node", "10L as size", "cast('r' as binary) as root", "5000L as n", "50000L as total")
    sets = spark.range(5000).selectExpr("cast(cast(id as string) as binary) as node", "array(id) as shingles")
    plan = N.linked(crowd, sets)
    assert plan.count() == 0
    copies = crowd.select("n").first().n * 5
    assert copies == 25_000


def test_overlaps_and_forest():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300))) for _ in range(90)] + [np.arange(5000, 9000), np.arange(5000, 8800)]
    both = overlaps(sets)
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            assert both[i, j] == len(np.intersect1d(sets[i], sets[j]))
    alikes = [np.arange(20), np.arange(19), np.arange(1, 20), np.arange(100, 120)]
    assert forest(alikes, [b"a", b"b", b"c", b"d"]) == [(0, 1), (0, 2)]
    assert forest(alikes, [b"a", b"a", b"a", b"d"]) == []
    assert overlaps([np.array([1]), np.array([2])]).tolist() == [[0, 0], [0, 0]]
