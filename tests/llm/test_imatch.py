import hashlib
import math
import random
import re

import xxhash

from terrapulse.llm import imatch
from terrapulse.llm.imatch import SUBSETS, edit_check, fingerprints


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_terms(text):
    words = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower(), flags=re.ASCII) if w]
    return sorted({signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words})


def plain_signs(text, lexicon):
    own = plain_terms(text)
    kept = [t for t in own if t in lexicon] or own
    out = []
    for row, (count, share) in enumerate(SUBSETS):
        for number in range(count):
            chosen, h = [t for t in kept if (t >> 22 + 10 * row) % share == number], 42
            for t in chosen:
                h = xxhash.xxh64((t % (1 << 64)).to_bytes(8, "little"), seed=h).intdigest()
            out.append(f"{h & 0xFFFFFFFF:08x}" if chosen else "." * 8)
    return out


def near(a, b):
    judged = [(x, y) for x, y in zip(a, b, strict=True) if x[0] != "." or y[0] != "."]
    return sum(x == y for x, y in judged) / len(judged) if judged else 1.0


def plainly(rows, band):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64(r[1].encode(), seed=42).intdigest())), reverse=True)
    df = {}
    for _, t in rows:
        for x in plain_terms(t):
            df[x] = df.get(x, 0) + 1
    lexicon = {x for x, n in df.items() if band[0] <= math.log(len(rows) / n) <= band[1]}
    out = []
    for k, (i, t) in enumerate(rows):
        donor = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + donor[:half]
        a, b, c = (plain_signs(x, lexicon) for x in (t, edited, donor))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), round(near(a, b), 9), round(near(a, c), 9)))
    return sorted(out, key=str)


def some_rows():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)] + ["É𝄞a", "it's", "UP"]
    rows = [(rng.randrange(-500, 10**9), " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for _ in range(60)]
    return rows + [(None, "no id"), (7, None), (8, ""), (9, "..."), (10, rows[0][1]), rows[1], (rows[2][0], "same id, other text"), (11, "𝄞" * 5001)]


def test_against_brute_force(spark):
    rows, band = some_rows(), (math.log(3), math.log(40))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, bucket int, tag string").repartition(4)
    got = sorted(((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in edit_check(docs, band).collect()), key=str)
    assert got == plainly(rows, band)


def test_equal_texts(spark):
    docs = spark.createDataFrame([(1, "A b, c"), (2, "A b, c"), (3, "other words")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    assert got[1] == got[2] != got[3]


def test_single_and_no_row(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert edit_check(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert edit_check(one.limit(0)).count() == 0
    assert imatch.fingerprints(one.limit(0)).count() == 0


def test_fingerprints_by_the_lexicon_alone(spark):
    rows, band = some_rows(), (math.log(2), math.log(9))
    df = {}
    for _, t in rows:
        for x in plain_terms(t or ""):
            df[x] = df.get(x, 0) + 1
    lexicon = {x for x, n in df.items() if band[0] <= math.log(len(rows) / n) <= band[1]}
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, known long").repartition(3)
    got = sorted((str(r.doc_id), r.text, r.fingerprint) for r in fingerprints(docs, band).collect())
    assert got == sorted((str(i), t or "", "".join(plain_signs(t or "", lexicon))) for i, t in rows)


def test_terms_meet_the_lexicon_where_they_are(spark):
    """Exploding, joining and putting together again shuffles no terms: the rows stay in their buckets."""
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i}") for i in range(200)], "doc_id long, text string")
    plan = edit_check(docs)._jdf.queryExecution().optimizedPlan().toString()
    physical = edit_check(docs)._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in plan and "BroadcastHashJoin" in physical
    executed = edit_check(docs)
    executed.collect()
    final = executed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("hashpartitioning(bucket") <= 2  # by the texts' window and, where a guest is looked for, its bucket
