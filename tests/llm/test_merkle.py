import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from terrapulse.llm import merkle
from terrapulse.llm.merkle import manifest, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """The root, and for each node its siblings (None where it is alone) with the side it stands on."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, at in zip(paths, places):
            path.append((level[at ^ 1] if at ^ 1 < len(level) else None, at & 1))
        places = [at // 2 for at in places]
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def brute(rows):
    leaf = {r: digest(*map(field, (r[0], r[3], r[2], r[4], r[1]))) for r in rows}
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    found, subroots = [], {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf[r]))
        subroots[lang], paths = tree([leaf[r] for r in own])
        found += zip(own, paths)
    root, tops = tree([subroots[lang] for lang in langs]) if langs else (None, [])
    out = []
    for r, path in found:
        full = path + tops[langs.index(r[2])]
        changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        node = digest(*map(field, (r[0], r[3], r[2], r[4] + 1, r[1]))) if changed else leaf[r]
        for sibling, right in full:
            node = digest(sibling or "", node) if right else digest(node, sibling or "")
        out.append((r[0], leaf[r], subroots[r[2]], root, digest(*[s or "" for s, _ in full]), node, node == root))
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as rank", "2 as `group`", "'p' as payload", "3 as node", "4 as levels", "5 as block")
    return sorted(map(tuple, manifest(df, **more).collect()), key=str)


def documents(n, lang="en", start=0):
    return [(i * 3 + start, f"text {i} é\n", lang, f"s{i % 3}", 9 + i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 31, 33, 257])
def test_sizes_of_one_language(spark, n):
    assert got(spark, documents(n)) == brute(documents(n))


def test_languages_in_order(spark):
    rows = []
    for k, (lang, n) in enumerate([("en", 40), ("de", 1), (None, 6), ("", 3), ("é", 2), ("z", 18), ("Z", 7)]):
        rows += documents(n, lang, 1000 * k)
    found = got(spark, rows)
    assert found == brute(rows)
    assert {r[6] for r in found} == {True, False}


def test_many_blocks(spark, monkeypatch):
    """Blocks of 16 nodes and of 4: three rounds, and nothing changes."""
    rows = documents(300) + documents(70, "fr", 10_001) + documents(1, "it", 20_000)
    want = brute(rows)
    for levels, digits in ((2, 2), (1, 2), (4, 1)):
        monkeypatch.setattr(merkle, "DIGIT_LEVELS", levels)
        monkeypatch.setattr(merkle, "DIGITS", digits)
        assert got(spark, rows) == want


def test_nulls_ties_and_repeated_rows(spark):
    rows = documents(20) + documents(20)[:9] + [(3, "other", "en", None, None), (None, None, None, None, None), (None, "x", "en", "s", 4), (None, "x", "en", "s", 4), (7, "", "en", "", 0)]
    rows += [(9, "long " * 200_000, "en", "s", 1_000_000), ((1 << 63) - 1, "t", "en", "s", 5)]
    found = got(spark, rows)
    # Equal leaves have different places and so different proofs; as a whole the rows are the same.
    assert found == brute(rows)


def test_one_id_in_a_third_of_the_rows(spark):
    rows = documents(200) + [(60, "same", "en", "s", 4)] * 100
    assert got(spark, rows, partitions=7) == brute(rows)
    spread = ranked(spark.range(3000).select(F.lit("g").alias("group"), F.lit(5).alias("key")), ["key"], 6)
    assert sorted(r["rank"] for r in spread.collect()) == list(range(3000))
    assert spread.select("levels").distinct().collect()[0][0] == 12


def test_the_end_of_a_long(spark):
    tampered = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0)
    assert [r[6] for r in got(spark, [(tampered, "t", "en", "s", (1 << 63) - 1)])] == [False]


def test_empty_table(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).collect() == []
