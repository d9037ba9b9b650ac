"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrapulse.llm.common import checkpointed, query, table

#: The inverse-document-frequency band, in natural logarithms: terms in more than a quarter of the documents say
#: little, terms in fewer than one of 2000 change with every small edit.
IDF_BAND = (math.log(4), math.log(2000))
#: (subsets, share): so many random subsets of the lexicon, each with one of so many terms. The dense ones hold every
#: term and tell short texts apart, sparse ones still agree on long texts of which a part has changed.
SUBSETS = ((4, 4), (12, 64), (24, 256), (24, 1024))


def terms(text: Column) -> Column:
    """Digests of the distinct words, lower case, without the marks around them, sorted."""
    words = F.split(F.lower(text), r"[\s\p{Punct}]+")
    hashed = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.array_sort(F.array_distinct(hashed))


def lexicon(listed: DataFrame, band: tuple[float, float]) -> DataFrame:
    """``known``: the terms within the band; document frequencies are counted over all rows of ``listed`` (``terms``).

    Each of the terms is in more than ``exp(-band[1])`` of the documents, so there are at most the mean number of
    distinct terms times ``exp(band[1])`` of them, whatever the number of documents: that bounds their broadcast.
    """
    total = listed.count()
    counted = listed.select(F.explode("terms").alias("known")).groupBy("known").count()
    return checkpointed(counted.where(F.log(F.lit(total) / F.col("count")).between(*band)).select("known"))


def within(rows: DataFrame, keys: list[str], lists: list[str], known: DataFrame) -> DataFrame:
    """``rows``, one for each value of ``keys``, with the terms in the columns ``lists`` cut down to the ``known`` ones.

    A list without any stays as it is. The terms of all lists become rows and meet the lexicon by an equi-join, then
    those met are put together again and the lists cut down to them; where ``rows`` are partitioned by some of the
    keys, nothing is shuffled. What else a row holds comes along with one more of its term rows, which has no term.
    """
    others = [c for c in rows.columns if c not in keys]
    every = F.col(lists[0])
    for name in lists[1:]:
        every = F.array_union(every, F.col(name))
    held = rows.select(*keys, F.struct(*others).alias("held"), F.array_append(every, F.lit(None).cast("bigint")).alias("every"))
    # The outer form: a plain explode would build the whole array a second time, in a filter.
    spread = held.select(*keys, "held", F.explode_outer("every").alias("term")).select(*keys, "term", F.when(F.col("term").isNull(), F.col("held")).alias("held"))
    met = spread.join(F.broadcast(known), F.col("term") == F.col("known"), "left").where("term is null or known is not null")
    put = met.groupBy(*keys).agg(F.first("held", ignorenulls=True).alias("held"), F.collect_list("term").alias("kept"))

    def cut(name: str) -> Column:
        own = F.array_intersect(f"held.{name}", "kept")  # in the order of the list
        return F.when(F.size(own) > 0, own).otherwise(F.col(f"held.{name}")).alias(name)

    return put.select(*keys, *[cut(c) if c in lists else f"held.{c}" for c in others])


def signatures(kept: Column) -> Column:
    """A digest for each lexicon subset, null where a text has no term of the subset.

    Of each density the terms of any of its subsets are picked first, so that a subset looks at few terms.
    """

    def density(kept: Column, count: int, share: int, shift: int) -> Column:
        def subset(term: Column) -> Column:
            # The high bits of a term's digest, other ones for each density, choose the subset.
            return F.pmod(F.shiftright(term, shift), F.lit(share))

        def sign(picked: Column, number: int) -> Column:
            chosen = F.filter(picked, lambda t: subset(t) == number)
            return F.when(F.size(chosen) > 0, F.xxhash64(chosen))

        picked = kept if count == share else F.filter(kept, lambda t: subset(t) < count)
        return F.transform(F.array(picked), lambda p: F.array(*[sign(p, number) for number in range(count)]))[0]

    listed = [(count, share, 22 + 10 * row) for row, (count, share) in enumerate(SUBSETS)]
    return F.transform(F.array(kept), lambda k: F.concat(*[density(k, *x) for x in listed]))[0]


def spelled(signs: Column) -> Column:
    """Eight hex digits for each subset, eight dots where there is no term."""
    word = F.transform(signs, lambda s: F.coalesce(F.lower(F.lpad(F.hex(s.bitwiseAND(0xFFFFFFFF)), 8, "0")), F.lit("." * 8)))
    return F.array_join(word, "")


def likeness(one: Column, other: Column) -> Column:
    """The share of subsets on which two texts agree, of those in which either has a term; 1 for two empty texts."""
    pairs = F.zip_with(one, other, lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a == b, F.lit(False)).cast("int")))
    judged = F.filter(pairs, lambda x: x.isNotNull())
    agreed = F.aggregate(judged, F.lit(0), lambda n, x: n + x)
    return F.when(F.size(judged) == 0, F.lit(1.0)).otherwise(agreed / F.size(judged))


def fingerprints(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """``doc_id, text, signs, fingerprint`` of every row; equal texts have equal fingerprints.

    A text without a term in the band is judged by all its terms. A null text is empty and its fingerprint all dots;
    repeated rows and null ids keep their rows, an empty table gives no rows, other columns are ignored.
    """
    rows = rows_of(docs)
    known = lexicon(rows.select(terms(F.col("text")).alias("terms")), band)
    listed = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", terms(F.col("text")).alias("terms"))
    signed = within(listed, ["row"], ["terms"], known).select("doc_id", "text", signatures(F.col("terms")).alias("signs"))
    return signed.withColumn("fingerprint", spelled(F.col("signs")))


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def with_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt to ``buckets`` stretches of ids of about equal size; the one without an id goes with the smallest.

    The stretches' bounds are quantiles of all ids, as many as there are buckets, found by a binary search in each row.
    """
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)]) if buckets > 1 else F.array(F.lit(0.5))
    bounds = rows.agg(F.array_distinct(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * buckets))))).scalar()
    steps = F.array(*[F.lit(1 << k) for k in range(buckets.bit_length(), -1, -1)])

    def move(at: Column, step: Column) -> Column:
        inside = (at + step <= F.size("_bounds")) & (F.try_element_at("_bounds", at + step) < F.col("doc_id"))
        return F.when(inside, at + step).otherwise(at)

    held = rows.withColumn("_bounds", bounds)
    return held.withColumn("bucket", F.coalesce(F.aggregate(steps, F.lit(0), move), F.lit(0))).drop("_bounds")


def beside_next(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, doc_id, text, guest``: rows by bucket, each bucket closed by a copy of the row that follows it.

    In descending order of ids every row is followed by the next one of its bucket, the last row of a bucket by the
    guest: the first of the next lower bucket that has rows, and after the lowest the first of all.
    """
    rows = with_bucket(rows_of(docs), buckets).withColumn("tag", F.xxhash64("text"))
    heads = rows.groupBy("bucket").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), "tag")).alias("head"))
    # As many rows as buckets.
    around = Window.partitionBy(F.lit(0)).orderBy("bucket")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = heads.withColumn("guest_of", F.coalesce(F.lead("bucket").over(around), F.first("bucket").over(whole)))
    asked = follows.select(F.col("bucket").alias("b"), F.col("head.o").alias("o"), F.col("head.tag").alias("t"), "guest_of")
    same = (F.col("bucket") == F.col("b")) & (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("o")) & (F.col("tag") == F.col("t"))
    # One row for each bucket, so a broadcast of bounded size.
    guests = rows.join(F.broadcast(asked), same).select(F.col("guest_of").alias("bucket"), "doc_id", "text", "tag", F.lit(1).alias("guest"))
    return rows.select("bucket", "doc_id", "text", "tag", F.lit(0).alias("guest")).unionByName(guests)


def edit_check(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """How far fingerprints follow edits: each text against itself with its last half replaced, and the next text.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The last
    floor(n / 2) code points are replaced by the first as many of the next text in descending order of ids, rows
    without an id coming last and rows of one id by the digest of their text; the last is followed by the first, and
    a single row by itself. Texts move once, to their bucket.
    """
    known = lexicon(rows_of(docs).select(terms(F.col("text")).alias("terms")), band)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tag").desc())
    n_chars, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    paired = beside_next(docs, buckets).withColumn("donor", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
    edited = F.concat(F.substring("text", F.lit(1), n_chars - half), F.substring("donor", F.lit(1), half))
    # The guest, the last of its bucket, is only the next text of another.
    paired = paired.withColumn("edited", F.when(F.col("guest") == 0, edited))
    listed = paired.select(
        "bucket",
        "place",
        "guest",
        "doc_id",
        n_chars.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        terms(F.col("text")).alias("own"),
        F.coalesce(terms(F.col("edited")), F.array().cast("array<bigint>")).alias("changed"),
    )
    cut = within(listed, ["bucket", "place"], ["own", "changed"], known)
    signed = cut.select("bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256", signatures(F.col("own")).alias("signs"), signatures(F.col("changed")).alias("edited_signs"))
    signed = signed.withColumn("next_signs", F.lead("signs").over(Window.partitionBy("bucket").orderBy("place"))).where("guest = 0")
    return signed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelled(F.col("signs")).alias("fingerprint"),
        spelled(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


@query("op1_document_fingerprints")
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_check(table(spark, sf_dir, "documents"))
