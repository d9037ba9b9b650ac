"""Secret scans with multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrapulse.llm.common import checkpointed, query, table


@dataclass(frozen=True)
class Kind:
    """``measured``: the group whose length decides, ``least`` characters being needed. ``hints``: of these strings a
    text must hold one, in either case, to be searched at all. ``role``: what part of a credential it is."""

    name: str
    pattern: str
    measured: int
    least: int
    hints: tuple[str, ...]
    role: str
    weak: bool = False


# The three base kinds and their patterns.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "api"), "secret"),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",), "id"),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, (), "secret"),
)
#: Candidates that mean nothing alone: a login, an opaque string and an address.
WEAK = (
    Kind("login", r"""(?i)(user(?:_?name)?|login|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3, ("user", "login", "client", "key"), "id", True),
    Kind("opaque", r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32, (), "secret", True),
    Kind("endpoint", r"""[a-z][a-z0-9+.-]*://[^\s"'<>]+""", 0, 8, ("://",), "endpoint", True),
)
#: The roles one of which must stand within the scope for a weak candidate of a role to be reported.
COMPLEMENTS = {"id": ("secret",), "secret": ("id",), "endpoint": ("id", "secret")}
SPAN = "array<struct<gap:int,size:int,measured:int>>"


def _matches(text: Column, kind: Kind) -> Column:
    """For each match the characters since the one before, its length and the length that decides."""
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(kind.measured)) if kind.measured else found
    # The pieces between matches and the matches are the whole text, so their lengths give the places.
    pieces = F.arrays_zip(F.slice(F.split(text, kind.pattern, -1), 1, F.size(found)).alias("g"), found.alias("f"), measured.alias("m"))
    return F.transform(pieces, lambda x: F.struct(F.char_length(x["g"]).alias("gap"), F.char_length(x["f"]).alias("size"), F.char_length(x["m"]).alias("measured")))


def parts_of(docs: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """``doc_id, tag, kind, start, end`` of every match that is long enough, in code points."""
    low, empty = F.lower("text"), F.array().cast(SPAN)

    def found(kind: Kind) -> Column:
        searched = F.col("text").rlike(kind.pattern)
        if kind.hints:
            searched = reduce(lambda a, b: a | b, [F.contains(F.col("low"), F.lit(h)) for h in kind.hints]) & searched
        return F.when(searched, _matches(F.col("text"), kind)).otherwise(empty)

    scanned = docs.withColumn("low", low)
    listed = F.array(*[F.struct(F.lit(number).alias("kind"), found(k).alias("spans")) for number, k in enumerate(kinds)])
    hit = scanned.select("doc_id", "tag", F.filter(listed, lambda x: F.size(x["spans"]) > 0).alias("listed")).where(F.size("listed") > 0)
    rows = hit.select("doc_id", "tag", F.explode_outer("listed").alias("l")).select("doc_id", "tag", "l.kind", F.posexplode_outer("l.spans").alias("place", "s"))
    rows = rows.distinct()  # rows that repeat each other have the same spans
    along = Window.partitionBy("doc_id", "tag", "kind").orderBy("place")
    end = F.sum(F.col("s.gap") + F.col("s.size")).over(along)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("s.size"))
    least = F.element_at(F.array(*[F.lit(k.least) for k in kinds]), F.col("kind") + 1)
    return placed.where(F.col("s.measured") >= least).select("doc_id", "tag", "kind", "start", "end")


def within(parts: DataFrame, others: DataFrame, scope: int, width: int, how: str) -> DataFrame:
    """The ``parts`` that have one of ``others`` of the same text at most ``scope`` characters away (or have none).

    An interval join: both sides are keyed by stretches of ``width`` characters, a part by all that its surroundings
    touch, so that a pair meets under a key of few rows, however long the text.
    """

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))

    right = others.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), F.col("start").alias("s"), F.col("end").alias("e"), "wanted")
    right = right.withColumn("cell", cells(F.col("s"), F.col("e")))
    left = parts.withColumn("c", cells(F.col("start") - scope, F.col("end") + scope))
    near = (F.col("s") < F.col("end") + scope) & (F.col("e") > F.col("start") - scope)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")) & (F.col("c") == F.col("cell")) & (F.col("role") == F.col("wanted"))
    met = left.join(right, same & near, "left_semi").drop("c").distinct()
    return met if how == "semi" else parts.join(met, [parts[c].eqNullSafe(met[c]) for c in parts.columns], "left_anti")


def find_secrets(docs: DataFrame, scope: int = 200, width: int = 400) -> DataFrame:
    """``doc_id, tag, kind, start, end`` of every secret; ``kind`` numbers ``BASE`` and then ``WEAK``.

    Matches of the base kinds are always reported. Weak candidates are reported where a complementary part, itself
    weak or not, stands at most ``scope`` characters away in the same text, and no base match covers them. ``tag`` is
    the digest of the text, so rows of one id stay apart.
    """
    kinds = BASE + WEAK
    roles = F.array(*[F.lit(k.role) for k in kinds])
    parts = checkpointed(parts_of(rows_of(docs), kinds).withColumn("role", F.element_at(roles, F.col("kind") + 1)))
    base, weak = parts.where(F.col("kind") < len(BASE)), parts.where(F.col("kind") >= len(BASE))
    every = F.array(*[F.lit(r) for r in COMPLEMENTS])
    free = checkpointed(within(weak, base.withColumn("wanted", F.explode(every)), 0, width, "anti"))
    # Each part offers itself to the roles that it completes.
    serves = F.create_map(*[F.lit(x) for role in COMPLEMENTS for x in (role, [r for r, c in COMPLEMENTS.items() if role in c] or [""])])
    offers = base.unionByName(free).withColumn("wanted", F.explode(serves[F.col("role")]))
    return base.unionByName(within(free, offers, scope, width, "semi")).drop("role")


def rows_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("tag"), text.alias("text"))


def span_lists(spans: DataFrame) -> DataFrame:
    """``doc_id, tag, found``: the spans of a text by start and kind; a list is bounded by its text."""
    return spans.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row of ``docs``.

    A null text is empty and has no spans; repeated rows and null ids keep their rows; an empty table gives no rows;
    other columns are ignored.
    """
    names = F.array(*[F.lit(k.name) for k in BASE + WEAK])
    rows, lists = rows_of(docs).select("doc_id", "tag"), span_lists(find_secrets(docs))
    lists = lists.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "found")
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left").withColumn("found", found)

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")

    def count(number: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == number)).cast("long").alias(f"n_{BASE[number].name}")

    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    return joined.select("doc_id", *map(count, range(len(BASE))), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``, and ``n_chars`` following; clean rows stay as they are.

    Overlapping spans become one mark. A null text stays null, an empty one empty; rows of one id are told apart by
    their text, repeated rows and null ids stay; an empty table gives no rows. All columns come back, whatever their
    names.
    """
    lists = span_lists(find_secrets(docs))
    same = docs["doc_id"].cast("long").eqNullSafe(lists["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == lists["tag"])
    found = lists["found"]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(docs["text"], (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        out = F.when(span["start"] >= done["at"], F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), out.alias("out"))

    def finish(done: Column) -> Column:
        return F.concat(done["out"], F.substring(docs["text"], (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    clean = F.aggregate(found, start, step, finish)
    joined = docs.join(lists, same, "left")
    changed = {"text": F.when(found.isNull(), docs["text"]).otherwise(clean)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(found.isNull(), docs["n_chars"]).otherwise(F.char_length(clean)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])


@query("op7_secret_scans")
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
