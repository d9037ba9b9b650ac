"""A Merkle manifest of the dataset: leaves, subroots, root and the proof of every row, by a nested-struct rollup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed, query, table

#: Levels of the tree that one rank digit stands for, and digits of a block: a block holds 2 ** (4 * 3) nodes.
DIGIT_LEVELS, DIGITS = 4, 3
PATH = "array<struct<sibling:string, right:boolean>>"


def field(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    columns = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.sha2(F.concat(*map(field, columns)), 256)


def ranked(nodes: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``group, rank, levels`` and the other columns: the place of each row in its group and the height of its tree.

    The rows are sorted by ranges, so a group of any size spreads over many tasks; a row's rank is its place in its
    range and the counts of the ranges before. Equal rows take any order among themselves.
    """
    keys = ["group", *order, F.rand(7)]
    spread = nodes.repartitionByRange(partitions, *keys) if partitions else nodes.repartitionByRange(*keys)
    stored = checkpointed(spread.sortWithinPartitions("group", *order).withColumn("at", F.monotonically_increasing_id()))
    stored = stored.withColumn("range", F.shiftright("at", 33))
    counts = stored.groupBy("group", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(own)
    levels = F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0)
    starts = counts.select("group", "range", (before - F.col("first")).alias("shift"), levels.alias("levels"))
    return stored.join(starts, ["group", "range"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _run(done: int) -> tuple[Column, Column]:
    """The levels of a run of children (their nodes, the digests of each two, ...) and the run's own node.

    ``done`` levels lie below; a tree that has fewer levels than these and the run's applies fewer, so its root passes.
    """
    up = "transform(sequence(0, (size({0}) - 1) div 2), i -> sha2(concat({0}[2 * i], coalesce(get({0}, 2 * i + 1), '')), 256))"
    applied = f"least({DIGIT_LEVELS}, greatest(0, levels - {done}))"
    grown = f"""aggregate(sequence(1, {DIGIT_LEVELS}), array(transform(children, c -> c.node)),
        (all, l) -> if(l <= {applied}, array_append(all, {up.format("element_at(all, -1)")}), all))"""
    return F.expr(grown), F.expr("element_at(runs, -1)[0]")


def rolled(nodes: DataFrame, done: int) -> DataFrame:
    """``group, block, levels, node, tree``: one row for each block, all that is below nested in its tree.

    The rank's digits are grouped away one after the other, from the lowest. All of it happens where a block's rows
    meet: the first shuffle is by block, and a block's keys are among the keys of every grouping.
    """
    digits = [f"d{k}" for k in range(DIGITS)]
    mask = (1 << DIGIT_LEVELS) - 1
    shifted = {d: F.shiftright("rank", DIGIT_LEVELS * k).bitwiseAND(F.lit(mask)).cast("int") for k, d in enumerate(digits)}
    rows = nodes.withColumns({**shifted, "block": F.shiftright("rank", DIGIT_LEVELS * DIGITS)})
    rows = rows.select("group", "block", "levels", *digits, F.struct("node", "payload").alias("below")).repartition("group", "block")
    for k, digit in enumerate(digits):
        keys = ["group", "block", "levels", *digits[k + 1 :]]
        child = F.struct(F.col(digit).alias("digit"), *[F.col(f"below.{f}").alias(f) for f in (("node", "payload") if k == 0 else ("node", "runs", "children"))])
        rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(child)).alias("children"))
        runs, node = _run(done + DIGIT_LEVELS * k)
        rows = rows.withColumn("runs", runs).withColumn("node", node).withColumn("below", F.struct("node", "runs", "children")).select(*keys, "below")
    return rows.select("group", "block", "levels", F.col("below.node").alias("node"), F.col("below").alias("tree"))


def _leaves() -> str:
    """SQL: the array of ``payload, path`` of all that the tree holds; the path goes from the leaf to the block's node."""

    def siblings(digit: str, runs: str) -> str:
        at = f"struct(get({runs}[l], shiftright({digit}, l) ^ 1) AS sibling, (shiftright({digit}, l) & 1) = 1 AS right)"
        return f"transform(slice(sequence(0, {DIGIT_LEVELS}), 1, size({runs}) - 1), l -> {at})"

    path, parents = [], ["tree", *[f"c{k}" for k in range(DIGITS - 1, 0, -1)]]
    for k in range(DIGITS):
        path.append(siblings(f"c{k}.digit", f"{parents[DIGITS - 1 - k]}.runs"))
    inner = f"transform({parents[-1]}.children, c0 -> struct(c0.payload AS payload, concat({', '.join(path)}) AS path))"
    for k in range(1, DIGITS):
        inner = f"flatten(transform({parents[DIGITS - 1 - k]}.children, c{k} -> {inner}))"
    return inner


def proofs(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], done: int = 0, rounds: int | None = None) -> DataFrame:
    """``payload, path`` and the columns of ``above``, for ranked ``nodes`` (``group, rank, levels, node, payload``).

    Blocks are rolled up in rounds until one node of each group is left; ``above`` takes these (``group, node``) and
    gives the path over each (``group, over`` and further columns). Paths of blocks meet their blocks, one row each;
    leaves are not joined, they come out of their block's tree.
    """
    if rounds is None:
        most = nodes.agg(F.max("levels")).first()[0] or 0
        rounds = max(1, -(-most // (DIGIT_LEVELS * DIGITS)))
    blocks = checkpointed(rolled(nodes, done))
    if rounds == 1:
        tops = above(blocks.select("group", "node"))
        extra = [c for c in tops.columns if c not in ("group", "over")]
        met = blocks.join(tops, "group")
    else:
        upper = blocks.select("group", F.col("block").alias("rank"), "levels", "node", F.struct("group", "block").alias("payload"))
        tops = proofs(upper, above, done + DIGIT_LEVELS * DIGITS, rounds - 1)
        extra = [c for c in tops.columns if c not in ("payload", "path")]
        met = blocks.join(tops.select("payload.*", F.col("path").alias("over"), *extra), ["group", "block"])
    # The outer form: a plain explode would build the whole array a second time, in a filter.
    spread = met.select("over", *extra, F.explode_outer(F.expr(_leaves())).alias("own"))
    return spread.select("own.payload", F.concat("own.path", "over").alias("path"), *extra)


def fold(node: Column, path: Column) -> Column:
    """The root that follows from a node and its siblings."""

    def step(now: Column, at: Column) -> Column:
        other = F.coalesce(at["sibling"], F.lit(""))
        return F.sha2(F.when(at["right"], F.concat(other, now)).otherwise(F.concat(now, other)), 256)

    return F.aggregate(path, node, step)


def manifest(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Trees are binary: leaves of a language ascend by doc_id (null first; equal ids by leaf), subroots by language (null
    first, bytewise). Null fields have their own mark, empty and very long texts are values as others, repeated rows
    are leaves each, other columns are ignored, an empty table gives no rows. Tampering adds 1 to n_chars where 7
    divides the crc32 of the decimal doc_id; nulls stay (so do rows without an id) and so verify. An n_chars at the end
    of its type becomes null by tampering.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("group"),  # sorts as the language does
        "doc_id",
        leaf(F.col("n_chars")).alias("node"),
        F.when(tampered, leaf(F.try_add(F.col("n_chars"), F.lit(1)))).alias("changed"),
    )
    rows = ranked(leaves, ["doc_id", "node"], partitions)
    rows = rows.select("group", "rank", "levels", "node", F.struct("doc_id", "changed", F.col("node").alias("leaf")).alias("payload"))

    def over(subroots: DataFrame) -> DataFrame:
        own = subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "node")
        top = ranked(own, ["name"]).select("group", "rank", "levels", "node", F.struct("name", F.col("node").alias("subroot")).alias("payload"))
        root = proofs(top, lambda last: last.select("group", F.expr(f"cast(array() AS {PATH})").alias("over"), F.col("node").alias("root")))
        return checkpointed(root.select(F.col("payload.name").alias("group"), "payload.subroot", "root", F.col("path").alias("over")))

    found = proofs(rows, over)
    siblings = F.array_join(F.transform("path", lambda p: p["sibling"]), "")
    found = found.select("payload.*", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("payload.changed", "payload.leaf"), F.col("path")).alias("folded_root"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle() -> str:
    """The same manifest in SQL, by recursion over the levels of the trees."""

    def leaf_of(n_chars: str) -> str:
        parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
        return f"sha256({' || '.join(parts)})"

    return f"""
    WITH RECURSIVE crc AS (
        SELECT DISTINCT doc_id AS id, doc_id::VARCHAR AS s, 0 AS step, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
        UNION ALL
        SELECT id, s, step + 1, xor(x >> 1, (x & 1) * 3988292384) FROM (SELECT id, s, step,
            CASE WHEN step % 8 = 0 THEN xor(c, ascii(s[step // 8 + 1])::BIGINT) ELSE c END AS x FROM crc WHERE step < 8 * length(s))
    ), leaves AS (
        SELECT d.doc_id, coalesce('=' || lang, '') AS k, {leaf_of("n_chars")} AS leaf,
            CASE WHEN xor(c, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN {leaf_of("(n_chars + 1)")} END AS changed
        FROM documents d LEFT JOIN crc ON crc.id = d.doc_id AND step = 8 * length(s)
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM leaves
    ), tree AS (
        SELECT k, 0 AS level, pos, n, leaf AS node FROM ranked
        UNION ALL
        SELECT a.k, a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.node || coalesce(b.node, ''))
        FROM tree a LEFT JOIN tree b ON b.k = a.k AND b.pos = a.pos + 1 WHERE a.n > 1 AND a.pos % 2 = 0
    ), subroots AS (
        SELECT k, node AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
    ), top AS (
        SELECT 0 AS level, pos, n, subroot AS node FROM subroots
        UNION ALL
        SELECT a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.node || coalesce(b.node, ''))
        FROM top a LEFT JOIN top b ON b.pos = a.pos + 1 WHERE a.n > 1 AND a.pos % 2 = 0
    ), steps AS (
        SELECT r.k, r.pos, l.level, (r.pos >> l.level) & 1 AS side, t.node AS sibling
        FROM ranked r JOIN (SELECT DISTINCT k, level FROM tree WHERE n > 1) l ON l.k = r.k
        LEFT JOIN tree t ON t.k = r.k AND t.level = l.level AND t.pos = xor(r.pos >> l.level, 1)
        UNION ALL
        SELECT r.k, r.pos, 1000 + l.level, (s.pos >> l.level) & 1, t.node
        FROM ranked r JOIN subroots s ON s.k = r.k CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) l
        LEFT JOIN top t ON t.level = l.level AND t.pos = xor(s.pos >> l.level, 1)
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY k, pos ORDER BY level) AS i FROM steps
    ), folded AS (
        SELECT k, pos, 0 AS i, coalesce(changed, leaf) AS node FROM ranked
        UNION ALL
        SELECT f.k, f.pos, f.i + 1, sha256(CASE WHEN side = 1 THEN coalesce(sibling, '') || node ELSE node || coalesce(sibling, '') END)
        FROM folded f JOIN numbered s ON s.k = f.k AND s.pos = f.pos AND s.i = f.i + 1
    ), proof AS (
        SELECT k, pos, count(*) AS i, string_agg(coalesce(sibling, ''), '' ORDER BY level) AS siblings FROM steps GROUP BY 1, 2
    )
    SELECT r.doc_id, r.leaf, s.subroot, root.node AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
        f.node AS folded_root, f.node = root.node AS verified
    FROM ranked r JOIN subroots s ON s.k = r.k JOIN (SELECT node FROM top WHERE n = 1) root ON true
    LEFT JOIN proof p ON p.k = r.k AND p.pos = r.pos JOIN folded f ON f.k = r.k AND f.pos = r.pos AND f.i = coalesce(p.i, 0)
    """


@query("op13_merkle_manifest", _oracle())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
