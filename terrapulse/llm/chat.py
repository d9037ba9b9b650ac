"""Chat formatting: a state machine over roles, text segments with loss flags, and the way back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm.common import query, ship, table


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like and which turn may follow which.

    A turn is ``opening``, the role's name, ``closing``, the escaped text, ``end``. A role without a name of its own is
    written as ``@`` and the escaped role. ``after`` has the roles allowed in each state, the state being the role of
    the turn before; ``last`` the states in which a conversation may end.
    """

    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    opening: str = "### "
    closing: str = ": "
    end: str = " </turn>\n"
    after: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    last: tuple[str, ...] = ("assistant", "user")
    loss: tuple[str, ...] = ("assistant",)

    def header(self, role: str) -> str:
        return self.opening + (self.names.get(role) or "@" + escape(role).replace(":", "\\:")) + self.closing

    def step(self, state: str, role: str) -> str | None:
        """None if ``role`` may follow ``state``, else what is wrong."""
        return None if role in self.after.get(state, ()) else f"{role or '(none)'} after {state or 'start'}"


#: Runs that could be read as a turn's mark; the backslash itself is always escaped, so that escapes read back.
_CONTROL = re.compile(r"\\|#{3,}|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "".join("\\" + c for c in m[0]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segments(turns: Iterator[tuple[str, str]], template: Template) -> Iterator[tuple[str, bool, str | None]]:
    """Text, loss flag and violation of each segment of one conversation, three segments for a turn."""
    state = ""
    for role, text in turns:
        wrong, state = template.step(state, role), role
        yield template.header(role), False, wrong
        yield escape(text), role in template.loss, wrong
        yield template.end, False, wrong


def parse(parts: Iterator[tuple[str, bool]], template: Template) -> Iterator[tuple[str, str, str]]:
    """Role, text and text under the loss mask of each turn that the formatted segments spell.

    Only what is written counts: the segments are joined and cut at the marks, an escaped character being no mark.
    """
    body = r"((?:\\.|[^\\])*?)"
    turn = re.compile(re.escape(template.opening) + body + re.escape(template.closing) + body + re.escape(template.end), re.DOTALL)
    roles = {name: role for role, name in template.names.items()}
    held, masked = "", []
    for text, loss in parts:
        if loss:
            masked.append((len(held), len(held) + len(text)))
        held += text
        # A turn is complete when a segment closes it; at most one turn's text is held.
        if text.endswith(template.end) and (m := turn.fullmatch(held)):
            name = m[1]
            under = "".join(unescape(held[a:b]) for a, b in masked)
            yield roles[name] if name in roles else unescape(name[1:]), unescape(m[2]), under
            held, masked = "", []
    if held:
        raise ValueError(f"a formatted conversation breaks off: {held[:80]!r}")


SEGMENT = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("violation", pa.string())])
SEGMENT_SQL = "conv_id long, segment long, text string, loss boolean, violation string"
RESULT = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("violation", pa.string())]
)
RESULT_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, violation string"


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[n].to_pylist() for n in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held, characters = [], 0
    for row in rows:
        held.append(row)
        characters += len(row[2] or "")
        if len(held) >= size or characters > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, characters = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, segment, text, loss, violation``: every conversation's segments, in order within a partition.

    Rows stream in the order of conversation and turn (ties by role and text), so a task holds one turn at a time
    however long a conversation is. A turn out of order is formatted like any other and its violation named. Null
    roles and texts are empty, a null conv_id is a conversation of its own, repeated rows are turns, an empty table
    gives no rows, other columns are ignored.
    """
    ship(conversations.sparkSession)
    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for conv_id, turns in groupby(_rows(batches, ("conv_id", "role", "text")), key=lambda r: r[0]):
                for number, (text, loss, wrong) in enumerate(segments(((r, t) for _, r, t in turns), template)):
                    yield conv_id, number, text, loss, wrong

        yield from _batches(out(), SEGMENT, 5000)

    return ordered.mapInArrow(work, SEGMENT_SQL)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation, from its formatted segments alone: counts and digests of turns and loss text.

    ``formatted`` must be as ``format_chats`` gives it. ``violation`` is the first turn out of order, or an end that
    the template doesn't allow.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for conv_id, parts in groupby(_rows(batches, ("conv_id", "text", "loss", "violation")), key=lambda r: r[0]):
                seen = {"chars": 0, "wrong": None}

                def texts():
                    for _, text, loss, wrong in parts:  # noqa: B023
                        seen["chars"] += len(text)  # noqa: B023
                        seen["wrong"] = seen["wrong"] or wrong  # noqa: B023
                        yield text, loss

                turns, masked, n, loss_chars, role = hashlib.sha256(), hashlib.sha256(), 0, 0, ""
                for role, text, under in parse(texts(), template):
                    turns.update(f"{role}\n{text}\n".encode())
                    masked.update(under.encode())
                    n, loss_chars = n + 1, loss_chars + len(under)
                wrong = seen["wrong"] or (None if role in template.last else f"ends with {role or '(none)'}")
                yield conv_id, n, turns.hexdigest(), loss_chars, masked.hexdigest(), seen["chars"], wrong

        yield from _batches(out(), RESULT, 5000)

    return formatted.mapInArrow(work, RESULT_SQL)


@query("op4_chat_formatting")
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return read_back(format_chats(rows))
