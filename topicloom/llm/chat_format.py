"""Chat formatting by grammar round trip.

A turn is rendered as ``### role: text</turn>\\n``. The parser reads a turn up to the next unescaped end mark
and takes a backslash as the escape of the character after it. A turn is first rendered as it is; if
parsing does not give back the same role and text, its conflicting characters are escaped, one step at a
time, until it does. The parser looks at nothing behind a turn's end, so a conversation reads back
as it was when each of its turns does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.scale import ship_with_tasks

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"

# What each step of escaping puts a backslash before.
TEXT_STEPS = ((), ("\\", "</turn>"), ("\\", "<", "#"))
ROLE_STEPS = ((), ("\\", ":", "\n", "<"))

TURN_SCHEMA = "conv_id long, turn long, formatted string, role string, text string, learn boolean"
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _read_until(text: str, at: int, mark: str) -> tuple[str, int]:
    """Unescaped content from ``at`` up to the first unescaped ``mark``, and the place behind the mark."""
    out = []
    while True:
        end, escape = text.find(mark, at), text.find("\\", at)
        if end < 0:
            raise ValueError(f"no {mark!r}")
        if escape < 0 or escape > end:
            out.append(text[at:end])
            return "".join(out), end + len(mark)
        out.append(text[at:escape])
        out.append(text[escape + 1 : escape + 2])
        at = escape + 2


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation; raises ValueError where the grammar does not hold."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        role, at = _read_until(formatted, at + len(OPEN), BETWEEN)
        text, at = _read_until(formatted, at, CLOSE)
        turns.append((role, text))
    return turns


def _escape(value: str, marks: tuple[str, ...]) -> str:
    for mark in marks:  # the backslash comes first
        value = value.replace(mark, "\\" + mark)
    return value


def render_turn(role: str, text: str) -> str:
    """The least escaped form of one turn that the parser reads back unchanged."""
    for role_marks in ROLE_STEPS:
        for text_marks in TEXT_STEPS:
            formatted = f"{OPEN}{_escape(role, role_marks)}{BETWEEN}{_escape(text, text_marks)}{CLOSE}"
            try:
                if parse(formatted) == [(role, text)]:
                    return formatted
            except ValueError:
                pass
    raise ValueError("a turn that cannot be escaped")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        made = [
            render_turn(role or "", text or "") for role, text in zip(rows["role"], rows["text"], strict=True)
        ]
        back = [parse(x)[0] for x in made]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("turn"),
                pa.array(made, pa.string()),
                pa.array([r for r, _ in back], pa.string()),
                pa.array([t for _, t in back], pa.string()),
                pa.array([r == "assistant" for r, _ in back], pa.bool_()),
            ],
            names=["conv_id", "turn", "formatted", "role", "text", "learn"],
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: its formatted text, the role and text read back from it, and whether it is learned.

    Null roles and texts are empty. Other columns are ignored. The formatted conversation is the
    concatenation of its turns by (turn, role, text); rows that agree in all of these are all kept.
    """
    picked = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    return picked.mapInArrow(_turns, TURN_SCHEMA)


class _Digest:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, learn: bool, formatted: str) -> None:
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{role}\n{text}\n".encode())
        if learn:
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
         ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )
    open_one: _Digest | None = None
    for batch in batches:
        done = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learn", "formatted"))
        for conv_id, role, text, learn, formatted in zip(*columns, strict=True):
            if open_one is None or open_one.conv_id != conv_id:
                if open_one is not None:
                    done.append(open_one.row())
                open_one = _Digest(conv_id)
            open_one.add(role, text, learn, formatted)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if open_one is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(open_one.row(), schema, strict=True)], schema=schema)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation with digests of its turns and of the text under the loss mask.

    A digest reads its turns one after the other, so turns are sorted and streamed: a task holds one batch,
    however long a conversation is. Turns without ``conv_id`` form one conversation with a null id.
    """
    ordered = turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_digests, DIGEST_SCHEMA)


ship_with_tasks(__name__)
