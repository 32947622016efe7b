"""Chat formatting by a declarative template, with loss flags, and reading it back.

A finite-state machine over roles follows the turns of each conversation. Each
turn becomes segments: marks, the role, and the text with its loss flag. In
roles and texts ``<`` and ``|`` never stand together: a backslash goes between them, one
more if there are some already, which reading takes out again; so no text can
hold a mark. Rows stream through sorted partitions, turn by turn, so a
conversation of any length takes the memory of one batch.

Defined cases: null text and null role count as empty; turns follow by turn
(null first), then role and text; a null conversation id is one conversation;
an empty table has no conversations. A conversation that the machine does not
accept is formatted all the same and marked as not valid.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import shuffle_partitions

_TOUCH = re.compile(r"<(\\*)\|")
_APART = re.compile(r"<\\(\\*)\|")
BROKEN = "broken"


def escape(text: str) -> str:
    return _TOUCH.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _APART.sub(r"<\1|", text)


@dataclass(frozen=True)
class Template:
    """What surrounds a turn's role and text, whose texts are learned, and which role may follow which."""

    before_role: str = "<|im_start|>"
    after_role: str = "<|im_sep|>"
    after_text: str = "<|im_end|>\n"
    learned: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def move(self, state: str, role: str) -> str:
        return role if role in self.moves.get(state, ()) else BROKEN

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of a turn with their loss flags."""
        return [(self.before_role + escape(role) + self.after_role, False), (escape(text), role in self.learned),
                (self.after_text, False)]

    def parse(self, formatted: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        start, sep, end = self.before_role, self.after_role, self.after_text
        if not (formatted.startswith(start) and formatted.endswith(end)):
            raise ValueError("not a formatted turn")
        role, found, text = formatted[len(start) : len(formatted) - len(end)].partition(sep)
        if not found or "<|" in role or "<|" in text:
            raise ValueError("not a formatted turn")
        return unescape(role), unescape(text)


SEGMENTS = "conv_id long, turn long, segment int, text string, loss boolean, state string"


def _rows(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      ["conv_id", "turn", "segment", "text", "loss", "state"])


def format_turns(conversations: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """Segments (conv_id, turn counted from 0, segment, text, loss, state of the machine after the turn)."""
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
                                F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition(shuffle_partitions(conversations.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, number = object(), "", 0
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, _, who, said in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if key != current:
                    current, state, number = key, "", 0
                state = template.move(state, who)
                for k, (part, loss) in enumerate(template.turn(who, said)):
                    for c, v in zip(out, (key, number, k, part, loss, state), strict=True):
                        c.append(v)
                number += 1
            yield _rows(out)

    return ordered.mapInArrow(run, SEGMENTS)


READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "valid boolean")


class _Reader:
    """What is known of a conversation after some of its turns."""

    def __init__(self, key):
        self.key, self.turns, self.loss_chars, self.chars, self.state, self.whole = key, 0, 0, 0, "", True
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def turn(self, template: Template, segments: list[tuple[str, bool, str]]) -> None:
        role, text = template.parse("".join(s for s, _, _ in segments))
        self.said.update(f"{role}\n{text}\n".encode())
        for s, loss, _ in segments:
            self.chars += len(s)
            if loss:
                plain = unescape(s)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
        self.turns += 1
        self.state = segments[-1][2]
        self.whole &= self.state != BROKEN

    def row(self, template: Template) -> dict:
        return {"conv_id": self.key, "n_turns": self.turns, "turns_sha256": self.said.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars,
                "valid": self.whole and self.state in template.final}


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, from its formatted turns."""
    ordered = segments.repartition(shuffle_partitions(segments.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", "turn", "segment")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("valid", pa.bool_())])

    def run(batches):
        reader, held, number = None, [], None
        for batch in batches:
            done = []
            for key, turn, _, text, loss, state in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
                if held and (key != reader.key or turn != number):
                    reader.turn(template, held)
                    held = []
                if reader is None or key != reader.key:
                    if reader is not None:
                        done.append(reader.row(template))
                    reader = _Reader(key)
                number = turn
                held.append((text, loss, state))
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if reader is not None:
            reader.turn(template, held)
            yield pa.RecordBatch.from_pylist([reader.row(template)], schema=schema)

    return ordered.mapInArrow(run, READ)
