"""Chat formatting: a state machine over roles, a declarative template, loss flags by segment."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm._common import NULL_ID, pick, prepare, tasks


@dataclass(frozen=True)
class Template:
    """How turns are written and which orders of roles are valid.

    turn_open, role_end and turn_close mark a turn: open, role, role_end, text,
    close. Inside roles and texts every control string gets an escape character
    after its first character, and the escape character itself is doubled; a
    control string may hold one of openers, as its first character only.
    loss_roles: whose texts are under the loss mask, markers never are.
    order: for each state (the last role, or "" at the start), the roles that
    may follow; final: the states in which a conversation may end.
    """

    turn_open: str = "<|turn|>"
    role_end: str = "<|text|>"
    turn_close: str = "<|end|>"
    controls: tuple[str, ...] = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    openers: str = "<["
    escape_char: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for c in self.controls:
            # "<<SYS>>" has two openers in a row: broken after the first, its rest is no control string
            if len(c) < 2 or c[0] not in self.openers or self.escape_char in c or any(c != d and c[1:].startswith(d) for d in self.controls):
                raise ValueError(f"{c!r} can't be escaped: it must begin with one of {self.openers!r}")
        for m in (self.turn_open, self.role_end, self.turn_close):
            if m not in self.controls:
                raise ValueError(f"{m!r} marks turns but isn't a control string")

    def escape(self, text: str) -> str:
        e = self.escape_char
        text = text.replace(e, e + e)
        if not any(o in text for o in self.openers):
            return text
        return self._controls().sub(lambda m: m.group()[0] + e + m.group()[1:], text)

    def unescape(self, text: str) -> str:
        e = re.escape(self.escape_char)
        return re.sub(f"{e}(.)", r"\1", text, flags=re.S) if self.escape_char in text else text

    def _controls(self) -> re.Pattern:
        return re.compile("|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True)))

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn's segments: marks and role, text, closing mark, each with its loss flag."""
        return [(self.turn_open + self.escape(role) + self.role_end, False), (self.escape(text), role in self.loss_roles), (self.turn_close, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns (role, text) of formatted text: the inverse of turn()."""
        out, at = [], 0
        while at < len(formatted):
            if not formatted.startswith(self.turn_open, at):
                raise ValueError(f"no turn starts at {at}")
            mid = formatted.index(self.role_end, at)
            end = formatted.index(self.turn_close, mid)
            out.append((self.unescape(formatted[at + len(self.turn_open) : mid]), self.unescape(formatted[mid + len(self.role_end) : end])))
            at = end + len(self.turn_close)
        return out


class Order:
    """The state machine over the roles of one conversation."""

    def __init__(self, template: Template):
        self.template, self.state, self.error = template, "", None

    def take(self, turn: int | None, role: str) -> None:
        if self.error is None:
            if role not in self.template.order.get(self.state, ()):
                self.error = f"turn {turn}: {role or 'no role'} after {self.state or 'the start'}"
            self.state = role

    def end(self) -> str | None:
        if self.error is None and self.state not in self.template.final:
            return f"it ends after {self.state or 'the start'}"
        return self.error


SEGMENTS = "conv_id long, turn long, role string, segment string, loss boolean, error string, last boolean"


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """The segments of all conversations, in order within each partition.

    Rows of (conv_id, turn, role, text) become rows of (conv_id, turn, role,
    segment, loss, error, last): three segments a turn, whose concatenation is
    the formatted conversation, and a last row with an empty segment, last
    true, and in error what the state machine finds wrong with the order of
    roles (null: valid). Conversations with an invalid order are formatted too.

    Turns are ordered by turn (null first), then role and text; rows that
    repeat are turns of their own. A null text or role counts as empty. Rows
    without a conv_id form one conversation, without one too. Extra columns
    are ignored. No rows give no rows.

    A conversation's rows stream through one task in order, since order and
    digests are sequential; nothing of it is held but the state, so memory
    does not grow with its length. Shuffles each row once.
    """
    spark = prepare(conversations.sparkSession)
    template = template or Template()
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = batches  # no conversation
        order, turn, role = Order(template), None, ""
        for batch in batches:
            out: list[tuple] = []
            for conv, turn_, role_, text in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if conv != now:
                    if now is not batches:
                        out.append((now, turn, role, "", False, order.end(), True))
                    now, order = conv, Order(template)
                turn, role = turn_, role_ or ""
                order.take(turn, role)
                out += [(conv, turn, role, s, loss, None, False) for s, loss in template.turn(role, text or "")]
            yield _batch(out)
        if now is not batches:
            yield _batch([(now, turn, role, "", False, order.end(), True)])

    return rows.repartition(tasks(spark), F.coalesce("conv_id", F.lit(NULL_ID))).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_())
    names = ("conv_id", "turn", "role", "segment", "loss", "error", "last")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def digest_chats(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation that format_chats() gave, read back from its segments.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (of all text under the loss mask, unescaped),
    formatted_chars, valid, error. Must follow format_chats() directly: it
    needs the order within partitions and adds no shuffle.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda: ([], hashlib.sha256(), hashlib.sha256(), [0, 0, 0])
        written, turns, loss, n = new()
        for batch in batches:
            out = []
            for conv, segment, lossy, error, last in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)), strict=True):
                written.append(segment)
                n[2] += len(segment)
                if lossy:
                    text = template.unescape(segment)
                    n[1] += len(text)
                    loss.update(text.encode("utf-8"))
                if segment == template.turn_close:
                    for role, text in template.read("".join(written)):
                        n[0] += 1
                        turns.update(f"{role}\n{text}\n".encode())
                    written = []
                if last:
                    out.append((conv, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], error is None, error))
                    written, turns, loss, n = new()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, error string")
