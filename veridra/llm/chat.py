"""Chat formatting: turns become marked text with loss flags, by a template, and the marked text can be read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import release

_OTHER = "*"
_SEGMENTS = "conv_id long, turn long, role string, position long, start long, text string, loss boolean, in_order boolean"
#: characters of segments that a batch holds before it is sent on
BATCH = 4_000_000


@dataclass(frozen=True)
class Marks:
    """What stands before and after a role's texts, and which of the three parts the model is trained on."""

    head: str
    tail: str
    loss: bool = False
    loss_tail: bool = False


@dataclass(frozen=True)
class Template:
    """A declarative chat template. `roles` gives the marks of the known roles; any other role is written in `named` marks with its name
    before the text. `order` is the machine: state -> {role: next state}, from the state `begin`; a role that the state does not name breaks the
    order, from that turn to the conversation's end. Marks are control strings: <...> or [...] without brackets inside, all different, so that no
    two of them overlap and none is cut by text beside it."""

    roles: dict[str, Marks]
    named: tuple[str, str, str]
    order: dict[str, dict[str, str]]
    begin: str = "begin"
    marks: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        marks = tuple(m for r in self.roles.values() for m in (r.head, r.tail)) + self.named
        bad = [m for m in marks if not re.fullmatch(r"<[^<>\[\]\\]+>|\[[^<>\[\]\\]+\]", m)]
        if bad or len(set(marks)) < len(marks):
            raise ValueError(f"marks must be different strings in <> or [] without brackets or backslashes inside: {bad or marks}")
        states = {self.begin, *(t for to in self.order.values() for t in to.values())}
        if missing := states - set(self.order):
            raise ValueError(f"states without an entry in order: {sorted(missing)}")
        object.__setattr__(self, "marks", marks)

    @cached_property
    def _escape(self) -> re.Pattern:
        return re.compile("|".join(f"{re.escape(m[0])}(?=\\\\*{re.escape(m[1:])})" for m in self.marks))

    @cached_property
    def _unescape(self) -> re.Pattern:
        return re.compile("|".join(f"(?<={re.escape(m[0])})\\\\(?=\\\\*{re.escape(m[1:])})" for m in self.marks))

    @cached_property
    def control(self) -> re.Pattern:
        return re.compile("|".join(re.escape(m) for m in sorted(self.marks, key=len, reverse=True)))

    def escape(self, text: str) -> str:
        """No control string is left: each gets a backslash after its bracket; those with backslashes there get one more."""
        return self._escape.sub(lambda m: m.group() + "\\", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub("", text)

    def step(self, state: str | None, role: str | None) -> str | None:
        """The state after a turn; None once the order is broken."""
        return None if state is None else self.order[state].get(role)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn's pieces of output, each with its loss flag."""
        known = self.roles.get(role)
        if known is None:
            head, middle, tail = self.named
            return [(head + self.escape(role) + middle, False), (self.escape(text), False), (tail, False)]
        return [(known.head, False), (self.escape(text), known.loss), (known.tail, known.loss_tail)]


#: a system turn may come first, then user and assistant take turns; the assistant's texts are learned
INSTRUCT = Template(
    roles={"system": Marks("[SYS]", "[/SYS]"), "user": Marks("[INST]", "[/INST]"), "assistant": Marks("<s>", "</s>", loss=True)},
    named=("[ROLE]", "[/ROLE]", "[/TURN]"),
    order={
        "begin": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
)


def _sorted_turns(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def chat_segments(conversations: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations as text segments: (conv_id, turn, role, position, start, text, loss, in_order), conversation after conversation in the
    order of `position`. A conversation's formatted text is its segments joined; `start` is the segment's first character in it; `loss` says
    whether a model learns the segment. `in_order` is true as long as the turns follow the template's machine.

    Every row becomes a turn, whatever the order; leave out conversations with a false `in_order` to train on clean ones. Turns ascend by
    `turn`, nulls first, rows of one turn by role and text. Null texts and roles are empty; an empty role breaks the order like any unknown one. Rows
    with a null conversation id make one conversation. An empty table gives no rows; other columns are not looked at.

    Rows are shuffled once, by conversation, and sorted there; a task reads them as a stream and holds one batch of segments, so the length of
    a conversation (or a conversation with a third of all rows) costs time and no memory. Its turns stay in one task because the machine
    and the readers' digests run through them in order.
    """
    names = [f.split()[0] for f in _SEGMENTS.split(", ")]
    schema = pa.schema([pa.field(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]]) for n, f in zip(names, _SEGMENTS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state, position, start = None, 0, 0
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for conv_id, number, who, said in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (conv_id,):
                    now, state, position, start = (conv_id,), template.begin, 0, 0
                state = template.step(state, who)
                for piece, loss in template.segments(who, said):
                    out.append((conv_id, number, who, position, start, piece, loss, state is not None))
                    position, start, size = position + 1, start + len(piece), size + len(piece) + 50
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        release()

    filled = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text")))
    rows = conversations.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), *filled)
    return _sorted_turns(rows).mapInArrow(run, _SEGMENTS)


class Reader:
    """Reads formatted text back, piece by piece: turns as (role, text), and what lies under the loss mask. It sees the joined text and the
    mask only. What is held is one turn's text."""

    def __init__(self, template: Template):
        self.template = template
        self.heads = {m.head: (r, m.tail) for r, m in template.roles.items()}
        self.rest: list[str] = []
        self.role: str | None = None
        self.until: str | None = None
        self.chars = self.turns = self.loss_chars = 0
        self.digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()
        self.masked: list[str] = []

    def feed(self, text: str, loss: bool) -> None:
        """The next piece of the formatted text. Pieces may end anywhere but inside a control string."""
        self.chars += len(text)
        if loss:
            self.masked.append(text)
        else:
            self.unmask()
        at = 0
        for m in self.template.control.finditer(text):
            self.rest.append(text[at : m.start()])
            at = m.end()
            self.meet(m.group())
        self.rest.append(text[at:])

    def unmask(self) -> None:
        """A stretch of the loss mask has ended."""
        if self.masked:
            text = self.template.unescape("".join(self.masked))
            self.masked = []
            self.loss_chars += len(text)
            self.loss_digest.update(text.encode("utf-8", "surrogatepass"))

    def meet(self, control: str) -> None:
        """A control string and the text before it."""
        before, self.rest = "".join(self.rest), []
        head, middle, tail = self.template.named
        if self.until is None and control in self.heads and not before:
            self.role, self.until = self.heads[control]
        elif self.until is None and control == head and not before:
            self.until = middle
        elif self.until == middle and control == middle:
            self.role, self.until = self.template.unescape(before), tail
        elif self.until == control:
            self.turns += 1
            self.digest.update(f"{self.role}\n{self.template.unescape(before)}\n".encode("utf-8", "surrogatepass"))
            self.until = None
        else:
            raise ValueError(f"{control!r} after {before[-40:]!r} does not fit the template")

    def end(self) -> tuple[int, str, int, str, int]:
        self.unmask()
        if self.until is not None or any(self.rest):
            raise ValueError("the formatted text ends inside a turn")
        return self.turns, self.digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest(), self.chars


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What a reader of the formatted text finds, one row per conversation: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_in_order). Roles and texts come from the marks, the learned text from the loss flags. `segments` is what `chat_segments` returns, or the same read
    again from a file and dealt by conversation and sorted by position: one conversation's segments follow each other in one task.
    `n_in_order` counts the turns before the order breaks."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_in_order long"
    names = [f.split()[0] for f in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        reader, good = Reader(template), 0
        done: list[tuple] = []
        rows = lambda: pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], schema)
        for batch in batches:
            for conv_id, position, text, loss, in_order in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (conv_id,):
                    if now is not None:
                        done.append((*now, *reader.end(), good))
                    now, reader, good = (conv_id,), Reader(template), 0
                turns = reader.turns
                reader.feed(text, loss)
                good += in_order * (reader.turns - turns)
            if len(done) > 5_000:
                yield rows()
                done = []
        if now is not None:
            done.append((*now, *reader.end(), good))
        if done:
            yield rows()
        release()

    schema = pa.schema([pa.field(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    return segments.select("conv_id", "position", "text", "loss", "in_order").mapInArrow(run, kinds)


def chat_digest(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Format all conversations, and one with control strings for texts (id -1), and read the result back."""
    spark = conversations.sparkSession
    trick = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", trick), (-1, 1, "assistant", trick)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    return read_back(chat_segments(rows, template), template)
