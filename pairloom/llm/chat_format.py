"""Chat text by columnar byte assembly.

The turns of all conversations are sorted together, and each task formats its rows as
arrays: the lengths of all segments (header, text, escapes, footer) give cumulative
offsets, the offsets give the place of every byte, and headers and texts are copied into
one preallocated Arrow buffer. No string is ever built turn by turn.

A text may contain the template's control strings. Each one gets a backslash after its
first character, and one that already has backslashes there gets one more, so that
reading back takes away exactly one (``unescape``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pairloom.llm import scan

#: Bytes of text from which a conversation is formatted in several parts.
PART_BYTES = 1 << 20
#: Bytes that are placed with one index array.
STEP = 1 << 20
ESCAPE = 0x5C
NAME_PREFIX = 64


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn, by role. A role without an entry is written
    between the first two strings of ``other``, its text between the last two.

    Every mark is a control string that starts with ``<`` or ``[`` and has none of
    ``< [ \\`` behind it, with blanks around it or not; none may contain another.
    """

    turns: Mapping[str, tuple[str, str]] = field(
        default_factory=lambda: {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
    )
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = self.marks
        for m in marks:
            if not re.fullmatch(r" *[<\[][^<\[\\ ]+ *", m):
                raise ValueError(f"not a control string: {m!r}")
        controls = [m.strip(" ") for m in marks]
        for i, a in enumerate(controls):
            if any(a in b for j, b in enumerate(controls) if i != j):
                raise ValueError(f"{a!r} is part of another control string")

    @property
    def marks(self) -> list[str]:
        return [m for pair in self.turns.values() for m in pair] + list(self.other)

    @property
    def rests(self) -> list[tuple[str, str]]:
        """Each control string as its first character and the rest."""
        return [(c[0], c[1:]) for c in (m.strip(" ") for m in self.marks)]

    @cached_property
    def _controls(self) -> re.Pattern:
        return re.compile("|".join(rf"(?<={re.escape(a)})(\\*)(?={re.escape(b)})" for a, b in self.rests))

    @cached_property
    def reader(self) -> re.Pattern:
        return re.compile("|".join(re.escape(m) for m in self.marks))

    def escape(self, text: str) -> str:
        return self._controls.sub(lambda m: m.group(0) + "\\", text)

    def unescape(self, text: str) -> str:
        if "\\" not in text:
            return text
        return self._controls.sub(lambda m: m.group(0)[:-1], text)

    def around(self, role: str) -> tuple[bytes, bytes]:
        if role in self.turns:
            before, after = self.turns[role]
        else:
            before, after = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return before.encode(), after.encode()


def _escapes(data: np.ndarray, at: np.ndarray, template: Template) -> np.ndarray:
    """Places of ``data`` before which a backslash goes: between the first character of a
    control string, with the backslashes that follow it, and its rest."""
    first = np.flatnonzero((data == 0x3C) | (data == 0x5B))
    if not len(first):
        return first
    end = at[np.searchsorted(at, first, side="right")]
    rest = first + 1
    slashed = rest < end
    slashed[slashed] = data[rest[slashed]] == ESCAPE
    if slashed.any():
        other = np.append(np.flatnonzero(data != ESCAPE), len(data))
        rest[slashed] = other[np.searchsorted(other, rest[slashed])]
    hit = np.zeros(len(first), bool)
    for a, b in template.rests:
        want = np.frombuffer(b.encode(), np.uint8)
        fits = np.flatnonzero((data[first] == ord(a)) & (rest + len(want) <= end))
        for k, x in enumerate(want):
            fits = fits[data[rest[fits] + k] == x]
        hit[fits] = True
    return rest[hit]


def _local(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. length - 1 for each length, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _copy_marks(out: np.ndarray, to: np.ndarray, codes: np.ndarray, marks: list[bytes]) -> None:
    """Write mark ``codes[i]`` to place ``to[i]``."""
    size = np.array([len(m) for m in marks], np.int64)
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(marks), np.uint8)
    lengths, local = size[codes], _local(size[codes])
    out[np.repeat(to, lengths) + local] = flat[np.repeat(start[codes], lengths) + local]


def assemble(roles: pa.Array, texts: pa.Array, template: Template) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """All turns formatted in one buffer; the offsets of the turns in it (one more than
    there are turns), and where each turn's text starts and ends."""
    known = roles.fill_null("").dictionary_encode()
    codes = known.indices.to_numpy(zero_copy_only=False)
    around = [template.around(r) for r in known.dictionary.to_pylist()]
    heads, tails = [a for a, _ in around], [b for _, b in around]
    data, at = scan.utf8(texts)
    marks = _escapes(data, at, template)
    head = np.array([len(x) for x in heads], np.int64)[codes]
    tail = np.array([len(x) for x in tails], np.int64)[codes]
    before = np.searchsorted(marks, at)
    body = np.diff(at) + np.diff(before)
    rows = np.concatenate([[0], np.cumsum(head + body + tail)])
    start = rows[:-1] + head

    buffer = pa.allocate_buffer(int(rows[-1]))
    out = np.frombuffer(buffer, np.uint8)
    _copy_marks(out, rows[:-1], codes, heads)
    _copy_marks(out, start + body, codes, tails)
    # A byte moves by its row's place and by the backslashes before it in its row.
    shift = start - at[:-1] - before[:-1]
    own = lambda places: np.searchsorted(at, places, side="right") - 1
    edges = np.union1d(np.union1d(at[:-1], marks), np.arange(0, len(data), STEP))
    edges = edges[edges < len(data)]
    if len(edges):
        move = shift[own(edges)] + np.searchsorted(marks, edges, side="right")
        size = np.diff(np.append(edges, len(data)))
        for lo in range(0, len(data), STEP):
            hi = min(lo + STEP, len(data))
            i, j = np.searchsorted(edges, [lo, hi])
            out[np.arange(lo, hi) + np.repeat(move[i:j], size[i:j])] = data[lo:hi]
        out[marks + shift[own(marks)] + np.arange(len(marks))] = ESCAPE
    return buffer, rows, start, start + body


def _units(conv: pa.Array, at: np.ndarray, part_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the pieces that are formatted together: a conversation, or a part of
    a long one; and whether the piece starts its conversation."""
    n = len(conv)
    new = np.ones(n, bool)
    if n > 1:
        a, b = conv.slice(0, n - 1), conv.slice(1)
        null = (a.is_null().to_numpy(False), b.is_null().to_numpy(False))
        same = pc.equal(a, b).fill_null(False).to_numpy(False) | (null[0] & null[1])
        new[1:] = ~same
    run = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    piece = (at[:-1] - at[run]) // part_bytes
    cut = new.copy()
    cut[1:] |= piece[1:] != piece[:-1]
    first = np.flatnonzero(cut)
    return first, new[first]


def _formatted(table: pa.Table, first: np.ndarray, template: Template) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Text and loss spans of each piece of ``table``; ``first`` ends with the number of rows."""
    roles, texts = (table.column(c).combine_chunks() for c in ("role", "text"))
    buffer, rows, start, end = assemble(roles, texts, template)
    out = np.frombuffer(buffer, np.uint8)
    text = pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(rows[first].astype(np.int32)), buffer)
    inside = np.flatnonzero((out & 0xC0) == 0x80)
    point = lambda places: places - np.searchsorted(inside, places)
    learn = pc.is_in(roles.fill_null(""), value_set=pa.array(template.loss_roles, pa.string())).to_numpy(False)
    learn = np.flatnonzero(learn)
    base = point(rows[first])[np.searchsorted(first, learn, side="right") - 1]
    spans = pa.StructArray.from_arrays([pa.array(point(start[learn]) - base), pa.array(point(end[learn]) - base)], ["start", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(learn, first).astype(np.int32)), spans)
    return text, loss, np.diff(first)


def _parts(batches: Iterator[pa.RecordBatch], template: Template, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the sorted rows of one task. The last piece of a batch waits for the next."""
    part, held, fresh = TaskContext.get().partitionId() << 33, None, False

    def emit(table: pa.Table, first: np.ndarray, new: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal part
        _, at = scan.utf8(table.column("text").combine_chunks())
        for i, j in scan.blocks(at[first]):
            rows = table.slice(first[i], first[j] - first[i])
            text, loss, n_turns = _formatted(rows, first[i : j + 1] - first[i], template)
            conv = table.column("conv_id").combine_chunks().take(pa.array(first[i:j]))
            columns = [conv, pa.array(part + np.arange(j - i)), pa.array(n_turns.astype(np.int64)), text, loss, pa.array((new & ends)[i:j])]
            part += j - i
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "n_turns", "text", "loss", "whole"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        conv = table.column("conv_id").combine_chunks()
        _, at = scan.utf8(table.column("text").combine_chunks())
        first, new = _units(conv, at, part_bytes)
        new[0] = fresh  # the first of a task may have begun in another one, or in a part before
        if len(first) > 1:
            yield from emit(table, first, new[:-1], new[1:])
            fresh = bool(new[-1])
        held = table.slice(first[-1])
    if held is not None:
        yield from emit(held, np.array([0, held.num_rows]), np.array([fresh]), np.array([False]))


def format_conversations(
    df: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Template | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``conv_id, part, n_turns, text, loss, whole``: the formatted conversations.

    Turns are in the order of ``turn`` (null first), equal ones by role and text; repeated
    rows are repeated turns. A null role or text is empty; rows without ``conv_id`` are one
    conversation. Other columns are ignored; an empty table gives no row. ``loss`` has the
    spans (code points of ``text``, end exclusive) to learn from: the escaped texts of
    ``template.loss_roles``.

    All rows are sorted together, so a conversation with a third of all rows spreads over
    many tasks. It comes in parts, as does one above ``part_bytes`` of text, or one that the
    sort has cut: their texts in the order of ``part``, joined, are its text. ``whole`` is
    true where the row is known to hold the whole conversation. A task holds a batch and a
    part at a time.
    """
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # The start of the text orders as the text does and keeps the bounds of the ranges small.
    dealt = rows.repartitionByRange("conv_id", "turn", F.left("role", F.lit(NAME_PREFIX)), F.left("text", F.lit(NAME_PREFIX)))
    turns = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = df.schema[conv_id].dataType.simpleString()
    template = template or Template()
    return turns.mapInArrow(
        lambda batches: _parts(batches, template, part_bytes),
        f"conv_id {kind}, part bigint, n_turns bigint, text string, loss array<struct<start: bigint, end: bigint>>, whole boolean",
    )


def read_turns(text: str, template: Template) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a formatted text."""
    opens = {before: (role, after) for role, (before, after) in template.turns.items()}
    pos = 0

    def mark(expected: str | None = None) -> tuple[str, str]:
        nonlocal pos
        found = template.reader.search(text, pos)
        if not found or (expected is not None and found.group(0) != expected):
            raise ValueError(f"expected {expected or 'the start of a turn'!r} after place {pos}")
        between, pos = text[pos : found.start()], found.end()
        return between, found.group(0)

    while pos < len(text):
        between, before = mark()
        if between:
            raise ValueError(f"text between turns before place {pos}")
        if before in opens:
            role, after = opens[before]
        elif before == template.other[0]:
            role, after = template.unescape(mark(template.other[1])[0]), template.other[2]
        else:
            raise ValueError(f"{before!r} does not start a turn")
        yield role, template.unescape(mark(after)[0])


def _read(batches: Iterator[pa.RecordBatch], template: Template, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation; its parts come one after the other."""
    now, state = None, None

    def row():
        return [now, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]]

    for batch in batches:
        done = []
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
            if state is None or conv != now:
                if state is not None:
                    done.append(row())
                now, state = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
            for role, said in read_turns(text, template):
                state["n"] += 1
                state["turns"].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = template.unescape(text[span["start"] : span["end"]])
                state["chars"] += len(said)
                state["loss"].update(said.encode())
            state["formatted"] += len(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), schema, strict=True)], schema=schema)


def read_back(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted conversations say, read from text and loss spans alone:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Parts are read one at a time, so a long conversation needs no memory; its digests are
    one after the other by nature. Only rows that are not ``whole`` move.
    """
    template = template or Template()
    key = parts.schema["conv_id"].dataType
    kind = f"conv_id {key.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    read = lambda df: df.select("conv_id", "text", "loss").mapInArrow(lambda b: _read(b, template, schema), kind)
    cut = parts.filter(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return read(parts.filter("whole")).unionByName(read(cut))
