r"""Operator 5, chat formatting by columnar byte assembly.

Template, per turn: ``### ``, the role, a line feed, the text, ``</turn>`` and a line feed. In texts a backslash goes before
each backslash, ``#`` and ``<``, in roles also before a line feed, so no text can hold a mark and dropping the backslashes
gives it back. Output rows are (conv_id, part, more, n_turns, formatted, loss); ``more``: whether another part follows; ``loss`` holds the spans of assistant texts in code
points of the part. A conversation is one row, part 0, up to PART_BYTES; a longer one goes on in further parts, without a gap,
cut between turns, since a row of Spark must fit into memory. The ``formatted`` column is the assembled buffer itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, columns, text_slices, utf8_view

#: Bytes from which a conversation goes on in a further row.
PART_BYTES = 64 << 20
HEAD, CLOSE = np.frombuffer(b"### ", np.uint8), np.frombuffer(b"</turn>\n", np.uint8)
BACKSLASH, HASH, ANGLE, FEED = b"\\#<\n"
IN_TEXT = np.zeros(256, bool)
IN_TEXT[[BACKSLASH, HASH, ANGLE]] = True
IN_ROLE = IN_TEXT.copy()
IN_ROLE[FEED] = True

def _sizes(data: np.ndarray, at: np.ndarray, escapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes get a backslash, and each row's length with them."""
    marked = escapes[data]
    before = np.concatenate([[0], np.cumsum(marked)])
    return marked, np.diff(at) + before[at[1:]] - before[at[:-1]]


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, at: np.ndarray, marked: np.ndarray) -> None:
    """Copy each row's bytes to its place, with the backslashes."""
    if not len(data):
        return
    row = np.repeat(np.arange(len(to)), np.diff(at))
    shift = np.cumsum(marked)
    before = np.concatenate([[0], shift])[at[:-1]]
    place = to[row] + np.arange(len(data)) - at[row] + shift - before[row]
    out[place] = data
    out[place[marked] - 1] = BACKSLASH


def assemble(role: tuple[np.ndarray, np.ndarray], text: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns, each turn's start (and the end), and where its text starts and ends."""
    role_marks, role_size = _sizes(*role, IN_ROLE)
    text_marks, text_size = _sizes(*text, IN_TEXT)
    turn = np.concatenate([[0], np.cumsum(len(HEAD) + role_size + 1 + text_size + len(CLOSE))])
    out = np.empty(turn[-1], np.uint8)
    start = turn[:-1]
    out[start[:, None] + np.arange(len(HEAD))] = HEAD
    _scatter(out, start + len(HEAD), *role, role_marks)
    text_at = start + len(HEAD) + role_size + 1
    out[text_at - 1] = FEED
    _scatter(out, text_at, *text, text_marks)
    text_to = text_at + text_size
    out[text_to[:, None] + np.arange(len(CLOSE))] = CLOSE
    return out, turn, text_at, text_to


def changes(column: pa.Array) -> np.ndarray:
    """Places at which a column of longs has another value, or null, than the one before."""
    value, null = pc.fill_null(column, 0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1


class Held:
    """The conversation that may go on: its bytes so far, turns, characters and spans."""

    def __init__(self, conv: pa.Scalar, part: int) -> None:
        self.conv, self.part, self.more, self.turns, self.chars, self.bytes, self.spans = conv, part, False, 0, 0, [], []

    def add(self, data: np.ndarray, turns: int, spans: np.ndarray, chars: int) -> None:
        self.bytes.append(data)
        self.spans.append(spans + self.chars)
        self.turns, self.chars = self.turns + turns, self.chars + chars


def format_chat(conversations: DataFrame, learn: str = "assistant", part_bytes: int = PART_BYTES) -> DataFrame:
    """(conv_id, part, more, n_turns, formatted, loss) for ``conversations`` (conv_id, turn, role, text).

    Turns go in order of turn (null first), then role, then text, so ties and repeated rows keep a fixed order; a null
    role or text is empty; a null conv_id is a conversation too; an empty table gives no rows; other columns are not
    looked at. A conversation of ``part_bytes`` or more goes on in a further part after the turn that reaches them. Turns
    stream through a task, which holds one part, however long a conversation is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Held | None = None
        for batch in text_slices(batches, "text"):
            out, turn, text_at, text_to = assemble(utf8_view(batch.column("role")), utf8_view(batch.column("text")))
            chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            ids = batch.column("conv_id")
            learned = np.flatnonzero(pc.fill_null(pc.equal(batch.column("role"), learn), False).to_numpy(zero_copy_only=False))
            spans = np.stack([chars[text_at[learned]], chars[text_to[learned]]], axis=1)
            # Rows of this slice: a new one at another conversation, and after a turn that brings a part to its size.
            cuts = changes(ids)
            goes_on = held is not None and ids[0].equals(held.conv)
            size = sum(map(len, held.bytes)) if goes_on else 0
            starts = np.concatenate([[0], cuts]).astype(np.int64)
            if turn[-1] + size >= part_bytes:
                more, begin = [], -size
                at = set(cuts.tolist())
                for i in range(batch.num_rows):
                    begin = turn[i] if i in at else begin
                    if i and i not in at and turn[i] - begin >= part_bytes:
                        more.append(i)
                        begin = turn[i]
                starts = np.sort(np.concatenate([starts, np.array(more, np.int64)]))
            stops = np.append(starts[1:], batch.num_rows)
            fresh = np.isin(starts, np.append(cuts, 0 if not goes_on else -1))
            done: list[Held] = []
            if goes_on and size >= part_bytes:
                held.more = True
                done.append(held)
                held = Held(held.conv, held.part + 1)
            elif held is not None and not goes_on:
                done.append(held)
                held = None
            part, ready = (held.part if held else 0), []
            for k, (lo, hi) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
                part = 0 if fresh[k] else part + (k > 0)
                a, b = np.searchsorted(learned, (lo, hi))
                own = spans[a:b] - chars[turn[lo]]
                if k == 0 and held is not None:
                    held.add(out[: turn[hi]], hi, own, int(chars[turn[hi]]))
                    row = held
                else:
                    row = Held(ids[lo], part)
                    row.add(out[turn[lo] : turn[hi]], hi - lo, own, int(chars[turn[hi]] - chars[turn[lo]]))
                row.more = k + 1 < len(starts) and not fresh[k + 1]
                ready.append(row)
            held = ready.pop()
            if done or ready:
                yield packed([*done, *ready])
        if held is not None:
            yield packed([held])

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return arrow_map(ordered, run, "conv_id long, part int, more boolean, n_turns long, formatted string, loss array<struct<start:long,stop:long>>")


def packed(rows: list[Held]) -> pa.RecordBatch:
    """Rows over one buffer of bytes and one of spans."""
    data = np.concatenate([x for r in rows for x in r.bytes])
    spans = np.concatenate([x for r in rows for x in r.spans])
    at = np.cumsum([0, *(sum(map(len, r.bytes)) for r in rows)])
    ends = np.cumsum([0, *(sum(map(len, r.spans)) for r in rows)]).astype(np.int32)
    text = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    loss = pa.StructArray.from_arrays([pa.array(spans[:, 0], pa.int64()), pa.array(spans[:, 1], pa.int64())], ["start", "stop"])
    return columns(
        conv_id=pa.array([r.conv.as_py() for r in rows], pa.int64()), part=pa.array([r.part for r in rows], pa.int32()), more=pa.array([bool(r.more) for r in rows]), n_turns=pa.array([r.turns for r in rows], pa.int64()),
        formatted=text.cast(pa.string()), loss=pa.ListArray.from_arrays(pa.array(ends), loss),
    )


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted part."""
    data = np.frombuffer(formatted, np.uint8)
    slash = data == BACKSLASH
    begins = slash.copy()
    begins[1:] &= ~slash[:-1]
    at = np.arange(len(data))
    run = at - np.maximum.accumulate(np.where(begins, at, 0))
    drop = slash & (run % 2 == 0)
    literal = np.zeros(len(data), bool)
    literal[1:] = drop[:-1]
    heads = np.flatnonzero((data == HASH) & ~literal)[::3]
    ends = np.flatnonzero((data == ANGLE) & ~literal)
    feeds = np.flatnonzero((data == FEED) & ~literal)
    keep = ~drop
    out = []
    for a, b, f in zip(heads.tolist(), ends.tolist(), feeds[np.searchsorted(feeds, heads)].tolist(), strict=True):
        role, text = slice(a + len(HEAD), f), slice(f + 1, b)
        out.append((data[role][keep[role]].tobytes(), data[text][keep[text]].tobytes()))
    return out


def unescape(text: str) -> str:
    """Text without the escaping backslashes."""
    out, parts = [], iter(text.split("\\"))
    out.append(next(parts))
    for p in parts:
        # An empty part is an escaped backslash: the next part follows it.
        out.append(p if p else "\\" + next(parts, ""))
    return "".join(out)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from ``format_chat``'s rows: turns and loss text of each conversation, as lengths and SHA-256.

    Rows may come in any order; only conversations of several parts are brought together, and stream through a task.
    """
    whole = F.expr("part = 0 and not more")
    several = formatted.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return _digests(formatted.where(whole)).unionByName(_digests(several))


def _digests(formatted: DataFrame) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

        def made(rows: list[dict]) -> pa.RecordBatch:
            plain = [r | {"turns_sha256": r["turns_sha256"].hexdigest(), "loss_sha256": r["loss_sha256"].hexdigest()} for r in rows]
            return pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in plain], pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["part"] == 0:
                    if held:
                        out.append(held)
                    held = {"conv_id": r["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                for role, text in read_turns(r["formatted"].encode()):
                    held["n_turns"] += 1
                    held["turns_sha256"].update(role + b"\n" + text + b"\n")
                for span in r["loss"]:
                    text = unescape(r["formatted"][span["start"] : span["stop"]])
                    held["loss_chars"] += len(text)
                    held["loss_sha256"].update(text.encode())
                held["formatted_chars"] += len(r["formatted"])
            if out:
                yield made(out)
        if held:
            yield made([held])

    return arrow_map(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
