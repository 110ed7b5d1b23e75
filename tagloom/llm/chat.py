r"""Chat formatting by columnar byte assembly, with a loss mask, and its reading back.

A turn becomes ``<s>[INST] role [/INST]``, a line feed, its text, ``</s>`` and a line feed. Control strings inside roles and texts get a
backslash after their first character, and one more if they have some there already, so that none is left and one
backslash less restores the text.

Turns are range-partitioned by conversation and turn, so a conversation of any length is spread over partitions. A task
assembles a piece of rows at once: places of escapes cut the contents into segments between the headers; lengths of all
segments, their running sum and from it one index for every byte, and one take copies headers and contents into
the buffer of an Arrow string array. A row of the result is one conversation's share of a piece; its shares in order are the
whole. Reading back digests a conversation where it lies in one task, and hands on the shares of those that touch the
ends of a partition or are long, at most two conversations a partition besides the long ones.

Rows of a conversation stand by turn (null last), then role, then text. Null text and null role count as empty; rows
without conv_id are one conversation with a null id; repeated rows are turns of their own. Only turns whose role is
``assistant`` are under the loss mask. An empty table gives no rows. Extra columns play no role, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import textvec
from tagloom.plans.stages import stage

OPEN, CLOSE_ROLE, CLOSE = b"<s>[INST] ", b" [/INST]\n", b"</s>\n"
TRAINED = "assistant"
#: Bytes of texts assembled at once, and bytes of a conversation kept for a digest in place
PIECE_BYTES, HELD_CHARS = 1 << 20, 1 << 22
_CONTROL = re.compile(rb"<(?=\\*/?s>)|\[(?=\\*/?INST\])")
_ESCAPED = re.compile(r"(<)\\(?=\\*/?s>)|(\[)\\(?=\\*/?INST\])")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.DOTALL)
FORMATTED = "conv_id long, task int, part long, formatted string, loss array<struct<start:long,end:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: bytes) -> bytes:
    return _CONTROL.sub(rb"\g<0>\\", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or m[2], text)


def assemble(texts: list[memoryview], headers: list[bytes], header_of: np.ndarray) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """Formatted turns in one buffer, and the bounds of each turn and of each turn's escaped text in it.

    ``headers`` are different headers, ``header_of`` says which each text has.
    """
    n = len(texts)
    contents, begins = textvec.joined(texts)  # a line feed between texts, so that no control string reaches over two
    ends = begins[1:] - 1
    begins = begins[:-1]
    table = np.frombuffer(b"".join([CLOSE, b"\\", *headers]), dtype=np.uint8)
    header_sizes = np.array([len(h) for h in headers], dtype=np.int64)
    header_starts = len(CLOSE) + 1 + np.cumsum(header_sizes) - header_sizes
    escapes = np.array([m.end() for m in _CONTROL.finditer(contents)], dtype=np.int64)
    owner = np.searchsorted(begins, escapes, side="right") - 1

    # segments of a turn: header, content up to the first escape, backslash, content up to the next, ..., close
    count = 3 + 2 * np.bincount(owner, minlength=n)
    last = np.cumsum(count)
    first = last - count
    starts, lengths = np.empty(int(last[-1]), dtype=np.int64), np.empty(int(last[-1]), dtype=np.int64)
    starts[first], lengths[first] = header_starts[header_of], header_sizes[header_of]
    starts[last - 1], lengths[last - 1] = 0, len(CLOSE)
    nth = np.arange(len(escapes)) - np.searchsorted(owner, owner, side="left")
    marks = first[owner] + 2 + 2 * nth
    starts[marks], lengths[marks] = len(CLOSE), 1
    text_first = first + 1
    shift = len(table)
    starts[text_first] = begins + shift
    starts[marks + 1] = escapes + shift
    stop = np.empty_like(starts)
    stop[last - 2] = ends + shift
    stop[marks - 1] = escapes + shift
    content = np.concatenate([text_first, marks + 1])
    lengths[content] = stop[content] - starts[content]

    after = np.cumsum(lengths)
    total = int(after[-1])
    index = np.arange(total)
    index += np.repeat(starts - (after - lengths), lengths)
    buffer = pa.allocate_buffer(total)
    np.take(np.concatenate([table, contents]), index, out=np.frombuffer(buffer, dtype=np.uint8))
    bounds = np.concatenate([np.zeros(1, dtype=np.int64), after[last - 1]])
    return buffer, bounds, np.stack([after[first], after[last - 2]], axis=1)


def formatted(conversations: DataFrame) -> DataFrame:
    """Rows of ``FORMATTED``: a conversation is its rows by (task, part). ``loss`` holds code points of ``formatted`` under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part = TaskContext.get().partitionId(), 0
        for rows, texts in textvec.pieces(batches, "text", PIECE_BYTES):
            names, header_of = np.unique(np.array(rows.column(1).to_pylist(), dtype=object), return_inverse=True)
            headers = [OPEN + escaped(x.encode()) + CLOSE_ROLE for x in names]
            buffer, bounds, inner = assemble(texts, headers, header_of)
            ids = rows.column(0)
            known, values = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy()
            new = np.ones(rows.num_rows, dtype=bool)
            new[1:] = (values[1:] != values[:-1]) | (known[1:] != known[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], rows.num_rows)
            offsets = np.append(bounds[starts], bounds[-1]).astype(np.int32)
            shares = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), buffer)
            # bytes of the mask as code points from the start of each share
            ahead = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum((np.frombuffer(buffer, dtype=np.uint8) & 0xC0) != 0x80)])
            trained = np.flatnonzero(names[header_of] == TRAINED)
            share_of = np.searchsorted(starts, trained, side="right") - 1
            spans = ahead[inner[trained]] - ahead[bounds[starts[share_of]]][:, None]
            per_share = np.searchsorted(share_of, np.arange(len(starts) + 1)).astype(np.int32)
            masks = pa.ListArray.from_arrays(per_share, pa.StructArray.from_arrays([spans[:, 0], spans[:, 1]], ["start", "end"]))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(starts)), pa.array(np.full(len(starts), task, dtype=np.int32)), pa.array(np.arange(part, part + len(starts))), shares, masks],
                ["conv_id", "task", "part", "formatted", "loss"],
            )
            part += len(starts)

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    turn = F.col("turn").asc_nulls_last()
    # equal turns by role and text; a bounded part of the text decides on the partition
    dealt = turns.repartitionByRange("conv_id", turn, "role", F.substring("text", 1, 64))
    return dealt.sortWithinPartitions("conv_id", turn, "role", F.substring("text", 1, 64), "text").drop("turn").mapInArrow(run, FORMATTED)


class _Reader:
    """Digests of one conversation, read share by share from its formatted text."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def read(self, text: str, spans: list[dict]) -> None:
        for role, body in _TURN.findall(text):
            self.n += 1
            self.turns.update(f"{unescaped(role)}\n{unescaped(body)}\n".encode())
        for span in spans:
            body = unescaped(text[span["start"] : span["end"]])
            self.loss.update(body.encode())
            self.loss_chars += len(body)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_NO_SHARE, _NO_DIGEST = (None,) * 4, (None,) * 5
_SPLIT = pa.schema(
    [("conv_id", pa.int64()), ("task", pa.int32()), ("part", pa.int64()), ("formatted", pa.string())]
    + [("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    + [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _SPLIT]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SPLIT)], schema=_SPLIT)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations that surely lie whole in this task; the shares of all others as they are."""
    now, held, size, rows, waiting = None, [], 0, [], 0
    handing_on = True  # the first conversation may have begun in the task before
    for i, share in enumerate(_shares(batches)):
        if i and share[0] != now:
            if not handing_on:
                reader = _Reader()
                for _, _, _, text, spans in held:
                    reader.read(text, spans)
                rows.append((now, *_NO_SHARE, *reader.row()))
            held, size, handing_on = [], 0, False
        now = share[0]
        held.append(share)
        size += len(share[3])
        if handing_on or size > HELD_CHARS:
            handing_on = True
            rows += [(*h, *_NO_DIGEST) for h in held]
            waiting += sum(len(h[3]) for h in held)
            held = []
        if len(rows) >= 1024 or waiting > HELD_CHARS:
            yield _batch(rows)
            rows, waiting = [], 0
    yield _batch(rows + [(*h, *_NO_DIGEST) for h in held])  # the last may go on in the next task


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose shares come one after another, read one share at a time."""
    now, reader, rows = None, None, []
    for share in _shares(batches):
        if reader is None or share[0] != now:
            if reader:
                rows.append((now, *_NO_SHARE, *reader.row()))
            now, reader = share[0], _Reader()
            if len(rows) >= 1024:
                yield _batch(rows)
                rows = []
        reader.read(share[3], share[4])
    if reader:
        rows.append((now, *_NO_SHARE, *reader.row()))
    yield _batch(rows)


def read_back(shares: DataFrame) -> DataFrame:
    """Rows of ``DIGESTS`` for each conversation of ``formatted`` shares, taken from their texts and masks alone.

    A digest of a whole conversation reads it in order; for one that spans partitions its shares, a few for each
    partition, are streamed through one task, one at a time.
    """
    split = stage(shares.mapInArrow(_in_place, f"{FORMATTED}, {DIGESTS.removeprefix('conv_id long, ')}"), "chats")
    columns = [c.split()[0] for c in DIGESTS.split(", ")]
    open_ = split.where("formatted is not null").repartition("conv_id").sortWithinPartitions("conv_id", "task", "part")
    return split.where("formatted is null").select(columns).union(open_.select("conv_id", "task", "part", "formatted", "loss").mapInArrow(_chained, split.schema).select(columns))
