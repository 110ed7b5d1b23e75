"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME_BYTES``, cut between code points, with the units,
code points and bytes before each. A unit is a run of ASCII letters or any other single code point. A cut after so many
units is found in the cumulative counts, and only the frame it falls in is decompressed; the output is written by
streaming the frames of its parts in their new order into frames of its own, and digests stream those. No more than
one frame of a text is decompressed at a time, and one document never waits for another: there is no shuffle.

Null text counts as empty, a null doc_id as the empty string where cuts and forms are drawn. Empty texts, and texts
that hold a mark, are plain. Rows of one doc_id and text get the same output; an empty table gives none. Extra columns
play no role, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import textvec

FRAME_BYTES = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, so many are transformed, and so many of those suffix first
TRANSFORMED, SUFFIX_FIRST = 90, 20
_LETTER = ~textvec.separators([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0xFF)])
#: Bytes of compressed frames in one record batch
_BATCH_BYTES = 1 << 22
#: Columns of a stored text; each list of counts has one more entry than ``frames``, the last being the total
STORED = "units array<long>, chars array<long>, bytes array<long>, frames array<binary>"


def _starts(data: np.ndarray, after_letter: bool) -> np.ndarray:
    """Flags of the bytes at which a unit starts."""
    letter = _LETTER[data]
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    if len(data) and after_letter:
        starts[0] &= not letter[0]
    return starts


class Stored:
    """A text as compressed frames, written once in order, then read at any place."""

    def __init__(self, units=(0,), chars=(0,), size=(0,), frames=()) -> None:
        self.units, self.chars, self.bytes, self.frames = list(units), list(chars), list(size), list(frames)
        self._open = (-1, b"")

    @classmethod
    def write(cls, chunks: Iterable[bytes], pack: zstandard.ZstdCompressor) -> Stored:
        out, waiting, letter = cls(), b"", False
        for chunk in chunks:
            waiting = waiting + chunk if waiting else bytes(chunk)
            while len(waiting) > FRAME_BYTES:
                end = FRAME_BYTES
                while waiting[end] & 0xC0 == 0x80:
                    end -= 1
                letter = out._add(waiting[:end], letter, pack)
                waiting = waiting[end:]
        if waiting:
            out._add(waiting, letter, pack)
        return out

    def _add(self, data: bytes, letter: bool, pack: zstandard.ZstdCompressor) -> bool:
        array = np.frombuffer(data, dtype=np.uint8)
        self.units.append(self.units[-1] + int(np.count_nonzero(_starts(array, letter))))
        self.chars.append(self.chars[-1] + int(np.count_nonzero((array & 0xC0) != 0x80)))
        self.bytes.append(self.bytes[-1] + len(data))
        self.frames.append(pack.compress(data))
        return bool(_LETTER[array[-1]])

    def _load(self, i: int) -> bytes:
        if self._open[0] != i:
            self._open = (i, zstandard.ZstdDecompressor().decompress(self.frames[i], max_output_size=self.bytes[i + 1] - self.bytes[i]))
        return self._open[1]

    def cut(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before the unit of that number, or all of them beyond the last."""
        if unit >= self.units[-1]:
            return self.bytes[-1], self.chars[-1]
        i = int(np.searchsorted(self.units, unit, side="right")) - 1  # the last frame with no more before it
        data = np.frombuffer(self._load(i), dtype=np.uint8)
        after = i > 0 and bool(_LETTER[self._load(i - 1)[-1]]) if _LETTER[data[0]] else False
        at = int(np.flatnonzero(_starts(data, after))[unit - self.units[i]])
        return self.bytes[i] + at, self.chars[i] + int(np.count_nonzero((data[:at] & 0xC0) != 0x80))

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes from ``start`` to ``end``, frame after frame."""
        end = self.bytes[-1] if end is None else end
        i = max(0, int(np.searchsorted(self.bytes, start, side="right")) - 1)
        while start < end:
            data, low = self._load(i), self.bytes[i]
            yield data[start - low : end - low]
            start, i = self.bytes[i + 1], i + 1

    def find(self, mark: bytes, start: int = 0) -> int:
        """Place of the first ``mark`` from ``start`` on, or -1; also across frames."""
        tail, at = b"", start
        for chunk in self.stream(start):
            seen = tail + chunk
            found = seen.find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(chunk)
            tail = seen[-(len(mark) - 1) :]
        return -1


def plan(doc_id: int | None, n: int, has_mark: bool) -> tuple[str, int, int]:
    """Form, and the units before the middle and before the suffix."""
    digits = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or has_mark or h3 % 100 >= TRANSFORMED:
        return "plain", low, high
    return ("spm" if h4 % 100 < SUFFIX_FIRST else "psm"), low, high


def rearranged(text: Stored, form: str, low: int, high: int) -> Iterator[bytes]:
    """The output of a text in pieces, for cuts at the bytes ``low`` and ``high``."""
    if form == "plain":
        yield from text.stream()
        return
    prefix, suffix = (PREFIX, 0, low), (SUFFIX, high, None)
    for mark, start, end in (*((suffix, prefix) if form == "spm" else (prefix, suffix)), (MIDDLE, low, high)):
        yield mark
        yield from text.stream(start, end)


def restored(output: Stored, form: str) -> Iterator[bytes]:
    """The text that an output of that form was made of, in pieces."""
    if form == "plain":
        yield from output.stream()
        return
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    there = output.find(second, len(first))
    middle = output.find(MIDDLE, there + len(second))
    spans = {first: (len(first), there), second: (there + len(second), middle)}
    yield from output.stream(*spans[PREFIX])
    yield from output.stream(middle + len(MIDDLE))
    yield from output.stream(*spans[SUFFIX])


class _Batch:
    """Rows of stored texts on their way to a record batch of bounded size."""

    def __init__(self, names: list[str], types: list[pa.DataType]) -> None:
        self.schema = pa.schema([*zip(names, types), *((n, pa.list_(pa.int64())) for n in ("units", "chars", "bytes")), ("frames", pa.list_(pa.binary()))])
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, text: Stored) -> bool:
        self.rows.append((*row, text.units, text.chars, text.bytes, text.frames))
        self.size += sum(map(len, text.frames)) + 64
        return self.size >= _BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in self.schema]
        out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def _stored(batch: pa.RecordBatch) -> Iterator[Stored]:
    columns = [batch.column(batch.schema.get_field_index(n)) for n in ("units", "chars", "bytes", "frames")]
    for i in range(batch.num_rows):
        yield Stored(*(c[i].as_py() for c in columns))


def stored(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, has_mark) and the columns of ``STORED`` for each row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        out = _Batch(["doc_id", "has_mark"], [pa.int64(), pa.bool_()])
        for rows, texts in textvec.pieces(batches, "text"):
            for doc_id, text in zip(rows.column(0).to_pylist(), texts):
                data = bytes(text)
                row = doc_id, any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE))
                if out.add(row, Stored.write([data], pack)):
                    yield out.take()
        yield out.take()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, f"doc_id long, has_mark boolean, {STORED}")


def filled(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars) of ``stored`` texts, with the stored output of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        out = _Batch(["doc_id", "n", "form", "prefix_chars", "middle_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, has_mark, text in zip(ids, marks, _stored(batch)):
                n = text.units[-1]
                form, low, high = plan(doc_id, n, has_mark)
                if form == "plain":
                    full = out.add((doc_id, n, form, None, None), text)
                else:
                    (at, prefix), (to, both) = text.cut(low), text.cut(high)
                    full = out.add((doc_id, n, form, prefix, both - prefix), Stored.write(rearranged(text, form, at, to), pack))
                if full:
                    yield out.take()
        yield out.take()

    return texts.mapInArrow(run, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {STORED}")


def output_texts(outputs: DataFrame) -> DataFrame:
    """Rows (doc_id, form, output): the whole text of each of the ``filled`` outputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(_stored(batch)):
                row = batch.slice(i, 1)
                whole = pa.array([b"".join(text.stream()).decode("utf-8", "replace")])
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), whole], ["doc_id", "form", "output"])

    return outputs.select("doc_id", "form", "units", "chars", "bytes", "frames").mapInArrow(run, "doc_id long, form string, output string")


def digests(outputs: DataFrame) -> DataFrame:
    """Rows of ``filled`` outputs with the digests of the output and of the text rebuilt from it, in place of the frames."""
    carried = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def digest(chunks: Iterable[bytes]) -> str:
        state = hashlib.sha256()
        for chunk in chunks:
            state.update(chunk)
        return state.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(2).to_pylist()
            found = [(digest(t.stream()), digest(restored(t, form))) for form, t in zip(forms, _stored(batch))]
            made = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], [*carried, "output_sha256", "restored_sha256"])

    return outputs.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
