"""Image sizes from the first bytes of PNG and JPEG files: segments are walked by ranges, no pixel is decoded."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A range of a file: (first byte, number of bytes) to at most so many bytes
Read = Callable[[int, int], bytes]

PNG = b"\x89PNG\r\n\x1a\n"
JPEG = b"\xff\xd8"
#: Bytes fetched at once; headers seldom need a second range
RANGE_BYTES = 4096
# JPEG markers that open a frame (and hold its size), and those without a length.
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_BARE = frozenset((0x01, *range(0xD0, 0xD9)))


def image_size(read: Read) -> tuple[int, int] | None:
    """Width and height; nothing if the bytes are of another kind, broken, or end before the size."""
    head = read(0, 8)
    if head == PNG:
        found = _png_size(read)
    elif head[:2] == JPEG:
        found = _jpeg_size(read)
    else:
        return None
    return found if found and min(found) > 0 else None


def _png_size(read: Read) -> tuple[int, int] | None:
    at = len(PNG)
    while len(chunk := read(at, 16)) >= 8:
        length, kind = struct.unpack(">I4s", chunk[:8])
        if kind == b"IHDR":
            return struct.unpack(">II", chunk[8:]) if len(chunk) == 16 else None
        if kind in (b"IDAT", b"IEND"):
            return None
        at += 12 + length
    return None


def _jpeg_size(read: Read) -> tuple[int, int] | None:
    at = len(JPEG)
    while len(segment := read(at, 9)) >= 2 and segment[0] == 0xFF:
        marker = segment[1]
        if marker == 0xFF:  # filling
            at += 1
        elif marker in _BARE:
            at += 2
        elif marker in _FRAMES:
            return struct.unpack(">HH", segment[5:9])[::-1] if len(segment) == 9 else None
        elif marker in (0xD9, 0xDA) or len(segment) < 4:  # the end, or pixels before any frame
            return None
        else:
            at += 2 + max(2, struct.unpack(">H", segment[2:4])[0])
    return None


def _ranges(fetch: Read) -> Read:
    """Small reads out of ranges of ``RANGE_BYTES``; the last range is kept."""
    begin, held = 0, b""

    def read(at: int, n: int) -> bytes:
        nonlocal begin, held
        if not begin <= at or at + n > begin + len(held):
            begin, held = at, fetch(at, max(n, RANGE_BYTES))
        return held[at - begin : at - begin + n]

    return read


def sizes_of(images: DataFrame, source: str) -> DataFrame:
    """``images`` less ``source``, with image_width and image_height (null if there is no readable size).

    ``source`` names a column of whole contents (binary) or of paths (string), of which only ranges are read.
    """
    whole = dict(images.dtypes)[source] == "binary"
    kept = [c for c in images.columns if c != source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_content_size(x) if whole else _file_size(x) for x in batch.column(len(kept)).to_pylist()]
            sizes = [pa.array([f and f[i] for f in found], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *sizes], [*kept, "image_width", "image_height"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*kept).schema.fields)
    return images.select(*kept, source).mapInArrow(run, f"{schema}, image_width int, image_height int")


def _content_size(content: bytes | None) -> tuple[int, int] | None:
    return image_size(lambda at, n: content[at : at + n]) if content else None


def _file_size(path: str) -> tuple[int, int] | None:
    from pyarrow import fs

    try:
        store, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        with store.open_input_file(name) as file:
            return image_size(_ranges(lambda at, n: file.read_at(n, at)))
    except (OSError, pa.ArrowInvalid):
        return None
