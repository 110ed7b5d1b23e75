"""Whole texts as numpy arrays: words and their 64-bit hashes straight from Arrow buffers, without Python strings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21
_RUN_BYTES = 1 << 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 64 random bits for each byte, capitals A-Z as their small letters
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def separators(ranges: Iterable[tuple[int, int]]) -> np.ndarray:
    """Truth table over bytes for inclusive ranges of separators (ASCII, so safe within UTF-8)."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


WHITE = separators([(0x20, 0x20), (0x09, 0x0D)])
#: not small letters, digits or bytes of letters beyond ASCII; capitals count as small letters
NOT_WORD = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (finaliser of a multiply-and-shift hash)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, _RUN_BYTES), base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 1 << 22:
            _POWERS[base] = known
    return known[:n]


def strings(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return memoryview(data if data is not None else b""), offsets


def pieces(batches: Iterable[pa.RecordBatch], name: str, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[memoryview]]]:
    """Row ranges of about ``size`` bytes of text (one row at least) and the bytes of each row's text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = strings(batch.column(batch.schema.get_field_index(name)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at), [data[offsets[i] : offsets[i + 1]] for i in range(at, end)]
            at = end


def _runs(is_separator: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut at separators into runs of about a fixed length, so that powers stay short; a giant word stays whole."""
    at, n = 0, len(is_separator)
    while at < n:
        end = min(n, at + _RUN_BYTES)
        if end < n:
            back = np.flatnonzero(is_separator[at + 1 : end])
            if len(back):
                end = at + 1 + int(back[-1])
            else:
                ahead = np.flatnonzero(is_separator[end:])
                end = end + int(ahead[0]) if len(ahead) else n
        yield at, end
        at = end


def joined(texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array with a line feed before, between and after the texts, and where each text begins in it."""
    buffer = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)], dtype=np.int64)
    return buffer, begins


def word_spans(buffer: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Separator flags, starts and ends of the words of a buffer that begins and ends with a separator."""
    flags = table[buffer]
    change = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    return flags, change[0::2], change[1::2]


def words(texts: list[memoryview], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the row it is in, A-Z as a-z; words lie between the separators of ``table``."""
    buffer, begins = joined(texts)
    flags, starts, ends = word_spans(buffer, table)
    hashes = np.empty(len(starts), dtype=np.uint64)
    for low, high in _runs(flags):
        first, last = np.searchsorted(starts, [low, high])
        if first == last:
            continue
        sums = np.empty(high - low + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[buffer[low:high]] * _powers(_BASE, high - low), out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        hashes[first:last] = (sums[b] - sums[a]) * _powers(_INVERSE, high - low)[a]
    return mix(hashes), np.searchsorted(begins, starts, side="right") - 1


_PLACE = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words inside a row; a row of fewer words gives its whole run."""
    counts = np.bincount(rows, minlength=n_rows)
    total = len(hashes)
    if total == 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    padded = np.concatenate([hashes, np.zeros(width, dtype=np.uint64)])
    begin = np.cumsum(counts) - counts
    place = np.arange(total) - begin[rows]
    full = place + width <= counts[rows]
    short = (place == 0) & (counts[rows] < width)
    sums = padded[:total] * _PLACE[0]
    for j in range(1, width):
        sums += padded[j : j + total] * _PLACE[j]
    for i in np.flatnonzero(short):  # what follows belongs to the next row
        n = int(counts[rows[i]])
        run = np.append(hashes[i : i + n], np.uint64(n)) * np.append(_PLACE[:n], _PLACE[width])
        sums[i] = run.sum(dtype=np.uint64)
    keep = full | short
    return mix(sums[keep]), rows[keep]


def distinct_sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ordered by row, with the ``n_rows + 1`` bounds of the rows."""
    hashes, bounds = hashes.copy(), np.searchsorted(rows, np.arange(n_rows + 1))
    for i in range(n_rows):
        hashes[bounds[i] : bounds[i + 1]].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(n_rows + 1))


class Seen:
    """Hashes met so far in a task; forgets all when full, which only lets repeats through again."""

    def __init__(self, most: int = 500_000) -> None:
        self.most, self.known = most, set()

    def fresh(self, values: list[int]) -> np.ndarray:
        out = np.zeros(len(values), dtype=bool)
        for i, value in enumerate(values):
            if value not in self.known:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known.add(value)
                out[i] = True
        return out
