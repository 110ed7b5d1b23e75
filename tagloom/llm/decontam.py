"""Benchmark decontamination by suffix arrays of the training text.

Documents are dealt into shards; each shard's words form one suffix array, sorted by prefix doubling, and every suffix
of the test items is binary-searched in it. Neighbours of the place found give the longest verbatim match and where it
lies; where that is at least a window of ``WINDOW`` words long, the range of suffixes around it that begin with the window
gives all its occurrences. Documents are never shuffled. Runs of words shorter than any window, or with words no item has, are left out of the array: no suffix
of them can match. The test items come in blocks of bounded size, one pass over the documents for each block.

Null text has no words; a document or item without words is never hit, nor hits. An item of fewer words than a window
is one window. Repeated rows count each for itself, and so do items: two rows of one item_id are two items, and both ids are listed; a null id is listed as the empty string. An empty benchmark leaves all documents clean. Extra
columns are kept by ``clean_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import textvec

WINDOW = 10
#: Bytes of item text in a block: what is collected and sent to every worker at once
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCHES = "item_id string, item_row long, item_word int, length int, doc_id long, doc_word int"


@dataclass
class Block:
    """Words of some test items as numbers from 1, each item followed by a 0."""

    ids: list[str]
    rows: list[int]
    vocabulary: np.ndarray
    words: np.ndarray
    begins: np.ndarray
    starts: np.ndarray  # of each different window
    lengths: np.ndarray
    owners: list[np.ndarray]  # items that have the window
    heads: np.ndarray  # every place at which a whole window of an item starts
    window_of: np.ndarray  # and which window that is

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 1


def block_of(items: list[tuple[int, str | None, str | None]], window: int = WINDOW) -> Block:
    texts = [memoryview((text or "").encode()) for _, _, text in items]
    hashes, rows = textvec.words(texts, textvec.NOT_WORD)
    vocabulary = np.unique(hashes)
    counts = np.bincount(rows, minlength=len(items))
    begins = np.cumsum(counts + 1) - counts - 1
    words = np.zeros(len(hashes) + len(items) + 1, dtype=np.int64)
    words[np.arange(len(hashes)) + rows] = np.searchsorted(vocabulary, hashes) + 1
    owners: dict[tuple, set[int]] = {}
    for item, (begin, count) in enumerate(zip(begins.tolist(), counts.tolist(), strict=True)):
        length = min(window, count)
        for at in range(begin, begin + count - length + 1) if count else ():
            owners.setdefault(tuple(words[at : at + length].tolist()), set()).add((item, at))
    starts = [min(at for _, at in found) for found in owners.values()]
    heads = sorted((at, window) for window, found in enumerate(owners.values()) for _, at in found)
    return Block(
        [x[1] if x[1] is not None else "" for x in items],
        [x[0] for x in items],
        vocabulary,
        words,
        begins,
        np.array(starts, dtype=np.int64),
        np.array([len(k) for k in owners], dtype=np.int64),
        [np.unique([item for item, _ in found]) for found in owners.values()],
        np.array([at for at, _ in heads], dtype=np.int64),
        np.array([window for _, window in heads], dtype=np.int64),
    )


class Shard:
    """Suffix array over the parts of a shard's texts in which an item's window could lie."""

    def __init__(self, texts: list[memoryview], block: Block) -> None:
        hashes, self.rows = textvec.words(texts, textvec.NOT_WORD)
        self.n_rows = len(texts)
        self.counts = np.bincount(self.rows, minlength=self.n_rows)
        known = np.zeros(len(hashes), dtype=np.int64)
        if len(block.vocabulary) and len(hashes):
            at = np.searchsorted(block.vocabulary, hashes)
            at[at == len(block.vocabulary)] = 0
            known = np.where(block.vocabulary[at] == hashes, at + 1, 0)
        linked = (known > 0) & np.concatenate([[False], (known[:-1] > 0) & (self.rows[1:] == self.rows[:-1])])[: len(known)]
        first = np.flatnonzero((known > 0) & ~linked)
        run = np.cumsum((known > 0) & ~linked) - 1
        length = np.bincount(run[known > 0], minlength=len(first)) if len(first) else np.empty(0, dtype=np.int64)
        use = length >= block.shortest
        #: places of the kept words in the shard; runs are parted by a 0 whose place is -1
        kept = np.flatnonzero((known > 0) & use[run]) if len(first) else np.empty(0, dtype=np.int64)
        new = np.concatenate([[0], np.cumsum(run[kept][1:] != run[kept][:-1])]) if len(kept) else kept
        self.words = np.zeros((len(kept) + int(new[-1]) + 2) if len(kept) else 1, dtype=np.int64)
        self.places = np.full(len(self.words), -1, dtype=np.int64)
        self.words[np.arange(len(kept)) + new] = known[kept]
        self.places[np.arange(len(kept)) + new] = kept
        self.order = self._sorted(int(np.diff(np.append(block.begins, len(block.words))).max()) if len(block.begins) else 1)

    def _sorted(self, depth: int) -> np.ndarray:
        """Suffixes in order of their first ``depth`` words, by doubling the number of words that ranks stand for."""
        rank, step = np.unique(self.words, return_inverse=True)[1], 1
        while step < depth and len(rank) > 1:
            following = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), dtype=np.int64)])
            again = np.unique(rank * (len(rank) + 2) + following, return_inverse=True)[1]
            if again.max() == len(rank) - 1:
                rank = again
                break
            rank, step = again, step * 2
        return np.argsort(rank, kind="stable")

    def search(self, block: Block, starts: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
        """Place in the array of the first suffix not below (``after``: beyond all that begin with) each pattern."""
        low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(self.order), dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            sign = self._compare(block, starts[open_], lengths[open_], self.order[middle])
            right = sign >= 0 if after else sign > 0
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
        return low

    def _compare(self, block: Block, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
        """1 if the pattern is above the suffix at ``at``, -1 if below, 0 if the suffix begins with it."""
        sign, todo, step = np.zeros(len(starts), dtype=np.int64), np.arange(len(starts)), 0
        while (todo := todo[step < lengths[todo]]).size:
            ours = block.words[starts[todo] + step]
            theirs = self.words[np.minimum(at[todo] + step, len(self.words) - 1)]
            theirs = np.where(at[todo] + step < len(self.words), theirs, -1)
            sign[todo] = np.sign(ours - theirs)
            todo, step = todo[ours == theirs], step + 1
        return sign

    def common(self, block: Block, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words that pattern and suffix have in common from their beginnings, up to the item's end."""
        length, todo, step = np.zeros(len(starts), dtype=np.int64), np.arange(len(starts)), 0
        while todo.size:
            ours = block.words[starts[todo] + step]
            inside = at[todo] + step < len(self.words)
            same = inside & (ours > 0) & (ours == self.words[np.minimum(at[todo] + step, len(self.words) - 1)])
            todo, step = todo[same], step + 1
            length[todo] = step
        return length

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Flags of the shard's words that lie in an occurrence, and the distinct (row, item) of all occurrences."""
        flags = np.zeros(len(self.rows) + 1, dtype=np.int64)
        if len(self.order) <= 1 or not len(block.starts):
            return flags[:-1] > 0, np.empty((0, 2), dtype=np.int64)
        _, longest = self.matches(block, block.heads)
        windows = np.unique(block.window_of[longest >= block.lengths[block.window_of]])
        low = self.search(block, block.starts[windows], block.lengths[windows], after=False)
        high = self.search(block, block.starts[windows], block.lengths[windows], after=True)
        pairs = []
        for window, first, last in zip(windows.tolist(), low.tolist(), high.tolist()):
            places = self.places[self.order[first:last]]
            np.add.at(flags, places, 1)
            np.add.at(flags, places + block.lengths[window], -1)
            rows, items = np.unique(self.rows[places]), block.owners[window]
            pairs.append(np.column_stack([np.repeat(rows, len(items)), np.tile(items, len(rows))]))
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), dtype=np.int64)
        return np.cumsum(flags[:-1]) > 0, found

    def matches(self, block: Block, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the kept words the longest match of each test suffix begins, and its length up to the item's end."""
        ends = np.flatnonzero(block.words == 0)
        at = self.search(block, suffixes, ends[np.searchsorted(ends, suffixes)] - suffixes, after=False)
        below, above = self.order[np.maximum(at - 1, 0)], self.order[np.minimum(at, len(self.order) - 1)]
        n_below, n_above = self.common(block, suffixes, below), self.common(block, suffixes, above)
        return np.where(n_above >= n_below, above, below), np.maximum(n_above, n_below)

    def longest(self, block: Block) -> Iterator[tuple[int, int, int, int]]:
        """(place in the block, length, row, word in the row) of every test suffix's longest match."""
        suffixes = np.flatnonzero(block.words > 0)
        if len(self.order) <= 1 or not len(suffixes):
            return
        where, length = self.matches(block, suffixes)
        begins = np.cumsum(self.counts) - self.counts
        for i in np.flatnonzero(length > 0):
            place = self.places[where[i]]
            row = self.rows[place]
            yield int(suffixes[i]), int(length[i]), int(row), int(place - begins[row])


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark (item_id, text) in blocks of about ``block_bytes``; one item is never parted."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").withColumn("row", F.xxhash64("item_id", "text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod("row", F.lit(n)) == i)
        found = [(r["row"], r["item_id"], r["text"]) for r in part.collect()]
        yield block_of(sorted(found, key=lambda x: (x[1] or "", x[0])))


def _report_pass(block: Block, last: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in textvec.pieces(batches, "text", SHARD_BYTES):
            shard = Shard(texts, block)
            flags, found = shard.hits(block)
            bounds = np.concatenate([[0], np.cumsum(shard.counts)])
            spans, items = rows.column(2).to_pylist(), rows.column(3).to_pylist()
            for row in np.unique(shard.rows[flags]).tolist() if len(shard.rows) else ():
                spans[row] = spans[row] + np.flatnonzero(flags[bounds[row] : bounds[row + 1]]).tolist()
            for row, item in found.tolist():
                items[row].append(block.ids[item])
            if not last:
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "text", "spans", "items"],
                )
                continue
            n_hit = [len(set(x)) if x else 0 for x in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(shard.counts.astype(np.int64)),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
                    pa.array([n > 0 for n in n_hit], pa.bool_()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit (words inside an occurrence), n_items and hash of the items found, contaminated."""
    state = "doc_id long, text string, spans array<long>, items array<string>"
    out = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items")
    )
    before = None
    for block in blocks(benchmark, block_bytes):
        if before is not None:
            out = out.mapInArrow(_report_pass(before, last=False), state)
        before = block
    return out.mapInArrow(_report_pass(before, last=True), REPORT)


def clean_documents(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents`` in which no window of the benchmark occurs, with all their columns."""

    def keep(block: Block) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, texts in textvec.pieces(batches, "text", SHARD_BYTES):
                shard = Shard(texts, block)
                hit = np.zeros(len(texts), dtype=bool)
                hit[shard.hits(block)[1][:, 0]] = True
                yield rows.filter(pa.array(~hit))

        return run

    for block in blocks(benchmark, block_bytes):
        documents = documents.mapInArrow(keep(block), documents.schema)
    return documents


def longest_matches(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every word of every item, the longest run of words from there that some document has (at least the shortest
    window of its block), and one place of it, the first by doc_id. Item words without one are left out."""

    def find(block: Block) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for rows, texts in textvec.pieces(batches, "text", SHARD_BYTES):
                ids = rows.column(0).to_pylist()
                for place, length, row, word in Shard(texts, block).longest(block):
                    new = (length, -(ids[row] if ids[row] is not None else 2**62), -word)
                    if length >= block.shortest and new > best.get(place, (0,)):
                        best[place] = new
            out = []
            for place, (length, doc, word) in best.items():
                item = int(np.searchsorted(block.begins, place, side="right")) - 1
                out.append((block.ids[item], block.rows[item], place - int(block.begins[item]), length, None if doc == -(2**62) else -doc, -word))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            names = ["item_id", "item_row", "item_word", "length", "doc_id", "doc_word"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        return run

    docs, out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for block in blocks(benchmark, block_bytes):
        part = docs.mapInArrow(find(block), MATCHES)
        out = part if out is None else out.union(part)
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("doc"), (-F.col("doc_word")).alias("word"))).alias("best")
    return out.groupBy("item_id", "item_row", "item_word").agg(best).select(
        "item_id", "item_word", F.col("best.length").alias("length"), (-F.col("best.doc")).alias("doc_id"), (-F.col("best.word")).alias("doc_word")
    )
