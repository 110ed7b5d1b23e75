"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, each pair verified once.

A document's set is its distinct runs of five words. Sets are sorted rare-first: by how often a run's slot of a
fixed-size count table is hit over all documents, then by hash. Two sets with Jaccard >= 0.8 share one of the first
n - ceil(0.8 n) + 1 runs of each, so only those are shuffled. Equal sets are one class before that.

Null or empty text, or text without words: an empty set, linked with nothing, component its own doc_id. Pairs
are verified on one text of each class, so rows without doc_id are linked like all others; a component's id is its least
doc_id, or null if it has none. Repeated rows are members of one class. Extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm import linking, textvec
from tagloom.plans.stages import stage

WIDTH = 5
#: Slots of the count table: a parameter, the same for every input size (8 MB on the driver and in each worker)
SLOTS = 1 << 21
_CHUNKS = 16
_SUFFIX_PARTS = 16


def _sets(texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    hashes, rows = textvec.words(texts, textvec.WHITE)
    hashes, rows = textvec.shingles(hashes, rows, len(texts), WIDTH)
    return textvec.distinct_sets(hashes, rows, len(texts))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set, the same for equal sets."""
    return textvec.mix(_sums(textvec.mix(hashes + np.uint64(0x51)), bounds) * np.uint64(3) + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in textvec.pieces(batches, "text"):
        hashes, bounds = _sets(texts)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(2), pa.array(np.diff(bounds)), pa.array(_signatures(hashes, bounds))],
            ["doc_id", "text_hash", "n_shingles", "signature"],
        )


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = textvec.Seen()
    for batch in batches:
        yield batch.filter(pa.array(seen.fresh(batch.column(0).to_pylist()), pa.bool_()))


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, seen = np.zeros(SLOTS, dtype=np.uint32), textvec.Seen()
    for _, texts in textvec.pieces(batches, "text"):
        hashes, bounds = _sets(texts)
        fresh = np.repeat(seen.fresh(_signatures(hashes, bounds).tolist()), np.diff(bounds))
        counts += np.bincount(_slots(hashes[fresh]), minlength=SLOTS).astype(np.uint32)
    yield from _chunks(counts.astype(np.int64))


def _chunks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = counts.reshape(_CHUNKS, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(_CHUNKS), pa.int32()), pa.array([zlib.compress(np.minimum(p, 2**31 - 1).astype(np.int32).tobytes(), 1) for p in parts])],
        ["chunk", "counts"],
    )


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.int32).astype(np.int64)
            sums[chunk] = sums[chunk] + got if chunk in sums else got
    for chunk, counts in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([zlib.compress(np.minimum(counts, 2**31 - 1).astype(np.int32).tobytes(), 1)])], ["chunk", "counts"]
        )


def slot_counts(documents: DataFrame) -> np.ndarray:
    """How many different texts (copies inside a task count once) have a run in each slot. Size fixed by ``SLOTS``."""
    schema = "chunk int, counts binary"
    partial = documents.select("text").mapInArrow(_count_slots, schema)
    for tasks in (64, 1):  # sums of sums: no task reads from more than its share of the partial tables
        salt = F.pmod(F.spark_partition_id(), F.lit(tasks))
        partial = partial.withColumn("salt", salt).repartition(_CHUNKS, "chunk", "salt").select("chunk", "counts").mapInArrow(_add_chunks, schema)
    out = np.zeros((_CHUNKS, SLOTS // _CHUNKS), dtype=np.int32)
    for chunk, packed in partial.collect():
        out[chunk] += np.frombuffer(zlib.decompress(packed), dtype=np.int32)
    return out.reshape(-1)


def _prefixes(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.frombuffer(table.value, dtype=np.int32), textvec.Seen()
        usual = float(np.median(counts))
        noise = usual + 6 * usual**0.5 + 1
        for _, texts in textvec.pieces(batches, "text"):
            hashes, bounds = _sets(texts)
            sizes, signatures = np.diff(bounds), _signatures(hashes, bounds)
            keep = seen.fresh(signatures.tolist()) & (sizes > 0)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            inside = keep[rows]
            hashes, rows = hashes[inside], rows[inside]
            frequency = counts[_slots(hashes)]
            order = np.lexsort((hashes, frequency, rows))
            hashes, rows, frequency = hashes[order], rows[order], frequency[order]
            first = np.searchsorted(rows, np.arange(len(sizes)))
            place = np.arange(len(rows)) - first[rows]
            prefix = sizes - -(-sizes * linking.ABOVE // linking.BELOW) + 1
            taken = place < prefix[rows]
            # the text of a group of near copies with the fewest edits has the most frequent runs
            usual_share = (np.bincount(rows, np.log1p(frequency), len(sizes)) / np.maximum(sizes, 1)).astype(np.float32)
            rows = rows[taken]
            salts = np.maximum(1, np.ceil((frequency[taken] - noise) / linking.LIST_ROWS)).astype(np.int32)
            for at in range(0, len(rows), 100_000):
                cut = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[taken][cut].view(np.int64)),
                        pa.array(salts[cut]),
                        pa.array(signatures[rows[cut]]),
                        pa.array(sizes[rows[cut]].astype(np.int32)),
                        pa.array(place[taken][cut].astype(np.int32)),
                        pa.array(usual_share[rows[cut]]),
                    ],
                    ["key", "salts", "id", "size", "pos", "weight"],
                )

    return run


def _intersections(full: bool):
    """Sizes and intersection of each pair; unless in ``full``, the suffix filter's bound where that excludes a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept = None, None
        for batch in batches:
            names = batch.schema.names
            side = {s: textvec.strings(batch.column(names.index(f"text_{s}"))) for s in "ab"}
            a_ids = batch.column(0).to_pylist()
            shared, outside, n_a, n_b = [], [], [], []
            for i in range(batch.num_rows):
                if kept_key != a_ids[i]:
                    kept_key, kept = a_ids[i], _set_of(*side["a"], i)
                left, right = kept, _set_of(*side["b"], i)
                n_a.append(len(left[0]))
                n_b.append(len(right[0]))
                bound = int(np.minimum(left[1], right[1]).sum())
                if not full and bound * (linking.ABOVE + linking.BELOW) < (n_a[-1] + n_b[-1]) * linking.ABOVE:
                    shared.append(bound)
                    outside.append(None)
                    continue
                common = _is_in(right[0], left[0])
                shared.append(int(common.sum()))
                outside.append(linking.marks(right[0][~common]) if full else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int32()) for x in (n_a, n_b, shared)), pa.array(outside, pa.list_(pa.int64()))],
                ["a", "b", "n_a", "n_b", "shared", "marks"],
            )

    return run


def _set_of(data: memoryview, offsets: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, _ = _sets([data[offsets[i] : offsets[i + 1]]])
    parts = np.bincount((hashes >> np.uint64(60)).astype(np.int64), minlength=_SUFFIX_PARTS)
    return hashes, parts


def _is_in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(values) or not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def jaccard_components(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id."""
    return _grouped(documents).select("doc_id", "n_shingles", "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` less all rows but one of every component: a row of its least doc_id, or of no doc_id if none has one.

    Rows of an empty set are linked with nothing: one of each (doc_id, text) stays, and all without doc_id.
    """
    grouped = stage(_grouped(documents), "grouped")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    first = grouped.where("n_shingles > 0").groupBy("component").agg(F.min(row).alias("row")).select("row.doc_id", "row.text_hash", F.lit(False).alias("_empty"))
    empty = grouped.where("n_shingles = 0").select("doc_id", "text_hash", F.lit(True).alias("_empty")).distinct()
    kept = first.union(empty).toDF("_kept", "_hash", "_empty")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")) & (F.xxhash64("text") == F.col("_hash"))
    copies = Window.partitionBy("_kept", "_hash").orderBy("_kept")
    rows = documents.join(kept, same).withColumn("_copy", F.row_number().over(copies))
    return rows.where("_copy = 1 or _empty and doc_id is null").select(documents.columns)


def _grouped(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, text_hash, n_shingles, component (null for an empty set), component_id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    described = stage(hashed.mapInArrow(_describe, "doc_id long, text_hash long, n_shingles long, signature long"), "sets")
    classes = described.where("n_shingles > 0").groupBy("signature").agg(F.min("doc_id").alias("first_doc"), F.min("text_hash").alias("text_hash"))

    table = docs.sparkSession.sparkContext.broadcast(slot_counts(docs).tobytes())
    lists = docs.select("text").mapInArrow(_prefixes(table), "key long, salts int, id long, size int, pos int, weight float")

    texts: list[DataFrame] = []

    def fetch(ids: DataFrame) -> None:
        once = hashed.select("text_hash", "text").mapInArrow(_once, "text_hash long, text string")
        wanted = classes.select(F.col("signature").alias("id"), "text_hash").join(ids, "id", "left_semi")
        texts.append(stage(once.join(wanted, "text_hash").groupBy("id").agg(F.first("text").alias("text")), "texts"))

    def verify(pairs: DataFrame, full: bool) -> DataFrame:
        both = pairs.join(texts[0].toDF("b", "text_b"), "b").join(texts[0].toDF("a", "text_a"), "a")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_intersections(full), linking.PAIRS)

    groups = linking.linked_groups(lists, verify, positional=True, prepare=fetch)
    named = classes.join(groups, classes.signature == groups.id, "left").select(
        "signature", "first_doc", F.coalesce("component", "signature").alias("component")
    )
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    answer = named.join(least, "component").select("signature", "component", "component_id")
    return described.join(answer, "signature", "left").select(
        "doc_id", "text_hash", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
