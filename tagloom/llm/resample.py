"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample.

Words and word pairs are hashed to ``SIZE`` places. The raw model counts all documents; the target model counts all documents
labelled good. A document's log weight is the mean log ratio target / raw of its n-grams, times ``TEMPER`` n-grams, so that length alone neither favours nor harms it. With
Gumbel noise from a hash of its id added, the k highest keys are a sample without replacement in proportion to the
weights; k is the share of good labels times the number of documents. The k-th key is found by counting, not sorting.

A text without words, or null, has the log weight ``LOWEST``. Keys are compared to 2^-20; documents whose key equals the
k-th are all in the sample, so repeated rows share their fate. Without labels of both kinds every document is in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import textvec
from tagloom.plans.stages import stage

SIZE = 1 << 14
TEMPER = 30.0
LOWEST = -1000.0
#: Most bits of the table that keeps texts of unlabelled documents out of the exchange
FILTER_BITS = 1 << 23
_STEP = 1 << 20
_DIGITS = (1 << 20, 1 << 10, 1)


def _grams(texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    hashes, rows = textvec.words(texts, textvec.WHITE)
    pairs = textvec.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[rows[1:] == rows[:-1]] if len(hashes) else hashes
    places = np.concatenate([hashes, pairs]) & np.uint64(SIZE - 1)
    return places.astype(np.int64), np.concatenate([rows, rows[1:][rows[1:] == rows[:-1]]])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SIZE, dtype=np.int64)
    for _, texts in textvec.pieces(batches, "text"):
        counts += np.bincount(_grams(texts)[0], minlength=SIZE)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE), pa.int32()), pa.array(counts)], ["place", "n"])


def _counted(texts: DataFrame) -> np.ndarray:
    """How often each place occurs in ``text``."""
    out = np.zeros(SIZE)
    for place, n in texts.select("text").mapInArrow(_tally, "place int, n long").groupBy("place").agg(F.sum("n")).collect():
        out[place] = n
    return out


def _texts_of(documents: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """``text`` of the documents whose ``doc_id`` is among the different ``ids``, shuffling hardly any other text.

    A table of at most ``FILTER_BITS`` bits, one set for each id by its hash, is small enough to broadcast and leaves out most
    documents before the exchange; the join with the ids themselves is exact. With very many ids the table lets more through.
    """
    words = max(1 << 10, min(FILTER_BITS, 1 << (16 * n_ids).bit_length()) // 64)
    place = F.xxhash64("doc_id")
    word, bit = F.pmod(F.shiftright(place, 6), F.lit(words)), F.pmod(place, F.lit(64))
    table = ids.groupBy(word.alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64L) as int))")).alias("_bits"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    passed = docs.join(F.broadcast(table), word == F.col("_word")).where(F.getbit("_bits", bit.cast("int")) == 1)
    # not a semi join: that would be moved before the table, with all texts
    return passed.select("doc_id", "text").join(ids, "doc_id").select("text")


def log_ratios(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratio of each place, and the share of good labels."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good"))
    total, good = known.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not good or good == total:
        return np.zeros(SIZE), 1.0
    raw, target = _counted(documents), _counted(_texts_of(documents, known.where("good = 1").select("doc_id"), good))
    prior = (raw + 1) / (raw.sum() + SIZE)
    target = (target + prior * 1000) / (target.sum() + 1000)  # places without evidence keep a ratio of 1
    return np.log(target / prior), good / total


def weighted(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, log_weight."""
    shared = documents.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in textvec.pieces(batches, "text"):
            places, owners = _grams(texts)
            n = np.bincount(owners, minlength=len(texts))
            mean = np.bincount(owners, shared.value[places], len(texts)) / np.maximum(n, 1)
            weights = np.where(n > 0, np.maximum(mean * TEMPER, LOWEST), LOWEST)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(weights)], ["doc_id", "log_weight"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, log_weight double")


def resampled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, log_weight, key (log weight with noise), selected."""
    ratios, share = log_ratios(documents, labels)
    chance = (F.pmod(F.xxhash64(F.lit("gumbel"), "doc_id"), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    keyed = weighted(documents, ratios).withColumn("key", F.col("log_weight") - F.log(-F.log(chance)))
    keyed = stage(keyed.withColumn("step", F.floor(F.col("key") * _STEP)), "keys")
    wanted = round(share * keyed.count())
    floor = _kth(keyed, wanted) if share < 1 else None
    selected = F.lit(True) if floor is None else F.col("step") >= floor
    return keyed.select("doc_id", "log_weight", "key", selected.alias("selected"))


def _kth(keyed: DataFrame, k: int) -> int | None:
    """The k-th largest step: three counts of at most a few thousand ranges, each within the range found before."""
    left, low = keyed.select("step"), None
    if k <= 0:
        return 1 << 62
    for digit in _DIGITS:
        counts = left.groupBy(F.floor(F.col("step") / digit).alias("range")).count().collect()
        for r in sorted(counts, key=lambda r: -r["range"]):
            if k <= r["count"]:
                low = r["range"]
                break
            k -= r["count"]
        else:
            return None
        left = left.where(F.floor(F.col("step") / digit) == low)
    return low
