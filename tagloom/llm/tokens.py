"""Token counts: the exact histogram of encoded lengths, and what follows from its suffix sums for every limit.

Every whole text is encoded by a public byte-level vocabulary; tasks give one row for each length they met. For the
limit L of a row: documents and tokens of length L or more, the total if all texts are cut to L tokens, and the share of
documents that L holds whole (so quantiles are the first length that reaches a share).

Null and empty texts have length 0 and are counted. Special tokens are ordinary text. An empty table has no rows.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm import textvec
from tagloom.plans.stages import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths whose sums go to one task
BLOCK = 256
_ENCODERS: dict = {}


def encoder(path: str, pattern: str = PATTERN):
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def length_histogram(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (length, n_docs) over the texts of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(vocabulary).encode_ordinary, Counter()
        for _, texts in textvec.pieces(batches, "text"):
            lengths.update(len(encode(str(t, "utf-8", "replace"))) for t in texts)
        yield pa.RecordBatch.from_arrays([pa.array(list(lengths), pa.int64()), pa.array(list(lengths.values()), pa.int64())], ["length", "n_docs"])

    return documents.select("text").mapInArrow(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """Suffix sums of a histogram (length, n_docs), in blocks of lengths, so that no task sees all of a long one.

    The histogram is stored first, as it is read twice: texts are encoded once.
    """
    rows = stage(histogram, "lengths").withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sums = sums.select(
        "block",
        *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("docs", "tokens")],
        *[F.sum(c).over(everything).alias(f"all_{c}") for c in ("docs", "tokens")],
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("docs", F.sum("n_docs").over(inside)).withColumn("tokens", F.sum("n_tokens").over(inside)).join(sums, "block")
    docs, tokens = F.col("docs") + F.col("later_docs"), F.col("tokens") + F.col("later_tokens")
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        docs.alias("docs_from"),
        tokens.alias("tokens_from"),
        (F.col("all_tokens") - tokens + docs * F.col("length")).alias("truncated_total"),
        ((F.col("all_docs") - docs + F.col("n_docs")) / F.col("all_docs")).alias("share_whole"),
    )


def length_at(table: DataFrame, share: float) -> int | None:
    """Smallest length that holds at least ``share`` of the documents whole."""
    return table.where(F.col("share_whole") >= share).agg(F.min("length")).first()[0]


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens left if every text is cut to ``limit`` tokens, whether or not a text has that length."""
    below = table.where(F.col("length") <= limit).agg(F.sum("n_tokens"), F.count("*")).first()
    above = table.where(F.col("length") > limit).agg(F.sum("n_docs")).first()[0] or 0
    return (below[0] or 0) + above * limit
