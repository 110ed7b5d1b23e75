"""The registered queries of the subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import audit, chat, decontam, html, infill, langid, linededup, mixing, ngramjoin, resample, tokens, topk, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _left_out(parts: int, rest: int) -> Column:
    """Rows that teach nothing: the remainder of their id's checksum. False without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == rest, F.lit(False))


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~_left_out(4, 2)))
    return langid.classified(docs, model).withColumn("held_out", _left_out(4, 2))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resampled(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each line that goes, with the line of its component that stays."""
    return linededup.duplicate_lines(_table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """In training order: documents by the position of their first reading."""
    plan = mixing.planned(_table(spark, folder, "documents").select("doc_id", "text", "source"), carry_text=False)
    first = F.round(F.get("positions", F.lit(0)), 6).alias("position")
    return plan.select("doc_id", "size", "source_size", "target", "taken", first).repartitionByRange("position", "doc_id").sortWithinPartitions(
        "position", "doc_id"
    )


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngramjoin.jaccard_components(_table(spark, folder, "documents"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.limits(tokens.length_histogram(_table(spark, folder, "documents")))


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extracted(_table(spark, folder, "pages"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.fit(docs.where(~_left_out(5, 0)), labels.where(~_left_out(5, 0)))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.scored(docs, model).select("doc_id", _left_out(5, 0).alias("held_out"), "score", predicted, "spans")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    masks = audit.failure_masks(_table(spark, folder, "documents"))
    return audit.audited(audit.cells(masks, _table(spark, folder, "labels")))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digests(infill.filled(infill.stored(_table(spark, folder, "documents"))))


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.formatted(turns.union(more)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language,
        op2_decontamination,
        op3_quality,
        op4_topk,
        op5_line_dedup,
        op6_mixing,
        op7_ngram_join,
        op8_token_counts,
        op9_html,
        op10_toxicity,
        op11_filter_audit,
        op12_fill_in_middle,
        op13_chat_format,
    )
}
