"""Class distribution of a labelled data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.ids import dense_ids
from tagloom.schemas import KINDS

IMBALANCE_RATIO = 3.0
ORDER = ("image_name", "kind_ix", "item_ix")


def label_stream(results: DataFrame, keys: Sequence[str] = ("image_name",)) -> DataFrame:
    """One row per label of the six kinds: keys, kind, kind_ix, item_ix, label. Read texts all count as ``text``."""

    def stream(kind_ix: int, kind: str) -> Column:
        def one(item: Column, ix: Column) -> Column:
            label = F.lit("text") if kind == "texts" else item["label"]
            return F.struct(
                F.lit(kind).alias("kind"), F.lit(kind_ix).alias("kind_ix"), ix.alias("item_ix"), label.alias("label")
            )

        return F.transform(F.col(kind), one)

    streams = [stream(kind_ix, kind) for kind_ix, kind in enumerate(KINDS)]
    return results.select(*keys, F.inline(F.concat(*streams)))


def class_distribution(labels: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """label, n, percentage (and first_seen if an order is given); counts combine on the map side."""
    aggregates = [F.count("*").alias("n")]
    if order:
        aggregates.append(F.min(F.struct(*order)).alias("first_seen"))
    counts = labels.groupBy("label").agg(*aggregates)
    # the total is a scalar subquery, not a window over all labels in one partition
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("label", "n", (F.col("n") / total * 100).alias("percentage"), *(["first_seen"] if order else []))


def imbalance(distribution: DataFrame, ratio: float = IMBALANCE_RATIO) -> DataFrame:
    """One row: the largest and smallest class, their ratio, whether it exceeds the limit, and a suggestion.

    Of equally large classes the first seen one counts.
    """
    tie = "first_seen" if "first_seen" in distribution.columns else "label"
    extremes = distribution.agg(
        F.count("*").alias("n_classes"),
        F.min_by("label", F.struct((-F.col("n")).alias("n"), tie)).alias("max_label"),
        F.min_by("label", F.struct("n", tie)).alias("min_label"),
        F.max("n").alias("max_n"),
        F.min("n").alias("min_n"),
    )
    flagged = (F.col("n_classes") > 1) & (F.col("max_n") / F.col("min_n") > ratio)
    return extremes.select(
        "n_classes",
        "max_label",
        "min_label",
        "max_n",
        "min_n",
        (F.col("max_n") / F.col("min_n")).alias("ratio"),
        F.coalesce(flagged, F.lit(False)).alias("imbalanced"),
        F.when(
            flagged,
            F.concat(
                F.lit("Uneven classes: far more labels of '"),
                "max_label",
                F.lit("' than of '"),
                "min_label",
                F.lit("'; gather or augment examples of the rarer ones."),
            ),
        ).alias("suggestion"),
    )


def report_lines(distribution: DataFrame) -> DataFrame:
    """Text lines of the distribution, numbered by first appearance."""
    numbered = dense_ids(distribution, ["first_seen"], "line_no", start=1)
    text = F.format_string("- %s: %d (%.1f%%)", "label", "n", F.bround("percentage", 1))
    return numbered.select(F.col("line_no").cast("int").alias("line_no"), text.alias("line"))
