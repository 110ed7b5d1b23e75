"""Expressions over the six label arrays of one result.

The SQL forms take a name prefix: empty for the columns of a table of results,
``draft.`` or a lambda variable with a dot for a struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.geometry import MATCH_IOU, SEGMENT_BOX_SQL, match_score_sql
from tagloom.schemas import KINDS


def label_bag_sql(p: str = "") -> str:
    """All strings that describe a result: labels, read texts, ``track:label`` and visible keypoint names."""
    return (
        f"concat({p}classifications.label, {p}boxes.label, {p}segments.label, {p}poses.label, {p}texts.text,"
        f" transform({p}tracks, t -> concat(t.track_id, ':', t.label)),"
        f" flatten(transform({p}poses, x -> transform(filter(x.keypoints, k -> k.visible), k -> k.name))))"
    )


def label_bag(prefix: str = "") -> Column:
    return F.expr(label_bag_sql(prefix))


def jaccard_sql(a: str, b: str) -> str:
    """Shared over all distinct values: 1 for two empty sides, 0 for one."""
    return (
        f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D"
        f" ELSE size(array_intersect({a}, {b})) / size(array_union({a}, {b})) END"
    )


def result_consistency_sql(a: str, b: str, threshold: float = MATCH_IOU) -> str:
    """Agreement of two results: by boxes if any, else by segments, else by their label bags."""

    def some(kind: str) -> str:
        return f"size({a}{kind}) > 0 OR size({b}{kind}) > 0"

    segments = [SEGMENT_BOX_SQL.format(f"{p}segments") for p in (a, b)]
    return (
        f"CASE WHEN {some('boxes')} THEN {match_score_sql(f'{a}boxes', f'{b}boxes', threshold)}"
        f" WHEN {some('segments')} THEN {match_score_sql(*segments, threshold)}"
        f" ELSE {jaccard_sql(label_bag_sql(a), label_bag_sql(b))} END"
    )


def mean_confidence(prefix: str = "") -> Column:
    """Mean over all items and all keypoints, 0 without any."""
    own = ", ".join(f"{prefix}{kind}.confidence" for kind in KINDS)
    values = f"concat({own}, flatten({prefix}poses.keypoints).confidence)"
    mean = "CASE WHEN size(v) = 0 THEN 0D ELSE aggregate(v, 0D, (acc, c) -> acc + c) / size(v) END"
    return F.expr(f"element_at(transform(array({values}), v -> {mean}), 1)")  # the list is made once


def label_count() -> Column:
    """Number of labels; a pose counts once, its keypoints do not."""
    return F.expr(" + ".join(f"size({kind})" for kind in KINDS))


def items_of(kind: str) -> Column:
    """The array of a kind, to be exploded.

    Exploding the bare column would make Spark infer a filter on it and, where
    the column is still to be parsed, parse once more for that filter.
    """
    return F.transform(F.col(kind), lambda item: item)
