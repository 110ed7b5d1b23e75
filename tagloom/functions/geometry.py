"""Box, polygon and matching expressions. Boxes are structs with xmin, ymin, xmax, ymax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.schemas import BOX

MATCH_IOU = 0.5

MATCHES = "array<struct<left_pos:int,right_pos:int,iou:double>>"


def iou_sql(a: str, b: str) -> str:
    """Intersection over union of the boxes under two name prefixes; 0 when they do not overlap."""
    width = f"greatest(0D, least({a}xmax, {b}xmax) - greatest({a}xmin, {b}xmin))"
    height = f"greatest(0D, least({a}ymax, {b}ymax) - greatest({a}ymin, {b}ymin))"
    areas = " + ".join(f"({p}xmax - {p}xmin) * ({p}ymax - {p}ymin)" for p in (a, b))
    inter = f"{width} * {height}"
    return f"CASE WHEN {width} = 0D OR {height} = 0D THEN 0D ELSE {inter} / ({areas} - {inter}) END"


def greedy_match_sql(left: str, right: str, threshold: float = MATCH_IOU, label: str = "label") -> str:
    """One-to-one matches of two box arrays, in the order of the left one, as an array of MATCHES.

    Each left box takes the still free right box of the same label with the
    highest IoU, the first of equals, if that reaches the threshold.
    """
    overlap = f"CASE WHEN free.other.{label} = step.box.{label} THEN {iou_sql('step.box.', 'free.other.')} ELSE 0D END"
    best = f"array_max(transform(state.open, free -> struct({overlap} AS iou, -free.pos AS back)))"
    # an inner fold over the single best candidate names it, so that it is computed once
    take = (
        f"aggregate(array({best}), state, (state, top) -> CASE WHEN top.iou > 0D AND top.iou >= {threshold}D THEN"
        " struct(filter(state.open, free -> free.pos <> -top.back) AS open,"
        f" CAST(concat(state.kept, array(struct(step.pos AS left_pos, -top.back AS right_pos, top.iou AS iou))) AS {MATCHES}) AS kept)"
        " ELSE state END)"
    )
    steps = f"transform({left}, (box, pos) -> struct(box, pos))"
    start = f"struct(transform({right}, (other, pos) -> struct(other, pos)) AS open, CAST(array() AS {MATCHES}) AS kept)"
    return f"aggregate({steps}, {start}, (state, step) -> {take}, state -> state.kept)"


def match_score_sql(left: str, right: str, threshold: float = MATCH_IOU, label: str = "label") -> str:
    """Sum of matched IoU over the larger count: 1 for two empty sides, 0 for one."""
    total = f"aggregate({greedy_match_sql(left, right, threshold, label)}, 0D, (acc, m) -> acc + m.iou)"
    return (
        f"CASE WHEN size({left}) = 0 AND size({right}) = 0 THEN 1D WHEN size({left}) = 0 OR size({right}) = 0 THEN 0D"
        f" ELSE {total} / greatest(size({left}), size({right})) END"
    )


SEGMENT_BOX_SQL = (
    "transform({}, s -> struct(s.label AS label, array_min(s.polygon.x) AS xmin, array_min(s.polygon.y) AS ymin,"
    " array_max(s.polygon.x) AS xmax, array_max(s.polygon.y) AS ymax))"
)


def segment_to_box(segment: Column) -> Column:
    """Enclosing box of a polygon."""
    xs = F.transform(segment["polygon"], lambda p: p["x"])
    ys = F.transform(segment["polygon"], lambda p: p["y"])
    return F.struct(
        segment["label"].alias("label"),
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
        segment["confidence"].alias("confidence"),
    ).cast(BOX)


def pixel(value: Column, size: Column) -> Column:
    """Nearest pixel, halves to the even one."""
    return F.rint(value * size).cast("int")


def _clamped_pixel(value: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(size.cast("int"), pixel(value, size)))


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    xmin, xmax = _clamped_pixel(box["xmin"], width), _clamped_pixel(box["xmax"], width)
    ymin, ymax = _clamped_pixel(box["ymin"], height), _clamped_pixel(box["ymax"], height)
    return F.struct(
        xmin.alias("xmin"),
        ymin.alias("ymin"),
        xmax.alias("xmax"),
        ymax.alias("ymax"),
        F.greatest(F.lit(0), xmax - xmin).alias("width"),
        F.greatest(F.lit(0), ymax - ymin).alias("height"),
    )


def pixel_point(point: Column, width: Column, height: Column) -> Column:
    return F.struct(pixel(point["x"], width).alias("x"), pixel(point["y"], height).alias("y"))


def center_form(box: Column) -> Column:
    return F.struct(
        ((box["xmin"] + box["xmax"]) / 2).alias("x_center"),
        ((box["ymin"] + box["ymax"]) / 2).alias("y_center"),
        (box["xmax"] - box["xmin"]).alias("width"),
        (box["ymax"] - box["ymin"]).alias("height"),
    )


def corner_form(x_center: Column, y_center: Column, width: Column, height: Column) -> list[Column]:
    return [
        (x_center - width / 2).alias("xmin"),
        (y_center - height / 2).alias("ymin"),
        (x_center + width / 2).alias("xmax"),
        (y_center + height / 2).alias("ymax"),
    ]
