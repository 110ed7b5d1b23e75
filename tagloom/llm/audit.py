"""Filter interaction audit: what every order of some filters keeps, removes and wastes, in higher-order SQL folds.

A document fails a set of filters, its mask. Documents are counted by part and mask, so that a part is at most 2^n cells
whatever its size. Each cell folds across the array of all orders, a constant of the plan: ``transform`` takes an order,
``aggregate`` walks its filters with the filters seen so far as state and appends one weighted struct a step. The cells
of a part, 32 at most for five filters, are merged by elementwise sums. Only counts are shuffled, never texts.

The last filter is always "same text as a row of a smaller doc_id". Two texts are the same if 128 bits of their SHA-256
are. Null text counts as empty. A null doc_id is neither smaller nor greater than another, so such rows never fail the
last filter and make none fail; of rows that share doc_id and text, all fail or none. A null source is the part ''.
Labels without doc_id are left out; of several labels for an id any 1 counts, for all rows of that id. An empty table
has no parts and no rows. Extra columns play no role, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.plans.stages import stage

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters() -> dict[str, Column]:
    """Failure conditions over ``text`` and its ``words``: too short, repetitive, shouting, markup characters."""
    words = F.size("words")
    return {
        "A": words < 200,
        "B": F.size(F.array_distinct("words")) * 100 < words * 50,
        "C": F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.char_length("text") * 2,
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def failure_masks(documents: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows (doc_id, part, mask, rows): bit i of mask is set if the i-th filter fails, the bit after the last for a repeated text."""
    filters = text_filters() if filters is None else filters
    text = F.coalesce("text", F.lit("")).alias("text")
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), part, text)
    docs = docs.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    same = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    narrow = stage(docs.select("doc_id", "part", same.alias("same"), mask.alias("mask")), "masks")
    # copies under one id are one row from here on, and the join below has the id in its key: no text is a hot key
    counted = narrow.groupBy("same", "doc_id", "part", "mask").agg(F.count("*").alias("rows"))
    first = narrow.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    marked = counted.join(first.withColumn("first", F.lit(True)), ["same", "doc_id"], "left")
    repeated = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << len(filters)).otherwise(0)
    return marked.select("doc_id", "part", (F.col("mask") + repeated).alias("mask"), "rows")


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, rows, good, toxic): documents of each mask, those labelled good and those labelled toxic."""
    marks = [F.max((F.col(c) == 1).cast("int")).alias(new) for c, new in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks)
    labelled = masks.join(known.where("good = 1 or toxic = 1"), "doc_id", "left")
    counts = [F.sum(F.when(F.col(c) == 1, F.col("rows")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return labelled.groupBy("part", "mask").agg(F.sum("rows").alias("rows"), *counts)


def _fold(orders: str) -> str:
    """SQL of all steps of all orders for one ``cell`` (mask, rows, good, toxic)."""
    fails, before = "shiftright(cell.mask, f) & 1 = 1", "cell.mask & walk.seen"
    counts = {
        "kept": "if(cell.mask & (walk.seen | shiftleft(1, f)) = 0, cell.rows, 0L)",
        "removed": f"if({fails} and {before} = 0, cell.rows, 0L)",
        "redundant": f"if({fails} and {before} <> 0, cell.rows, 0L)",
        "unique_fails": "if(cell.mask = shiftleft(1, f), cell.rows, 0L)",
        "good_lost": f"if({fails} and {before} = 0, cell.good, 0L)",
        "toxic_lost": f"if({fails} and {before} = 0, cell.toxic, 0L)",
    }
    step = "named_struct('filter', f, " + ", ".join(f"'{name}', {counts[name]}" for name in _COUNTS) + ")"
    empty = f"cast(array() as array<struct<filter:int,{','.join(f'{name}:bigint' for name in _COUNTS)}>>)"
    walk = f"(walk, f) -> named_struct('seen', walk.seen | shiftleft(1, f), 'steps', concat(walk.steps, array({step})))"
    return f"flatten(transform({orders}, o -> aggregate(o, named_struct('seen', 0, 'steps', {empty}), {walk}, walk -> walk.steps)))"


def audited(cells: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Per part, filter_order and step: the counts, and ``shapley``, the filter's removals summed over all orders."""
    n = len(names)
    order_names = ["".join(o) for o in permutations(names)]
    orders = "array(" + ",".join(f"array({','.join(str(names.index(x)) for x in o)})" for o in order_names) + ")"
    merge = "named_struct('filter', a.filter, " + ", ".join(f"'{c}', a.{c} + b.{c}" for c in _COUNTS) + ")"
    folded = f"transform(cells, cell -> {_fold(orders)})"
    merged = f"aggregate(slice(folded, 2, size(folded)), folded[0], (sums, one) -> zip_with(sums, one, (a, b) -> {merge}))"
    whole = f"transform(sequence(0, {n - 1}), f -> aggregate(steps, 0L, (total, s) -> total + if(s.filter = f, s.removed, 0L)))"
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("cells"))  # 2^n cells at most
    parts = parts.select("part", F.expr(folded).alias("folded")).select("part", F.expr(merged).alias("steps"))
    parts = parts.select("part", "steps", F.expr(whole).alias("shapley"))
    named = "array(" + ",".join(f"'{o}'" for o in order_names) + ")"
    return parts.select("part", "shapley", F.posexplode("steps").alias("at", "s")).select(
        "part",
        F.expr(f"{named}[cast(at div {n} as int)]").alias("filter_order"),
        F.expr(f"cast(at % {n} + 1 as int)").alias("step"),
        *[F.col(f"s.{c}").alias(c) for c in _COUNTS],
        F.expr("shapley[s.filter]").alias("shapley"),
    )
