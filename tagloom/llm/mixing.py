"""Mixing sources to target weights as a time-varying curriculum, in DataFrame functions only.

Each source has a weight (its share of all words) and a schedule (how its share of attention changes over training,
a line through given knots). Targets are filled by weight up to ``MOST`` times a source's own words; what is above
that is shared again by weight. Inside a source, documents stand in the order of a hash of their id, and the source
is read as often as its target asks. The words read before a document are the demand at which it is due: inverting the
integral of the schedule at that demand gives its position in training, and documents are range-sorted by position.

Null or empty text has size 0 and is never taken; a null source is a source of its own, the last one; repeated rows are
rows of their own, whose order among each other doesn't matter. The order of a source is that of a hash of doc_id and text, so rows
without doc_id are spread like all others. An empty table gives an empty result. Extra columns are carried along, but one named
like a result column gives way to it; names with ``_mix_`` in front are kept for the steps between.

A source's taken words miss its target by at most half its longest document: that is the reading that lies across the target's end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.plans.stages import stage

#: Weights of the sources in code-point order, repeating
WEIGHTS = (5, 2, 1)
#: Knots (time, attention) of the schedules, repeating like the weights: heavy sources early, light ones late
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)))
#: No source is read more often than this
MOST = 3
#: Rows of a source that are summed in one task
BUCKET_ROWS = 4096


def _cyclic(values: Sequence, rank: str) -> Column:
    return F.element_at(F.array(*values), (F.pmod(F.col(rank) - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source of ``sized`` (source, size): source, rank, weight, source_size, n_rows, target.

    The windows below run over this table of sources, never over documents.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    sources = sources.withColumn("weight", _cyclic([F.lit(w) for w in weights], "rank"))
    sources = sources.withColumn("cap", F.col("source_size") * most)
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sources = sources.withColumn(
        "level",  # words per unit of weight if all sources before this one are at their limit
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    ).withColumn("place", F.row_number().over(by_limit))
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    sources = sources.withColumn("first", F.min(F.when(fits, F.struct("place", "level"))).over(everything))
    target = F.when(F.col("place") < F.col("first.place"), F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return sources.select("source", "rank", "weight", "source_size", "n_rows", F.least(target, F.col("cap").cast("double")).alias("target"))


def _times(schedule: Sequence[tuple[float, float]], share: Column) -> Column:
    """Time at which a schedule has used ``share`` of its whole area: inverse of a piecewise quadratic."""
    areas, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        areas.append(total)
        total += (t1 - t0) * (w0 + w1) / 2
    out = None
    for i in reversed(range(len(areas))):
        (t0, w0), (t1, w1) = schedule[i], schedule[i + 1]
        slope = (w1 - w0) / (t1 - t0)
        rest = F.greatest(share * total - areas[i], F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0)))
        time = F.lit(t0) + F.when(rest > 0, rest * 2 / (root + w0)).otherwise(0.0)
        out = time if out is None else F.when(share * total < areas[i + 1], time).otherwise(out)
    return F.least(out, F.lit(float(schedule[-1][0])))


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: What the operator adds to documents, and what a training order adds to that
ADDED, ORDERED = ("size", "source_size", "target", "taken", "positions"), ("size", "source_size", "target", "taken", "turn", "position")


def planned(documents: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence = SCHEDULES, most: int = MOST, carry_text: bool = True) -> DataFrame:
    """``documents`` with size, source_size, target, taken and ``positions`` (one for each time it is read, ascending).

    Without ``carry_text`` the texts are read once and left out; with it they are read once for the sums of the sources too.
    """
    return _planned(documents, weights, schedules, most, carry_text, ADDED)


def _planned(documents: DataFrame, weights: Sequence[int], schedules: Sequence, most: int, carry_text: bool, added: Sequence[str]) -> DataFrame:
    own = [c for c in documents.columns if c not in added and (carry_text or c != "text")]
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(text, 256)))
    sized = documents.select(*own, text_size(F.col("text")).alias("_mix_size"), key.alias("_mix_key"), F.col("source").alias("_mix_source"))
    if not carry_text:
        sized = stage(sized, "sizes")
    sources = source_targets(sized.select(F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size")), weights, most)
    sources = sources.select(*[F.col(c).alias(f"_mix_of_{c}") for c in sources.columns])
    docs = sized.join(sources, F.col("_mix_source").eqNullSafe(F.col("_mix_of_source")))
    buckets = F.ceil(F.col("_mix_of_n_rows") / BUCKET_ROWS)
    high = F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("long")
    docs = docs.withColumn("_mix_bucket", F.shiftright(high * buckets, 32))
    place = ["_mix_of_rank", "_mix_bucket"]
    inside = Window.partitionBy(*place).orderBy("_mix_key", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_mix_of_rank").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = docs.groupBy(*place).agg(F.sum("_mix_size").alias("_mix_words"))
    offsets = offsets.select(*place, F.coalesce(F.sum("_mix_words").over(upto), F.lit(0)).alias("_mix_offset"))
    docs = docs.withColumn("_mix_inside", F.coalesce(F.sum("_mix_size").over(inside), F.lit(0))).join(offsets, place)
    start, size, target = F.col("_mix_offset") + F.col("_mix_inside"), F.col("_mix_size"), F.col("_mix_of_target")

    def position(turn: int) -> Column:
        demand = start + F.col("_mix_of_source_size") * turn
        share = F.least(demand / F.greatest(target, F.lit(1e-9)), F.lit(1.0))
        which = F.pmod(F.col("_mix_of_rank") - 1, F.lit(len(schedules)))
        time = _times(schedules[-1], share)
        for i, schedule in enumerate(schedules[:-1]):
            time = F.when(which == i, _times(schedule, share)).otherwise(time)
        # a reading counts if its middle lies within the target
        return F.when((size > 0) & (demand * 2 + size <= target * 2), time)

    docs = docs.withColumn("_mix_positions", F.array_compact(F.array(*[position(turn) for turn in range(most)])))
    taken = (size * F.size("_mix_positions")).alias("taken")
    return docs.select(*own, size.alias("size"), F.col("_mix_of_source_size").alias("source_size"), target.alias("target"), taken, F.col("_mix_positions").alias("positions"))


def training_order(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence = SCHEDULES, most: int = MOST, carry_text: bool = True
) -> DataFrame:
    """Every reading of every document as a row (turn, position), range-sorted by position."""
    plan = _planned(documents, weights, schedules, most, carry_text, (*ADDED, *ORDERED))
    readings = plan.select(*[c for c in plan.columns if c != "positions"], F.posexplode("positions").alias("turn", "position"))
    return readings.repartitionByRange("position", "doc_id", "turn").sortWithinPartitions("position", "doc_id", "turn")
