"""Greedy one-to-one box matching over tables of any group size.

``match_boxes`` takes two long tables (keys, label, item_ix, xmin..ymax; item_ix
unique in its group and side). Boxes of different labels never meet, so a group
is all boxes of one label under its keys. Ordinary groups are matched inside one
row; a larger one falls apart into the connected components of its candidate
pairs, each matched by one sorted pass, and only a component that is itself too
large for one task is matched by joins in rounds. The result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.geometry import MATCH_IOU, greedy_match_sql, iou_sql
from tagloom.operators.components import connected
from tagloom.operators.groups import GROUP_LIMIT, rank_in_group, split_hot
from tagloom.plans.stages import stage
from tagloom.schemas import CORNERS

# Boxes and candidate pairs of a component that one task may hold.
COMPONENT_ROWS = 200_000

# Boxes of a cell that one join task pairs with as many others.
CELL_BLOCK = 1024


def match_boxes(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    threshold: float = MATCH_IOU,
    label: str = "label",
    limit: int = GROUP_LIMIT,
    component_rows: int = COMPONENT_ROWS,
) -> DataFrame:
    """Matched pairs: keys, the label they share, left_ix, right_ix, iou.

    ``limit`` and ``component_rows`` choose the way, not the result.
    """
    _check_threshold(threshold)
    keys = list(keys)
    columns = [*keys, label, "item_ix", *CORNERS]
    sides = left.select(*columns, F.lit(0).alias("side")).unionByName(right.select(*columns, F.lit(1).alias("side")))
    cold, hot = split_hot(sides, [*keys, label], limit)
    matched = _match_in_rows(cold, keys, threshold, label)
    if hot is not None:
        hot = stage(hot, "hot-boxes")
        matched = matched.unionByName(
            match_by_components(
                hot.filter("side = 0").drop("side"), hot.filter("side = 1").drop("side"), keys, threshold, label, component_rows
            )
        )
    return matched


def _check_threshold(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("the IoU threshold must be above 0 and at most 1")


def group_sides(sides: DataFrame, keys: Sequence[str], label: str, *more: Column) -> DataFrame:
    """One row per group: keys, its boxes of side 0 as ``left`` and of side 1 as ``right``, in item order, and ``more`` aggregates."""
    item = F.struct("item_ix", label, *CORNERS)
    return sides.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, item))).alias("left"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, item))).alias("right"),
        *more,
    )


def _match_in_rows(sides: DataFrame, keys: list[str], threshold: float, label: str) -> DataFrame:
    grouped = group_sides(sides, [*keys, label], label)
    matches = F.expr(greedy_match_sql("left", "right", threshold, label))
    return grouped.select(*keys, label, "left", "right", F.explode(matches).alias("m")).select(
        *keys,
        label,
        F.get(F.col("left"), F.col("m.left_pos"))["item_ix"].alias("left_ix"),
        F.get(F.col("right"), F.col("m.right_pos"))["item_ix"].alias("right_ix"),
        F.col("m.iou").alias("iou"),
    )


# --- candidates: which boxes can reach the threshold at all --------------------------------------


def _size_level(extent: Column, base: float) -> Column:
    return F.log(extent) / F.lit(math.log(base))


def _home_cell(low: str, high: str, base: float) -> Column:
    level = F.floor(_size_level(F.col(high) - F.col(low), base))
    return F.struct(level.alias("level"), F.floor(F.col(low) / F.pow(F.lit(base), level + 1)).alias("cell"))


def _reachable_cells(low: str, high: str, threshold: float, base: float) -> Column:
    """Cells of the one or two size levels whose boxes can overlap enough on this axis."""
    extent = F.col(high) - F.col(low)
    at, spread = _size_level(extent, base), F.lit(math.log(1 / threshold) / math.log(base) + 1e-6)

    def cells(level: Column) -> Column:
        size = F.pow(F.lit(base), level + 1)
        wider = F.least(F.greatest(extent, size), extent * F.lit(1.0001 / threshold))
        reach = wider * F.lit((1 - threshold) * (1 + 1e-9)) + F.lit(1e-12)
        return F.transform(
            F.sequence(F.floor((F.col(low) - reach) / size), F.floor((F.col(low) + reach) / size)),
            lambda cell: F.struct(level.alias("level"), cell.alias("cell")),
        )

    return F.flatten(F.transform(F.sequence(F.floor(at - spread), F.floor(at + spread)), cells))


def _named_side(df: DataFrame, name: str, on: list[str], shared: Sequence[str] = ()) -> DataFrame:
    kept = [*on, *shared]
    return df.select(*kept, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in kept])


def grid_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], threshold: float = MATCH_IOU) -> DataFrame:
    """All pairs of boxes, equal on ``on``, with IoU at or above the threshold, for groups of any size.

    Boxes meet in grid cells that fit their size: partners differ by at most
    ``1/threshold`` in width and height and lie within a fixed share of their
    width, so a left box probes a constant number of cells and never the whole
    group. Left columns come as ``left_*``, right columns as ``right_*``.
    """
    _check_threshold(threshold)
    on = list(on)
    # levels are two partners' ratios wide, so that partners are at most one level apart
    base = 1.0001 / threshold**2
    solid = (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))
    probes = (
        left.filter(solid)
        .withColumn("_x", F.explode(_reachable_cells("xmin", "xmax", threshold, base)))
        .withColumn("_y", F.explode(_reachable_cells("ymin", "ymax", threshold, base)))
    )
    homes = (
        right.filter(solid)
        .withColumn("_x", _home_cell("xmin", "xmax", base))
        .withColumn("_y", _home_cell("ymin", "ymax", base))
    )
    cell = ["_x", "_y"]
    probes, homes = _in_blocks(probes, homes, [*on, *cell], CELL_BLOCK)
    joined = _named_side(probes, "left", on, [*cell, "_l", "_r"]).join(_named_side(homes, "right", on, [*cell, "_l", "_r"]), [*on, *cell, "_l", "_r"])
    return _overlapping(joined.drop(*cell, "_l", "_r"), threshold)


def _in_blocks(left: DataFrame, right: DataFrame, on: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers (_l, _r), so that rows equal on ``on`` meet once, in blocks of about ``block`` by ``block``.

    Near copies crowd in one cell whatever its size. A side with more than ``block`` rows under a key is dealt into
    parts by a hash of the row, and the other side is repeated once for each of them. Only keys that are large on one side
    are listed, which are at most a ``block``-th of the rows; all others are block (0, 0).
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("m"))
    counts = counts.unionByName(right.groupBy(*on).agg(F.lit(0).cast("bigint").alias("n"), F.count("*").alias("m")))
    parts = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int").alias(f"_{n}")
    large = counts.groupBy(*on).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).filter((F.greatest("n", "m") > block) & (F.least("n", "m") > 0))
    large = stage(large.select(*on, parts("n"), parts("m")), "crowded-cells")
    if large.isEmpty():
        return left.withColumn("_l", F.lit(0)).withColumn("_r", F.lit(0)), right.withColumn("_l", F.lit(0)).withColumn("_r", F.lit(0))

    def dealt(side: DataFrame, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        whole = F.xxhash64(*[F.col(c) for c in side.columns if c not in on])
        marked = side.withColumn("_deal", whole).join(large, on, "left")
        part = F.coalesce(F.pmod(F.col("_deal"), F.col(own_parts)), F.lit(0)).cast("int").alias(own)
        met = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other_parts) - 1, F.lit(0)))).alias(other)
        return marked.select(*side.columns, part, met)

    return dealt(left, "_l", "_n", "_r", "_m"), dealt(right, "_r", "_m", "_l", "_n")


def _overlapping(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.withColumn("iou", F.expr(iou_sql("left_", "right_"))).filter(F.col("iou") >= threshold)


def candidate_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], threshold: float = MATCH_IOU, limit: int = GROUP_LIMIT) -> DataFrame:
    """The pairs of :func:`grid_pairs`, for groups mostly within ``limit``: those are simply joined on ``on``.

    Larger groups go by the grid. ``limit`` chooses the way, not the result.
    """
    _check_threshold(threshold)
    on = list(on)
    sides = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    cold, hot = split_hot(sides, on, limit)

    def side(df: DataFrame, which: int) -> DataFrame:
        return df.filter(F.col("_side") == which).drop("_side")

    joined = _named_side(side(cold, 0), "left", on).join(_named_side(side(cold, 1), "right", on), on)
    pairs = _overlapping(joined, threshold)
    if hot is not None:
        hot = stage(hot, "hot-pairs")
        pairs = pairs.unionByName(grid_pairs(side(hot, 0), side(hot, 1), on, threshold))
    return pairs


# --- large groups: components of candidate pairs ---------------------------------------------------


def match_by_components(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    threshold: float = MATCH_IOU,
    label: str = "label",
    component_rows: int = COMPONENT_ROWS,
) -> DataFrame:
    """Greedy matching by connected components of the candidate pairs, for groups of any size.

    Equal boxes are collapsed to shapes, so a crowd of copies costs one candidate
    pair. What one component takes never matters to another, so each is matched by
    itself in item order: its rows are sorted together and read once. Components
    of more than ``component_rows`` boxes and pairs are matched in rounds.
    """
    _check_threshold(threshold)
    keys = list(keys)
    shape = [*keys, label, *CORNERS]
    number = F.monotonically_increasing_id() * 2  # left shapes are even, right shapes odd
    left_shapes = stage(left.select(*shape).distinct().withColumn("left_shape", number), "left-shapes")
    right_shapes = stage(right.select(*shape).distinct().withColumn("right_shape", number + 1), "right-shapes")
    candidates = stage(
        grid_pairs(left_shapes, right_shapes, [*keys, label], threshold).select(
            F.col("left_left_shape").alias("left_shape"), F.col("right_right_shape").alias("right_shape"), "iou"
        ),
        "shape-candidates",
    )
    part = stage(connected(candidates.select(F.col("left_shape").alias("a"), F.col("right_shape").alias("b"))), "components")

    def rows(df: DataFrame, kind: int, at: str) -> DataFrame:
        given = {"left_shape": "bigint", "right_shape": "bigint", "item_ix": "bigint", "iou": "double"}
        columns = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in given.items()]
        return df.join(part, F.col(at) == F.col("id")).select("component", F.lit(kind).alias("kind"), *columns)

    items = rows(right.join(right_shapes, shape), _COPY, "right_shape").unionByName(rows(left.join(left_shapes, shape), _ITEM, "left_shape"))
    every = stage(items.unionByName(rows(candidates, _PAIR, "left_shape")), "component-rows")
    small, giant = split_hot(every, ["component"], component_rows)
    ordered = small.repartition("component").sortWithinPartitions("component", "kind", "item_ix")
    matched = ordered.mapInArrow(_match_sorted, "left_shape bigint, left_ix bigint, right_ix bigint, iou double")
    if giant is not None:
        matched = matched.unionByName(_match_in_rounds(stage(giant, "giant-components")))
    return matched.join(left_shapes.select("left_shape", *keys, label), "left_shape").select(*keys, label, "left_ix", "right_ix", "iou")


_COPY, _PAIR, _ITEM = range(3)


def _match_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of components whose rows come one after another: copies of right shapes, candidate pairs, then left items in order."""
    component, copies, wanted, used, sorted_ = None, {}, {}, {}, set()
    for batch in batches:
        out: list[tuple] = []
        for now, kind, left, right, item, iou in zip(*(column.to_pylist() for column in batch.columns)):
            if now != component:
                component, copies, wanted, used, sorted_ = now, {}, {}, {}, set()
            if kind == _COPY:
                copies.setdefault(right, []).append(item)
                used[right] = 0
            elif kind == _PAIR:
                wanted.setdefault(left, []).append((iou, right))
            else:
                if left not in sorted_:
                    wanted[left].sort()
                    sorted_.add(left)
                taken = _best(wanted[left], copies, used)
                if taken:
                    out.append((left, item, copies[taken[1]][used[taken[1]]], taken[0]))
                    used[taken[1]] += 1
        columns = list(zip(*out)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["left_shape", "left_ix", "right_ix", "iou"])


def _best(options: list[tuple], copies: dict, used: dict) -> tuple | None:
    """Of options in ascending order, that of highest IoU with a copy left, of equals that with the first copy; used-up ones are dropped."""
    best, at = None, len(options) - 1
    while at >= 0 and (best is None or options[at][0] == best[0]):
        right = options[at][1]
        if used[right] == len(copies[right]):
            del options[at]
        elif best is None or copies[right][used[right]] < copies[best[1]][used[best[1]]]:
            best = options[at]
        at -= 1
    return best


# --- giant components: exact greedy matching in rounds ---------------------------------------------


def _match_in_rounds(rows: DataFrame) -> DataFrame:
    """Greedy matching of component rows by joins: left_shape, left_ix, right_ix, iou.

    In each round a left item may take its best shape if even all earlier open
    items that could want it leave a copy over (at a tie: if no earlier open item
    touches any of its candidates). The first open item of a component always
    may, so the rounds end; independent items settle together in the first ones.
    Copies are then handed out in item order.
    """
    copies = rows.filter(F.col("kind") == _COPY).select("right_shape", "item_ix")
    right_shapes = copies.groupBy("right_shape").agg(F.count("*").alias("copies"))
    candidates = rows.filter(F.col("kind") == _PAIR).select("left_shape", "right_shape", "iou")
    items = rows.filter(F.col("kind") == _ITEM).select("left_shape", "item_ix")
    right_copies = stage(
        rank_in_group(copies, ["right_shape"], "item_ix", "copy").withColumnRenamed("item_ix", "right_ix"), "right-copies"
    )

    taken = None
    while not items.isEmpty():
        state = right_shapes.select("right_shape", "copies")
        if taken is not None:
            used = taken.groupBy("right_shape").agg(F.count("*").alias("used"))
            state = state.join(used, "right_shape", "left").select(
                "right_shape", (F.col("copies") - F.coalesce("used", F.lit(0))).alias("copies")
            )
        free = candidates.join(state.filter("copies > 0"), "right_shape")
        touching = stage(
            rank_in_group(items.join(free, "left_shape"), ["right_shape"], "item_ix", "place", ["left_shape"]), "touching"
        )
        settled = _settle(touching, taken, right_copies)
        if settled.isEmpty():
            if touching.isEmpty():
                break
            raise AssertionError("the first open item of a component can always settle")
        taken = settled if taken is None else stage(taken.unionByName(settled), "taken")
        items = stage(
            touching.select("left_shape", "item_ix")
            .distinct()
            .join(settled.select("left_shape", "item_ix"), ["left_shape", "item_ix"], "left_anti"),
            "open-items",
        )

    if taken is None:
        taken = candidates.join(items, "left_shape").select("left_shape", "item_ix", "right_shape", "iou").limit(0)
    handed = rank_in_group(taken, ["right_shape"], "item_ix", "copy").join(right_copies, ["right_shape", "copy"])
    return handed.select("left_shape", F.col("item_ix").alias("left_ix"), "right_ix", "iou")


def _settle(touching: DataFrame, taken: DataFrame | None, right_copies: DataFrame) -> DataFrame:
    """Items of this round whose choice can no longer change: left_shape, item_ix, right_shape, iou."""
    item = ["left_shape", "item_ix"]
    facts = ["place", "copies"]
    ranked = touching.groupBy(*item).agg(
        F.max(F.struct("iou", "right_shape", *facts)).alias("top"),
        F.max(F.struct(F.col("iou"), (-F.col("right_shape")).alias("back"))).alias("other"),
        F.max("place").alias("last_place"),
    )
    ranked = stage(ranked.withColumn("tied", F.col("top.right_shape") != -F.col("other.back")), "ranked-items")
    clear = ranked.filter(~F.col("tied") & (F.col("top.place") <= F.col("top.copies"))).select(
        *item, F.col("top.right_shape").alias("right_shape"), F.col("top.iou").alias("iou")
    )
    first = ranked.filter(F.col("tied") & (F.col("last_place") == 1))
    if first.isEmpty():
        return stage(clear, "settled")

    # the next copy of a tied shape is the one behind all copies taken by earlier items
    options = touching.join(first.select(*item, F.col("top.iou").alias("iou")), [*item, "iou"]).select(
        *item, "right_shape", "iou"
    )
    if taken is None:
        options = options.withColumn("copy", F.lit(1))
    else:
        earlier = (
            options.select(*item, "right_shape")
            .join(taken.select("right_shape", F.col("item_ix").alias("_ix")), "right_shape")
            .filter(F.col("_ix") < F.col("item_ix"))
            .groupBy(*item, "right_shape")
            .agg(F.count("*").alias("n"))
        )
        options = options.join(earlier, [*item, "right_shape"], "left").withColumn(
            "copy", F.coalesce("n", F.lit(0)) + 1
        )
    chosen = (
        options.join(right_copies, ["right_shape", "copy"])
        .groupBy(*item)
        .agg(F.min_by(F.struct("right_shape", "iou"), "right_ix").alias("c"))
        .select(*item, "c.right_shape", "c.iou")
    )
    return stage(clear.unionByName(chosen), "settled")
