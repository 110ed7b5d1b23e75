"""Helpers for groups that may be far larger than the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.plans.stages import stage

# Items of a group that are put into one row; larger groups are treated by joins, with the same result.
GROUP_LIMIT = 512
#: Answers or results, with all their labels, that a task sorts or groups by image
RESULT_ROWS = 50_000

_BLOCK = 65_536


def _counted_in_tasks(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Group sizes, counted in tasks of about ``rows`` rows: blocks of ``item_ix`` first, so that no task gets a whole large group."""
    parts = dealt_parts(df, rows)
    block = F.floor(F.col("item_ix") / F.lit(_BLOCK)).alias("_block")
    blocks = df.select(*keys, block).repartition(parts, *keys, "_block").groupBy(*keys, "_block").count()
    return blocks.repartition(parts, *keys).groupBy(*keys).agg(F.sum("count").alias("count"))


def dealt_parts(df: DataFrame, rows: int) -> int:
    """Number of partitions of about ``rows`` rows each, at least one per core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def split_hot(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT, task_rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups within the limit, and those of the larger groups (``None`` if there are none).

    Both are read once to count and once or twice to use, so pass a stored table if it is dear to make. The counting pass
    combines on the map side, and the table of large groups has at most ``rows / limit`` entries. Many small groups hardly combine, and
    their hash tables grow with the bytes a task reads: with ``task_rows`` each counting task gets about so many rows instead.
    """
    keys = list(keys)
    counted = _counted_in_tasks(df, keys, task_rows) if task_rows else df.groupBy(*keys).count()
    hot = stage(counted.filter(F.col("count") > limit).select(*keys), "hot-groups")
    if hot.isEmpty():
        return df, None
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def rank_in_group(df: DataFrame, keys: Sequence[str], order: str, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """1-based rank of a row in its group by an integer column, and by ``ties`` where that isn't unique in the group.

    Works in blocks of the order column: block counts give the offset, and only
    the rows of one block are ever sorted together.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(_BLOCK)))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, "_block")
        .count()
        .select(*keys, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order, *ties)
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_block", "_offset")
    )
