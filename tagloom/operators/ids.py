"""Dense ids in a total order, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.plans.stages import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def dense_ids(df: DataFrame, order: Sequence[str], id_column: str, start: int = 0) -> DataFrame:
    """Number the rows ``start, start+1, ...`` by ``order``, which must be unique.

    The table is range-partitioned, sorted and stored together with partition and
    row numbers; stored, they stay the same however often they are read. Offsets
    come from one count per partition, the only thing that is broadcast.
    """
    order = list(order)
    stored = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))),
        "dense-ids",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(id_column, F.col("_offset") + F.col("_row") + F.lit(start))
        .drop("_part", "_row", "_offset")
    )


def class_ids(labels: DataFrame, order: Sequence[str] = ("image_name", "kind_ix", "item_ix")) -> DataFrame:
    """Class table (label, class_id): ids from 0 by first appearance in ``order``."""
    first = labels.groupBy("label").agg(F.min(F.struct(*order)).alias("first_seen"))
    numbered = dense_ids(first, ["first_seen"], "class_id").select("label", F.col("class_id").cast("int").alias("class_id"))
    return stage(numbered, "classes")
