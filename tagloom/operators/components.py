"""Connected components of a table of links, by joins, in a number of rounds that grows with the logarithm of its longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.plans.stages import stage


def connected(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id on a link (a, b); a component is named by its least id.

    Two steps alternate until nothing changes: every larger neighbour of an id is linked to the least id around it, then
    every id and its smaller neighbours to the least of them. Both keep components and shorten paths; each round is
    a stage table. The least neighbour is found by an aggregation that combines on the map side.
    """
    larger, smaller = F.greatest("a", "b").alias("up"), F.least("a", "b").alias("down")
    now = stage(links.filter("a <> b").select(larger, smaller).distinct(), "component-links")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("down", "up"))
        least = both.groupBy("up").agg(F.least("up", F.min("down")).alias("low"))
        raised = both.filter("down > up").join(least, "up").select(F.col("down").alias("up"), F.col("low").alias("down"))
        raised = raised.filter("up <> down").distinct()
        around = raised.join(raised.groupBy("up").agg(F.min("down").alias("low")), "up")
        lowered = around.select(F.col("down").alias("up"), F.col("low").alias("down")).union(around.select("up", "low"))
        now = stage(lowered.filter("up <> down").distinct(), "component-links")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("up").alias("id"), F.col("down").alias("component")).union(now.select("down", "down").distinct())


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("up", "down").cast("decimal(20,0)"))).first()
    return row[0], row[1]
