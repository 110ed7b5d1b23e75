"""Groups of linked items from candidate lists: verified once per pair, never all pairs of a list.

A candidate list is all rows (key, id) of one key. Every member is verified against one leader of its list; that
joins a list of near copies with as many checks as it has members. Only members whose groups still differ are
compared further, and only if length, position and what both share with the common leader leave a link possible. What is
skipped can't be a link or lies inside a group already, so the groups are those of all links among list members.
Both 4/5 thresholds are exact in integers: a link has 5 * shared >= 4 * all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.plans.stages import stage

#: Jaccard similarity of a link, as a fraction
ABOVE, BELOW = 4, 5
#: Rows of a key that go to one task; expected longer lists are salted
LIST_ROWS = 20_000

PAIRS = "a long, b long, n_a int, n_b int, shared int, marks array<long>"
#: Bits of the marks of a set: any power of two from 64 gives the same groups
MARKS = 1024


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, component) for every id on an edge, component its least id.

    Alternates the large-star and small-star steps until the edges stay the same; each round is a written table.
    """
    spark = edges.sparkSession
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _fingerprint(now)
    while mark[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        now = stage(small.where("u <> v").distinct(), "edges")
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stage(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots), "components") if mark[0] else (
        spark.createDataFrame([], "id long, component long")
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def _possible(size_a: Column, size_b: Column, pos_a: Column | None, pos_b: Column | None) -> Column:
    """Length filter and, for lists of sorted sets, positional filter."""
    fits = F.least(size_a, size_b) * BELOW >= F.greatest(size_a, size_b) * ABOVE
    if pos_a is None:
        return fits
    most = F.least(size_a - pos_a, size_b - pos_b)
    return fits & (most * (ABOVE + BELOW) >= (size_a + size_b) * ABOVE)


def centred(lists: DataFrame) -> DataFrame:
    """Rows (key, id) as ``linked_groups`` takes them, less members alone in a list, each led by the member that meets most others in all its lists.

    A group of near copies meets in many lists; one leader for nearly all of them is compared with each copy once, not once
    per list. Lists longer than ``LIST_ROWS`` are dealt into parts. Sizes are left at 0, as repeated elements aren't told apart yet.
    """
    whole = Window.partitionBy("key")
    met = stage(
        lists.select("*", F.count("*").over(whole).alias("n"), F.min("id").over(whole).alias("low"), F.max("id").over(whole).alias("high"))
        .where("low <> high")
        .drop("low", "high"),
        "met",
    )
    weights = met.groupBy("id").agg(F.sum("n").cast("float").alias("weight"))
    parts = F.ceil(F.col("n") / LIST_ROWS).cast("int").alias("salts")
    return met.join(weights, "id").select("key", parts, "id", F.lit(0).alias("size"), F.lit(0).alias("pos"), "weight")


def linked_groups(
    lists: DataFrame,
    verify: Callable[[DataFrame, bool], DataFrame],
    positional: bool,
    prepare: Callable[[DataFrame], None] | None = None,
    both_ways: bool = False,
    bits: int = MARKS,
) -> DataFrame:
    """Components (id, component) of the links among members of each list.

    ``lists``: key long, salts int (into how many parts the key's list is dealt), id long, size int (of its set, or 0 where
    that isn't known yet: such lists have no length filter), pos int (place of the key in the id's sorted set, or 0), weight float (the member with the most leads its list). ``verify`` takes
    distinct pairs (a, b, n_a, n_b), a <> b, and whether all are needed in full, and returns rows of ``PAIRS``: sizes of
    the sets, their ``shared`` count and the ``marks`` of what b has and a lacks, followed by those of what a has and b lacks
    if ``both_ways``. A pair that is not needed in full may have an upper bound as ``shared`` where that rules a link out. ``prepare`` is told all ids that share a list.
    """
    places = ("pos", "lead.pos") if positional else (None, None)
    part = Window.partitionBy("key", "salt")
    member = F.struct((-F.col("weight")).alias("heavy"), "id", "size", "pos")
    dealt = lists.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    shared = stage(
        dealt.select("*", F.min(member).over(part).alias("lead"), F.min("id").over(part).alias("low"), F.max("id").over(part).alias("high"))
        .where("salts > 1 or low <> high")
        .drop("low", "high"),
        "lists",
    )
    if prepare:
        prepare(shared.select("id").distinct())
    heads = shared.where("salts > 1 and id = lead.id").drop("lead").distinct()
    heads = heads.withColumn("lead", F.min(member).over(Window.partitionBy("key")))

    def with_leads(rows: DataFrame) -> DataFrame:
        col = lambda name: None if name is None else F.col(name)
        return rows.where(F.col("id") != F.col("lead.id")).where(
            _possible(F.col("size"), F.col("lead.size"), col(places[0]), col(places[1]))
        ).select(F.col("lead.id").alias("a"), F.col("id").alias("b"), F.col("lead.size").alias("n_a"), F.col("size").alias("n_b"))

    star = with_leads(shared).union(with_leads(heads)).distinct()
    near = stage(verify(star, True), "verified")
    links = near.where(_is_link())
    groups = components(links.select("a", "b"))

    known = near.select(F.col("a").alias("lead_id"), F.col("b").alias("id"), F.col("n_b").alias("exact"), F.col("shared").alias("has"), "marks")
    member_rows = (
        shared.select("key", "id", "size", "pos", F.col("lead.id").alias("lead_id"))
        .join(groups, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    mixed = member_rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    # what isn't in the list's own least group is compared with every other group's members, once per pair
    rest = stage(member_rows.join(mixed.select("key", "low"), "key").join(known, ["lead_id", "id"], "left"), "rest")
    x = rest.where("component <> low").select(*[F.col(c).alias(f"x_{c}") for c in rest.columns])
    y = rest.select(*[F.col(c).alias(f"y_{c}") for c in rest.columns])
    place = (F.col("x_pos"), F.col("y_pos")) if positional else (None, None)
    same_lead = F.col("x_lead_id") == F.col("y_lead_id")
    common = F.least("x_has", "y_has") + F.least(F.col("x_exact") - F.col("x_has"), F.col("y_exact") - F.col("y_has"))
    open_pairs = x.join(
        y,
        (F.col("x_key") == F.col("y_key"))
        & (F.col("x_component") != F.col("y_component"))
        & ((F.col("y_component") == F.col("y_low")) | (F.col("x_id") < F.col("y_id")))
        & _possible(F.col("x_size"), F.col("y_size"), *place)
        & F.coalesce(F.least("x_exact", "y_exact") * BELOW >= F.greatest("x_exact", "y_exact") * ABOVE, F.lit(True))
        & (F.col("x_id") != F.col("y_lead_id"))  # a leader is compared with its list already
        & (F.col("y_id") != F.col("x_lead_id"))
        & ~F.coalesce(same_lead & (common * (ABOVE + BELOW) < (F.col("x_exact") + F.col("y_exact")) * ABOVE), F.lit(False))
        & ~F.coalesce(same_lead & _apart(bits // 64, both_ways), F.lit(False))
        & F.forall(F.array("x_id"), lambda x: x.isNotNull()),  # always true; see _apart
    ).select(
        F.least("x_id", "y_id").alias("a"),
        F.greatest("x_id", "y_id").alias("b"),
        F.when(F.col("x_id") < F.col("y_id"), F.col("x_size")).otherwise(F.col("y_size")).alias("n_a"),
        F.when(F.col("x_id") < F.col("y_id"), F.col("y_size")).otherwise(F.col("x_size")).alias("n_b"),
    ).distinct()
    done = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # written first: few as a rule, and then their texts are found without shuffling all texts again
    left = stage(open_pairs.join(done, ["a", "b"], "left_anti"), "open")
    late = stage(verify(left, False).where(_is_link()).select("a", "b"), "late")
    if late.isEmpty():
        return groups
    return _merged(groups, late)


def _merged(groups: DataFrame, late: DataFrame) -> DataFrame:
    """``groups`` (id, component) with the links ``late`` added: only the components they touch are joined anew."""
    name = lambda end: F.coalesce(f"component_{end}", end).alias(end)
    for end in "ab":
        late = late.join(groups.toDF(end, f"component_{end}"), end, "left")
    ends = stage(late.select(name("a"), name("b"), F.col("a").alias("id_a"), F.col("b").alias("id_b"), "component_a", "component_b"), "late-ends")
    merged = components(ends.select("a", "b")).toDF("component", "least")
    alone = [ends.where(f"component_{e} is null").select(F.col(f"id_{e}").alias("id"), F.col(f"id_{e}").alias("component")) for e in "ab"]
    every = groups.union(alone[0].union(alone[1]).distinct())
    # a component's least id may be that of another now: both names are ids, so the least of them is the name
    return stage(every.join(merged, "component", "left").select("id", F.coalesce("least", "component").alias("component")), "components")


def _apart(words: int, both_ways: bool) -> Column:
    """Two members can't be a link if what both have of their leader, and what their marks outside it leave, is too little.

    Every mark only one of them has is at least one element that isn't shared; so is every mark of the leader's elements
    that only one of them lacks. The test is long: as part of one generated method for a whole stage the JVM would never compile
    it. A lambda in the same join condition keeps the join out of whole-stage code, so that the test is split into small methods.
    """

    def only(first: int) -> tuple[Column, Column]:
        marks = [(F.get("x_marks", F.lit(i)), F.get("y_marks", F.lit(i))) for i in range(first, first + words)]
        return tuple(
            reduce(Column.__add__, [F.bit_count(p.bitwiseAND(F.bitwise_not(q))) for p, q in pairs]) for pairs in (marks, [(y, x) for x, y in marks])
        )

    only_x, only_y = only(0)
    lost_x, lost_y = only(words) if both_ways else (F.lit(0), F.lit(0))
    inside = F.least(F.col("x_has") - lost_y, F.col("y_has") - lost_x)
    outside = F.least(F.col("x_exact") - F.col("x_has") - only_x, F.col("y_exact") - F.col("y_has") - only_y)
    return (inside + outside) * (ABOVE + BELOW) < (F.col("x_exact") + F.col("y_exact")) * ABOVE


def marks(hashes: np.ndarray, bits: int = MARKS) -> list[int]:
    """A bit for each of ``bits`` hash ranges in which a set has an element, as signed longs."""
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.int64).tolist()


def marks_both_ways(outside: np.ndarray, outside_rows: np.ndarray, lost: np.ndarray, lost_rows: np.ndarray, n_rows: int, bits: int = MARKS) -> pa.Array:
    """``marks`` of what each row has beside its leader, followed by those of what it lacks of its leader."""
    flags = np.zeros((n_rows, 2 * bits), dtype=np.uint8)
    flags[outside_rows, (outside & np.uint64(bits - 1)).astype(np.int64)] = 1
    flags[lost_rows, (lost & np.uint64(bits - 1)).astype(np.int64) + bits] = 1
    longs = np.packbits(flags, axis=1).view(np.int64)
    return pa.ListArray.from_arrays(np.arange(n_rows + 1, dtype=np.int32) * longs.shape[1], longs.reshape(-1))


def _is_link() -> Column:
    return F.col("shared") * (ABOVE + BELOW) >= (F.col("n_a") + F.col("n_b")) * ABOVE
