"""Exact top-k by inner product without random access: sorted lists, bounds, early stop, final scores.

Vectors are dealt into shards. A shard has, for each component, its entries sorted by value; a query reads a component's
list from the end that its own sign favours, all lists to the same depth. What is read gives a candidate's lower bound
(unread entries at the far end of their list) and upper bound (unread entries at the depth reached). Reading stops when no
candidate outside the best ``k`` lower bounds, or outside what earlier shards hold already, has an upper bound as high;
only then are the scores of those left resolved, exactly, in 64-bit integers. Queries come in blocks of bounded size.

Components are floor(scale * x) as integers. Vectors that are null, hold a null or a value that isn't finite,
and rows without vec_id, take no part. A component that doesn't fit 64 bits after scaling fails the query, and so does a
score of a candidate that is resolved; scores that might not fit are summed in Python's integers. Vectors are compared with
queries of as many components. Rows with a query's vec_id are its own. A repeated query row gives its rows again. Ties
go to the smaller vec_id; a query with fewer candidates than k gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 4096
QUERY_BLOCK = 4096
_TOGETHER = 256
#: Shares of a list after which the bounds are looked at
DEPTHS = (0.25, 0.5, 0.75, 1.0)
LONG = 2**63


class Lists:
    """Sorted lists of one shard, as ranks of its entries from either end."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.rising = np.take_along_axis(vectors, order, axis=0)
        self.from_low = np.empty_like(order)
        np.put_along_axis(self.from_low, order, np.arange(len(ids))[:, None], axis=0)

    def read(self, depth: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Entries as known at a depth, with unread ones at their highest and lowest: high lists beside low lists."""
        m = len(self.ids)
        low, high = self.from_low < depth, self.from_low >= m - depth
        best = np.hstack([np.where(high, self.vectors, self.rising[m - depth]), np.where(low, self.vectors, self.rising[depth - 1])])
        worst = np.hstack([np.where(high, self.vectors, self.rising[0]), np.where(low, self.vectors, self.rising[-1])])
        return best.astype(kind), worst.astype(kind)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.query, self.ids, self.scores = k, *(np.empty(0, dtype=np.int64) for _ in range(3))
        self.floor = np.full(n, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]
        full = place[keep] == self.k - 1
        self.floor[self.query[full]] = self.scores[full]


def search(lists: Lists, ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    m, k = len(lists.ids), best.k
    largest = float(np.abs(queries.astype(np.float64)).sum(axis=1).max(initial=0)) * float(np.abs(lists.vectors.astype(np.float64)).max(initial=0))
    kind = np.float32 if largest < 2**24 else np.float64
    slack = largest * 1e-12 if largest >= 2**53 else 0.0  # float64 is exact below
    known = {}
    for at in range(0, len(ids), _TOGETHER):
        rows = slice(at, at + _TOGETHER)
        sides = np.hstack([np.maximum(queries[rows], 0), np.minimum(queries[rows], 0)]).astype(kind)
        own = ids[rows, None] == lists.ids[None, :]
        for share in DEPTHS:
            depth = max(1, int(np.ceil(share * m)))
            if depth not in known:
                known[depth] = lists.read(depth, kind)
            upper, lower = (sides @ side.T for side in known[depth])
            upper[own] = lower[own] = -np.inf
            floor = best.floor[rows]
            if m > k:
                floor = np.maximum(floor, np.partition(lower, m - k, axis=1)[:, m - k])
            open_ = (upper >= (floor - slack)[:, None]) & ~own
            if open_.sum() <= 4 * k * len(sides):
                break  # no outsider can qualify, and few are left
        query, candidate = np.nonzero(open_)
        scores = np.concatenate(
            [np.empty(0, dtype=np.int64)]
            + [_scores(queries[at + query[i : i + 100_000]], lists.vectors[candidate[i : i + 100_000]], largest) for i in range(0, len(query), 100_000)]
        )
        best.add(query + at, lists.ids[candidate], scores)


def _scores(queries: np.ndarray, vectors: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of rows; fails if one doesn't fit 64 bits."""
    if largest < LONG / 2:
        return (queries * vectors).sum(axis=1)
    exact = [sum(int(x) * int(y) for x, y in zip(q, v, strict=True)) for q, v in zip(queries, vectors, strict=True)]
    if any(abs(x) >= LONG for x in exact):
        raise OverflowError("a score doesn't fit 64 bits: scale the vectors down")
    return np.array(exact, dtype=np.int64)


def _integers(embedding: str, scale: int) -> Column:
    fail = F.raise_error(F.lit("a component doesn't fit 64 bits: scale the vectors down")).cast("long")

    def integer(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < float(LONG), F.floor(scaled)).otherwise(fail)

    return F.transform(embedding, integer)


def _usable(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) with ``is_query``: query_id, rank from 1, vec_id, score."""
    usable = vectors.where(F.col("vec_id").isNotNull() & _usable("embedding"))
    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), _integers("embedding", scale).alias("vector"))
    asked = usable.where(is_query)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        rows = sorted((r["vec_id"], tuple(r["vector"])) for r in mine.collect())
        part = usable.mapInArrow(_searcher(rows, k), "query_row long, query_id long, vec_id long, score long").withColumn("block", F.lit(block))
        found = part if found is None else found.union(part)
    order = Window.partitionBy("block", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(rows: list[tuple[int, tuple]], k: int):
    sizes = sorted({len(v) for _, v in rows})
    groups = {d: np.array([i for i, (_, v) in enumerate(rows) if len(v) == d], dtype=np.int64) for d in sizes}
    ids = {d: np.array([rows[i][0] for i in g], dtype=np.int64) for d, g in groups.items()}
    queries = {d: np.array([rows[i][1] for i in g], dtype=np.int64).reshape(len(g), d) for d, g in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(len(g), k) for d, g in groups.items()}
        waiting: dict[int, list] = {d: [] for d in groups}

        def flush(d: int) -> None:
            if waiting[d]:
                found = [np.concatenate(x) for x in zip(*waiting[d], strict=True)]
                waiting[d].clear()
                for i in range(0, len(found[0]), SHARD):
                    search(Lists(found[0][i : i + SHARD], found[1][i : i + SHARD]), ids[d], queries[d], best[d])

        for batch in batches:
            column, names = batch.column(1), batch.column(0).to_numpy()
            lengths, offsets = np.diff(column.offsets.to_numpy()), column.offsets.to_numpy()
            values = column.values.to_numpy()
            for d in groups:
                chosen = np.flatnonzero(lengths == d)
                if len(chosen):
                    at = offsets[:-1][chosen][:, None] + np.arange(d)
                    waiting[d].append((names[chosen], values[at].reshape(len(chosen), d)))
                    if sum(len(x[0]) for x in waiting[d]) >= SHARD:
                        flush(d)
        for d, g in groups.items():
            flush(d)
            b = best[d]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[b.query]), pa.array(ids[d][b.query]), pa.array(b.ids), pa.array(b.scores)], ["query_row", "query_id", "vec_id", "score"]
            )

    return run
