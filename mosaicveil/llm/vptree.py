"""Nearest neighbours by vantage-point trees, one tree a shard.

Every row is indexed: each task packs what it reads into shards of at most SHARD_ROWS vectors, and every shard gets a tree whose
nodes split their vectors at the median distance to a vantage point. Queries, far fewer than rows, travel: shards are dealt to lanes,
and each lane gets every query, in groups of about QUERY_BYTES; a task takes a group's queries from shard to shard of its lane, the
nearest found so far with them, so later trees are pruned the more. A subtree is left out when the triangle inequality puts it farther than ``factor`` times the k-th distance found
so far; factor 1 is exact, smaller factors visit less. Distances are Euclidean, summed in double precision by component.

Vectors that are null, zero or hold null, NaN or infinite components take no part, as rows or as queries; vectors are only
compared with those of the same length. Ties go to the smaller id. A query's own id is no candidate. Rows that repeat (same id and
vector) count once. An id with several vectors takes one place, at the least distance of any of its vectors from any of the query's.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions

SHARD_ROWS, BLOCK_ROWS, LEAF, FACTOR = 8192, 1024, 64, 1.0
QUERY_BYTES = 32 << 20
_PACK = "part long, group long, dims int, ids binary, data binary"


def _packs(most: int):
    """Rows (group, vec_id, vector) as packs of one group and length; part numbers them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n, held = 0, {}
        base = TaskContext.get().partitionId() << 32

        def pack(key: tuple[int, int]) -> pd.DataFrame:
            nonlocal n
            ids, data = zip(*held.pop(key))
            n += 1
            return pd.DataFrame({"part": [base + n], "group": [key[0]], "dims": [key[1]], "ids": [np.array(ids, np.int64).tobytes()], "data": [np.array(data, np.float64).tobytes()]})

        for frame in frames:
            for g, i, v in zip(frame["group"], frame["vec_id"], frame["vector"]):
                v = np.asarray(v, np.float64)
                if len(v) and np.isfinite(v).all() and v.any():
                    held.setdefault((g, len(v)), []).append((i, v))
                    if len(held[g, len(v)]) >= most:
                        yield pack((g, len(v)))
        for key in sorted(held):
            yield pack(key)

    return run


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of a from each row of b, squares added in the order of the components."""
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        total += gap * gap
    return np.sqrt(total)


class Tree:
    def __init__(self, ids: np.ndarray, data: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.data = ids[order], data[order]
        self.root = self._build(np.arange(len(ids)), leaf)

    def _build(self, rows: np.ndarray, leaf: int):
        if len(rows) <= leaf:
            return rows
        spread = [rows[0], rows[len(rows) // 2], rows[-1]]
        far = distances(self.data[spread], self.data[rows])
        best = int(np.argmax(far.var(1)))
        cut = float(np.median(far[best]))
        near = far[best] <= cut
        if near.all():
            return rows  # all as far: nothing to split
        return spread[best], cut, self._build(rows[near], leaf), self._build(rows[~near], leaf)

    def search(self, ids: np.ndarray, queries: np.ndarray, best: np.ndarray, who: np.ndarray, factor: float = FACTOR, repeats: bool = True) -> None:
        """Puts the nearest ids of this tree into best (distances) and who (ids), which hold the k found before for each query, nearest
        first, unused places infinite. repeats: an id may have several vectors, here or in what was found before."""
        k = best.shape[1]

        def visit(node, qs: np.ndarray) -> None:
            if not len(qs):
                return
            if isinstance(node, np.ndarray):
                for at in range(0, len(node), LEAF):
                    rows = node[at : at + LEAF]
                    found = distances(queries[qs], self.data[rows])
                    found[ids[qs][:, None] == self.ids[rows][None, :]] = np.inf
                    d = np.c_[best[qs], found]
                    w = np.c_[who[qs], np.broadcast_to(self.ids[rows], found.shape)]
                    if repeats:  # an id keeps its least distance only
                        order = np.lexsort((d, w))
                        d, w = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)
                        d[:, 1:][w[:, 1:] == w[:, :-1]] = np.inf
                    order = np.lexsort((w, d))[:, :k]
                    best[qs], who[qs] = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)
                    if repeats:  # an unused place has no id, lest it stand for one that comes nearer
                        who[qs] = np.where(np.isinf(best[qs]), np.iinfo(np.int64).max, who[qs])
                return
            point, cut, inner, outer = node
            d = distances(queries[qs], self.data[point : point + 1])[:, 0]
            inside = d <= cut
            visit(inner, qs[inside])
            visit(outer, qs[~inside])
            reach = best[qs, -1] * factor + 1e-9 * (1 + d)
            visit(outer, qs[inside & (d + reach >= cut)])
            visit(inner, qs[~inside & (d - reach <= cut)])

        visit(self.root, np.arange(len(ids)))


def nowhere(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unused places for n queries."""
    return np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)


def _searcher(k: int, factor: float, repeats: bool):
    """Rows of a lane and group: first the queries (shard 0), then the shards."""

    def told(asked: dict) -> Iterator[pd.DataFrame]:
        for state in asked.values():
            if isinstance(state, tuple):
                ids, _, best, who = state
                some = np.isfinite(best)
                yield pd.DataFrame({"query_id": np.repeat(ids, k)[some.ravel()], "vec_id": who[some], "score": best[some]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, asked = None, {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                if last != (r.lane, r.group):
                    yield from told(asked)
                    last, asked = (r.lane, r.group), {}
                ids, data = np.frombuffer(r.ids, np.int64), np.frombuffer(r.data).reshape(-1, r.dims)
                if not r.shard:
                    asked.setdefault(r.dims, []).append((ids, data))
                elif r.dims in asked:
                    state = asked[r.dims]
                    if not isinstance(state, tuple):
                        ids_, data_ = (np.concatenate(x) for x in zip(*state))
                        state = asked[r.dims] = (ids_, data_, *nowhere(len(ids_), k))
                    Tree(ids, data).search(*state, factor, repeats)
        yield from told(asked)

    return run


def nearest(vectors: DataFrame, is_query, k: int = 10, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that the column is_query marks, among all rows but itself."""
    marked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), is_query.alias("asks")).where("vec_id is not null and vector is not null")
    marked = marked.withColumn("vector", F.expr("case when not exists(vector, x -> x is null) then transform(vector, x -> double(x)) end")).where("vector is not null")
    marked = marked.groupBy("vec_id", "vector").agg(F.max("asks").alias("asks"))
    repeats = not marked.groupBy("vec_id").count().where("count > 1").isEmpty()
    shards = marked.select(F.lit(0).cast("long").alias("group"), "vec_id", "vector").mapInPandas(_packs(SHARD_ROWS), _PACK)
    asked = keep(marked.where("asks").select("vec_id", "vector"), "queries")
    size = asked.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0] * 8
    groups, lanes = max(1, -(-size // QUERY_BYTES)), partitions(vectors.sparkSession)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grouped = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups).cast("long")).alias("group"), "vec_id", "vector").repartition(groups, "group")
    packed = grouped.mapInPandas(_packs(BLOCK_ROWS), _PACK).select(every(lanes).alias("lane"), "group", F.lit(0).alias("shard"), "part", "dims", "ids", "data")
    # shards in turn, each packing task from a lane of its own on
    turn = F.pmod(F.expr("shiftright(part, 32) + (part & 4294967295)"), F.lit(lanes).cast("long"))
    dealt = shards.select(turn.alias("lane"), every(groups).alias("group"), F.lit(1).alias("shard"), "part", "dims", "ids", "data")
    rows = packed.unionByName(dealt).repartitionById(lanes * groups, (F.col("lane") * groups + F.col("group")).cast("int")).sortWithinPartitions("lane", "group", "shard", "part")
    found = rows.mapInPandas(_searcher(k, factor, repeats), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
