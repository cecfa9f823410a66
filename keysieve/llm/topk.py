"""Exact top-k inner products by the threshold algorithm.

Vectors are dealt into blocks by a number of their row. A block keeps one list per
dimension, sorted by that component. A query reads all lists at the same depth,
from the top where its own component is positive and from the bottom where it is
negative; each id met for the first time is scored in full. The products of the
query with the values at the depth reached add up to a bound on every row not met
yet. Reading stops when the k-th best score is above that bound: a row not met can
then neither beat nor tie it. A query's best rows of all blocks are then merged.

Queries are dealt into groups as well, so that a task holds one block of rows and
one group of queries, whatever the size of the table. Both are repeated once per
counterpart; no pair of a query and a row leaves a task unless it is in a block's
best k.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 256
BLOCK_ROWS = 65_536
GROUP_QUERIES = 16_384
LEAST_BLOCKS = 16
FIRST_DEPTH = 64


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Each component x as floor(scale * x), x as double; null if any is null or not finite."""
    bad = F.exists(vector, lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when(vector.isNotNull() & ~bad, whole)


class SortedLists:
    """A block's rows, and for each dimension their places in ascending order of the component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.rows, self.order, axis=0)

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places and scores of the k best rows other than the query's own, best first."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        if not len(used):  # every row scores 0
            places = np.flatnonzero(self.ids != own)[:k]
            return places, np.zeros(len(places), dtype=np.int64)
        weights = query[used]
        rising = weights > 0
        seen = self.ids == own
        places = np.zeros(0, dtype=np.int64)
        scores = np.zeros(0, dtype=np.int64)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            end = min(n, depth + step)
            low = self.order[depth:end, used[~rising]]
            high = self.order[n - end : n - depth, used[rising]]
            fresh = np.zeros(n, dtype=bool)
            fresh[low.ravel()] = True
            fresh[high.ravel()] = True
            fresh &= ~seen
            seen |= fresh
            met = np.flatnonzero(fresh)
            if len(met):
                found = np.rint(self.rows[met] @ query).astype(np.int64) if self.rows.dtype.kind == "f" else self.rows[met] @ query
                if len(places) == k:
                    better = found >= scores[-1]
                    met, found = met[better], found[better]
                if len(met) > 4 * k:
                    cut = np.partition(found, len(found) - k)[len(found) - k]
                    met, found = met[found >= cut], found[found >= cut]
                places, scores = np.concatenate((places, met)), np.concatenate((scores, found))
                first = np.lexsort((places, -scores))[:k]  # places ascend with ids
                places, scores = places[first], scores[first]
            depth, step = end, step * 2
            if len(places) == k:
                at_depth = self.values[depth - 1, used] * ~rising + self.values[n - depth, used] * rising
                if scores[-1] > float(at_depth @ weights):
                    break
        return places, scores


def exact_type(rows: np.ndarray, queries: np.ndarray) -> type:
    """The cheapest number type in which all inner products are exact."""
    if not rows.size or not queries.size:
        return np.float64
    bound = float(np.abs(rows).max()) * float(np.abs(queries).max()) * rows.shape[1]
    return np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64


def block_best(k: int):
    """A function on one block of rows and one group of queries."""

    def run(key, rows, queries):
        import pandas as pd

        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            width = max(rows["v"].map(len).max(), queries["v"].map(len).max(), 1)

            def matrix(vectors):
                if (vectors.map(len) == width).all():
                    return np.array(vectors.tolist(), dtype=np.int64).reshape(len(vectors), width)
                return np.array([[*v, *[0] * (width - len(v))] for v in vectors], dtype=np.int64)

            own, wanted = matrix(rows["v"]), matrix(queries["v"])
            kind = exact_type(own, wanted)
            lists = SortedLists(rows["id"].to_numpy(np.int64), own.astype(kind))
            for query_id, query in zip(queries["id"].tolist(), wanted.astype(kind)):
                places, scores = lists.best(query_id, query, k)
                out["query_id"] += [query_id] * len(places)
                out["vec_id"] += lists.ids[places].tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype("int64")

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows with the highest inner products.

    Both frames hold ``(id long, v array<long>)``; rows with a null id or vector take
    no part. Rows that share an id are candidates each, and queries that share one
    are ranked together. A query's own id is no candidate. Ties go to the smaller
    id. A query that has fewer candidates gets all of them, one without
    any none. Shorter vectors count as filled up with zeros. Inner products must be
    within 63 bits.
    """
    vectors = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v")
    queries = queries.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v")
    n, m = vectors.count(), queries.count()
    blocks = max(LEAST_BLOCKS, math.ceil(n / block_rows))
    groups = max(1, math.ceil(m / GROUP_QUERIES))

    def dealt(name: str, parts: int):
        return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias(name)

    def each(name: str, parts: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias(name)

    cells = vectors.select("id", "v", dealt("block", blocks)).select("*", each("grp", groups))
    asked = queries.select("id", "v", dealt("grp", groups)).select("*", each("block", blocks))
    found = (
        cells.groupBy("block", "grp")
        .cogroup(asked.groupBy("block", "grp"))
        .applyInPandas(block_best(k), "query_id long, vec_id long, score long")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def usable(frame: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """``(id, v)`` of the rows with an id and a vector of finite numbers, repeated ids included."""
    rows = frame.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(embedding), scale).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())


def one_per_id(frame: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """``(id, v)`` of usable rows; of rows that share an id, the smallest vector counts."""
    return usable(frame, vec_id, embedding, scale).groupBy("id").agg(F.min("v").alias("v"))
