"""Exact centroid clustering of integer vectors, searched through a vantage-point tree.

Each round builds a tree over the centroids on the driver and broadcasts it; its
size is that of the centroids, whatever the table holds. A node keeps one centroid
as its vantage point and, for either half of the others, the least and the greatest
distance to it; a leaf keeps a few centroids. A vector goes through the tree best
first: it always opens the node with the smallest lower bound of its own, by the
triangle inequality, and stops when that bound exceeds its best distance. A bound
equal to the best distance is still opened, since a centroid with a smaller number
may be as near. The vectors of a batch take their steps together; each has a
frontier of its own.

Bounds are floating-point numbers with room for rounding, and only decide what is
opened. Squared distances are integers, compared exactly, then by number. New
centroids are floors of exact sums, added up per task first, then per cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm.common import written
from keysieve.llm.topk import SCALE, quantised

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SALT = "2:"
LEAF = 4
BATCH_ROWS = 16_384
#: Room for rounding in bounds, as a share of the distances that enter them.
ROOM = 1e-9


@dataclass(frozen=True)
class Clustering:
    """``(id, cluster, distance)`` of every vector, and the final centroids in order of their numbers."""

    assigned: DataFrame
    centroids: list[list[int]]


def exact_type(magnitude: int, dimensions: int) -> type:
    """The cheapest number type in which squares, products and their sums are exact."""
    bound = 4 * dimensions * max(magnitude, 1) ** 2
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, as exact integers."""
    kind = exact_type(max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0))), a.shape[1])
    a, b = a.astype(kind), b.astype(kind)
    if kind is np.int64:  # differences first: squares of single components may not fit
        return np.stack([((a - one) ** 2).sum(axis=1) for one in b], axis=1)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


class VantageTree:
    """Nodes in plain arrays, so that the tree is broadcast as data.

    ``members[n]`` are the centroids that node n itself holds: its vantage point, or
    all of a leaf. ``children[n]`` are ``(node, least, greatest)``, distances of what
    is below to the vantage point.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.members: list[np.ndarray] = []
        self.children: list[list[tuple[int, float, float]]] = []
        if len(centroids):
            self.between = np.sqrt(squared(centroids, centroids).astype(np.float64))
            self.add(np.arange(len(centroids)))
            del self.between

    def add(self, numbers: np.ndarray) -> int:
        """A node over these centroids, and the nodes below it."""
        node = len(self.members)
        self.members.append(numbers)
        self.children.append([])
        if len(numbers) <= LEAF:
            return node
        apart = self.between[np.ix_(numbers, numbers)]
        vantage = int(np.argmax(apart.var(axis=1)))  # the one that tells the others apart best
        others, away = np.delete(numbers, vantage), np.delete(apart[vantage], vantage)
        near = away <= np.median(away)
        if near.all():  # all at one distance or in a shell: no half would be left out
            return node
        self.members[node] = numbers[vantage : vantage + 1]
        for half in (near, ~near):
            self.children[node].append((self.add(others[half]), float(away[half].min()), float(away[half].max())))
        return node

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid and squared distance of each row, and how many distances were taken."""
        n, nodes = len(rows), len(self.members)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, -1)
        bounds = np.full((n, nodes), np.inf)
        bounds[:, 0] = 0.0
        open_ = np.arange(n)
        taken = 0
        while len(open_):
            frontier = bounds[open_]
            chosen = np.argmin(frontier, axis=1)
            least = frontier[np.arange(len(open_)), chosen]
            going = least <= np.sqrt(best[open_].astype(np.float64))  # inclusive: ties are opened
            open_, chosen = open_[going], chosen[going]
            order = np.argsort(chosen, kind="stable")
            starts = np.flatnonzero(np.diff(chosen[order], prepend=-1))
            for at in np.split(order, starts[1:]) if len(order) else ():
                node, who = int(chosen[at[0]]), open_[at]
                members = self.members[node]
                distances = squared(rows[who], self.centroids[members])
                taken += distances.size
                first = np.argmin(distances, axis=1)  # the first of equals: members ascend
                found, name = distances[np.arange(len(who)), first], members[first]
                closer = (found < best[who]) | ((found == best[who]) & (name < number[who]))
                best[who[closer]], number[who[closer]] = found[closer], name[closer]
                bounds[who, node] = np.inf
                if self.children[node]:
                    away = np.sqrt(distances[:, 0].astype(np.float64))
                    for child, low, high in self.children[node]:
                        bound = np.maximum(np.maximum(away - high, low - away), 0.0)
                        bounds[who, child] = np.maximum(bound - ROOM * (1.0 + away + high), 0.0)
        return number, best, taken


def largest(dimensions: int) -> int:
    """The greatest component, either sign, for which every squared distance fits in 63 bits."""
    return math.isqrt((1 << 62) // (4 * dimensions))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions)


def found_in(batches: Iterator[pa.RecordBatch], tree: VantageTree, dimensions: int, place: int):
    """Each batch in parts of bounded size, with its vectors, their clusters and distances."""
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH_ROWS):
            batch = whole.slice(start, BATCH_ROWS)
            rows = matrix(batch.column(place), dimensions)
            number, distance, _ = tree.nearest(rows)
            yield batch, rows, number, distance


def sums_per_task(tree_data, dimensions: int):
    """An Arrow function that gives one row per cluster met in the task: count, and sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = VantageTree(tree_data.value)
        sums = np.zeros((len(tree.centroids), dimensions), dtype=np.int64)
        counts = np.zeros(len(tree.centroids), dtype=np.int64)
        for _, rows, number, _ in found_in(batches, tree, dimensions, 0):
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            sums[number[order][starts]] += np.add.reduceat(rows[order], starts, axis=0)
            counts += np.bincount(number, minlength=len(counts))
        met = np.flatnonzero(counts)
        if len(met):
            arrays = [pa.array(met, pa.int32()), pa.array(counts[met], pa.int64()), pa.array(list(sums[met]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["cluster", "n", "sums"])

    return run


def assignment(tree_data, dimensions: int, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = VantageTree(tree_data.value)
        for batch, _, number, distance in found_in(batches, tree, dimensions, 1):
            arrays = [batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [id_name, "cluster", "distance"])

    return run


def integer_vectors(frame: DataFrame, vec_id: str, embedding: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``(id, v)`` of the rows whose vector has so many components, none null or not finite.

    A component beyond ``largest`` ends the job: distances would not fit into a long.
    """
    rows = frame.select(F.col(vec_id).alias("id"), quantised(F.col(embedding), scale).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") == dimensions))
    limit = largest(dimensions)
    beyond = F.exists("v", lambda x: (x > limit) | (x < -limit))
    too_large = F.raise_error(F.lit(f"a component is beyond {limit}: squared distances would not fit"))
    return rows.select("id", F.when(beyond, too_large.cast("array<bigint>")).otherwise(F.col("v")).alias("v"))


def drawn(vector_id: Column, salt: str) -> Column:
    """What the first centroids are chosen by; a null id counts as empty."""
    return F.sha2(F.concat(F.lit(salt), F.coalesce(vector_id.cast("string"), F.lit(""))).cast("binary"), 256)


def next_centroids(vectors: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """Floors of the means of the clusters; a cluster without vectors keeps its centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.array(centroids, dtype=np.int64))
    partial = vectors.select("v").mapInArrow(sums_per_task(shared, dimensions), "cluster int, n long, sums array<long>")
    total = (
        partial.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    )
    moved = [list(one) for one in centroids]
    for row in total.collect():  # clusters times dimensions
        moved[row.cluster][row.place] = int(row.total) // row.n
    shared.unpersist()
    return moved


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, salt: str = SALT
) -> Clustering:
    """Clusters of ``(id, v array<long>)``, each vector with so many components within ``largest``.

    The first centroids are the k vectors whose ids have the smallest hashes, the
    smaller vector first where ids repeat; all vectors, if there are fewer than k.
    Each round assigns every vector to the nearest centroid, the smaller number at
    equal distance, and moves each centroid to the floor of its vectors' mean; one
    without vectors stays. Then vectors are assigned once more. Rows with a null id
    and repeated rows are vectors like any other. Without vectors there are no
    centroids and no rows. The vectors are written once and read by every round.
    """
    if k < 1 or rounds < 0 or dimensions < 1:
        raise ValueError("at least one cluster, no negative number of rounds, and at least one dimension")
    vectors = written(vectors.select("id", "v"), "vectors")
    first = vectors.orderBy(drawn(F.col("id"), salt), "v").limit(k).select("v").collect()
    centroids = [list(row.v) for row in first]
    for _ in range(rounds if centroids else 0):
        moved = next_centroids(vectors, centroids, dimensions)
        if moved == centroids:  # further rounds would change nothing
            break
        centroids = moved
    shared = vectors.sparkSession.sparkContext.broadcast(np.array(centroids, dtype=np.int64).reshape(-1, dimensions))
    schema = T.StructType([vectors.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return Clustering(vectors.mapInArrow(assignment(shared, dimensions, "id"), schema), centroids)


def digests(found: Clustering, vec_id: str = "vec_id") -> DataFrame:
    """Every vector with the inertia of its cluster and of all, and a hash of its centroid."""
    assigned = written(found.assigned, "clusters")
    spark = assigned.sparkSession
    sums = {row.cluster: row.s for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [
        (n, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, one)).encode()).hexdigest())
        for n, one in enumerate(found.centroids)
        if n in sums
    ]
    clusters = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.withColumnRenamed("id", vec_id).join(F.broadcast(clusters), "cluster").select(
        vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
