"""Clustering of integer vectors around centroids that a vantage-point tree searches.

Each round builds a vantage-point tree over the centroids and broadcasts both. A tree node holds one centroid, its vantage
point, and the centroids below it are split at their median distance from it; each child knows the least and the
greatest of these distances. A vector searches best first: of the nodes it knows it opens the one whose lower bound is least, and it stops when
that bound exceeds its best distance. Bounds are inclusive and widened by more than
their rounding, and distances at the nodes are exact integers, so ties go to the smaller number as in a full comparison.

All vectors of a batch search together, each with its own frontier: a step opens one node for every vector that has not
stopped. The tasks return sums per centroid, so a centroid with a third of all vectors costs its rows and not
a group; the driver sees (centroids x components) sums a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.llm.common import stored

#: Numbers of a batch's frontiers (vectors x nodes) held at once.
FRONTIER = 1 << 21


@dataclass
class Tree:
    """Node ``i`` has vantage point ``point[i]``, children ``child[i]`` (-1: none) and, of their points, the distances ``ring[i, side]``."""

    vectors: np.ndarray
    point: np.ndarray
    child: np.ndarray
    ring: np.ndarray


def vantage_tree(centroids: np.ndarray) -> Tree:
    """The vantage point of a node is, of its centroids, the one farthest from their parent's vantage point (ties: the smaller number)."""
    point, child, ring = [], [], []

    def build(members: np.ndarray, away: np.ndarray) -> int:
        node, vantage = len(point), members[np.lexsort((members, -away))[0]]
        rest = members[members != vantage]
        far = _roots(centroids[rest], centroids[vantage])
        point.append(vantage)
        child.append([-1, -1])
        ring.append([[np.inf, -np.inf]] * 2)
        cut = np.argsort(far, kind="stable")
        for side, at in enumerate((cut[: (len(cut) + 1) // 2], cut[(len(cut) + 1) // 2 :])):
            if len(at):
                child[node][side] = build(rest[at], far[at])
                ring[node] = [*ring[node][:side], [far[at].min(), far[at].max()], *ring[node][side + 1 :]]
        return node

    if len(centroids):
        build(np.arange(len(centroids)), np.zeros(len(centroids)))
    return Tree(centroids, np.array(point, dtype=np.int64), np.array(child, dtype=np.int64).reshape(-1, 2), np.array(ring, dtype=float).reshape(-1, 2, 2))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def _roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_squares(a, np.broadcast_to(b, a.shape)).astype(float))


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each vector, and how many distances were computed."""
    n, nodes, opened = len(vectors), len(tree.point), 0
    bound = np.full((n, nodes), np.inf)
    bound[:, 0] = 0
    best, cluster = np.full(n, np.iinfo(np.int64).max), np.full(n, nodes, dtype=np.int64)
    active = np.arange(n)
    while len(active):
        node = bound[active].argmin(axis=1)
        going = bound[active, node] <= np.sqrt(best[active].astype(float)) * (1 + 1e-12)
        active, node = active[going], node[going]
        if not len(active):
            break
        bound[active, node] = np.inf
        opened += len(active)
        centroid = tree.point[node]
        square = _squares(vectors[active], tree.vectors[centroid])
        better = (square < best[active]) | ((square == best[active]) & (centroid < cluster[active]))
        best[active[better]], cluster[active[better]] = square[better], centroid[better]
        far = np.sqrt(square.astype(float))
        for side in (0, 1):
            below = tree.child[node, side]
            has = below >= 0
            low, high = tree.ring[node[has], side].T
            least = np.maximum(np.maximum(far[has] - high, low - far[has]), 0)
            slack = 1e-12 * (far[has] + high)
            bound[active[has], below[has]] = np.maximum(least - slack, 0)
    return cluster, best, opened


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _searched(tree: Tree, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    step = max(1, FRONTIER // len(tree.point))
    for at in range(0, len(vectors), step):
        cluster, square, _ = nearest(tree, vectors[at : at + step])
        yield at, cluster, square


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of ``vectors`` (vec_id, v) as (vec_id, cluster, distance)."""
    shared = vectors.sparkSession.sparkContext.broadcast(vantage_tree(centroids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_searched(shared.value, _matrix(batch.column(1), shared.value.vectors.shape[1])))
            if found:
                cluster, square = (np.concatenate([f[k] for f in found]) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(square)], names=["vec_id", "cluster", "distance"])

    schema = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).schema
    return vectors.mapInArrow(search, schema)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; those without vectors stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(vantage_tree(centroids))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shared.value.vectors.shape, dtype=np.int64), np.zeros(len(shared.value.vectors), dtype=np.int64)
        for batch in batches:
            v = _matrix(batch.column(1), total.shape[1])
            for at, cluster, _ in _searched(shared.value, v):
                np.add.at(total, cluster, v[at : at + len(cluster)])
                count += np.bincount(cluster, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "n", "v"])

    parts = vectors.mapInArrow(sums, "cluster int, n bigint, v array<bigint>").select("cluster", "n", F.posexplode("v").alias("at", "x"))
    exact = parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    after = centroids.copy()
    for r in exact.collect():  # centroids x components
        after[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return after


def whole_numbers(vectors: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of vectors with ``dims`` components, none null or non-finite; the others are left out.

    Raises where a squared distance or a sum of them within a task could leave 63 bits.
    """
    v = F.col(vector).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = vectors.filter(v.isNotNull() & (F.size(v) == dims)).filter(finite)
    limit = int((2**62 / dims) ** 0.5) // 2
    scaled = F.transform(v, lambda x: F.floor(F.when(F.abs(x * scale) < limit, x * scale)))
    rows = stored(kept.select(F.col(vec_id).alias("vec_id"), scaled.alias("v")), "whole-vectors")
    if not rows.filter(F.exists("v", lambda x: x.isNull())).isEmpty():
        raise ValueError(f"components have to be under {limit} after scaling, so that squared distances fit 63 bits")
    return rows


def first_centroids(rows: DataFrame, k: int, dims: int, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors (all, if fewer) with the smallest sha256 of ``seed:vec_id``; equal ids by components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in chosen], dtype=np.int64).reshape(len(chosen), dims)


def _digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, centroid.

    Left out: null vectors, other lengths, null and non-finite components. Repeated rows and ids keep their
    rows; a null id stays null. Fewer than ``k`` vectors make fewer centroids, equal ones included (the greater numbers stay empty);
    an empty table gives an empty table; other columns are ignored whatever their names.
    """
    rows = whole_numbers(vectors, dims, scale, vec_id, vector)
    centroids = first_centroids(rows, k, dims, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids)
    if not len(centroids):
        centroids = np.zeros((1, dims), dtype=np.int64)  # nothing will be assigned to it
    assigned = stored(assign(rows, centroids), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {r["cluster"]: int(r["s"]) for r in sums.collect()}  # a row per centroid
    totals = [(k, inertia[k], sum(inertia.values()), _digest(c), c) for k, c in enumerate(centroids.tolist()) if k in inertia]
    totals = vectors.sparkSession.createDataFrame(totals, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    return assigned.join(totals, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
