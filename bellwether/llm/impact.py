"""Exact top-k by inner product: an impact-ordered index, processed score at a time.

Every component of a vector is a posting under its dimension and sign, with its size
quantised into impact levels. Postings of equal impact form a segment. For a query the segments
of a block are processed by descending possible contribution. The running estimates carry a proven
error: half a level for what was processed, the largest open level of the dimension for what
was not. Vectors that this error cannot separate from the k-th best estimate are the possible
members; processing stops once they are few, and only they are rescored exactly. Nothing is
left out without that proof.

Vectors are dealt into blocks and queries into chunks; each pair of a block and a chunk is one
group, which returns k rows a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
CHUNK = 4096
SHIFT = 6


class ImpactIndex:
    """Segments of one block: for each (dimension, sign, level) the numbers of its vectors."""

    def __init__(self, vectors: np.ndarray, shift: int = SHIFT):
        self.vectors, self.shift = vectors, shift
        n, d = vectors.shape
        level = np.abs(vectors) >> shift
        flat = np.arange(d)[None, :] * 2 + (vectors < 0)
        key = flat * (level.max(initial=0) + 1) + level
        order = np.argsort(key, axis=None, kind="stable")
        keys = key.ravel()[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.zeros(0, dtype=np.int64)
        at = order[first]
        self.dim = flat.ravel()[at] // 2
        self.sign = 1 - 2 * (flat.ravel()[at] % 2)
        self.level = level.ravel()[at]
        self.members = np.split(order // max(d, 1), first[1:]) if keys.size else []

    def search(self, query: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and exact scores of the k best vectors other than ``own``; ties to the smaller id."""
        n = len(self.vectors)
        half = 1 << self.shift >> 1
        size = np.abs(query)
        most = size[self.dim] * ((self.level + 1) << self.shift)
        turn = np.argsort(-most, kind="stable")
        turn = turn[most[turn] > 0]
        # per dimension the turn's levels descend within a sign, so what is open there is bounded by its next segment
        estimate = np.zeros(n, dtype=np.int64)
        gain = query[self.dim] * self.sign * ((self.level << self.shift) + half)
        open_bound = np.zeros(len(query), dtype=np.int64)
        np.maximum.at(open_bound, self.dim, most)
        possible = np.flatnonzero(~own)
        step, done = max(1, len(turn) // 8), 0
        while len(possible) > max(8 * k, n // 64) and done < len(turn):
            for s in turn[done : done + step]:
                estimate[self.members[s]] += gain[s]
            done = min(done + step, len(turn))
            open_bound[:] = 0
            rest = turn[done:]
            np.maximum.at(open_bound, self.dim[rest], most[rest])
            error = int(np.maximum(open_bound, size * half).sum())
            if len(possible) > k:
                now = estimate[possible]
                kth = np.partition(now, len(now) - k)[len(now) - k]
                possible = possible[now + error >= kth - error]
        scores = self.vectors[possible] @ query
        best = np.lexsort((ids[possible], -scores))[:k]
        return possible[best], scores[best]


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x taken as double; null if there is a null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024,
          block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors by integer inner product.

    Rows with a null key, a null vector or a null or non-finite component take no part. Rows that share a key all
    count, as candidates of other keys and as queries, whose candidates then compete for the k ranks of the key; equal
    rows count as often as they occur. A shorter vector counts as padded with zeros. Ties go to the smaller key. Fewer than k
    candidates give fewer rows, an empty table none. Other columns are ignored. A table whose scores might not fit
    63 bits raises ValueError.
    """
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("q"))
    # equal rows are one row with counts, so copies cannot fill a block or a chunk
    rows = rows.filter(F.col("v").isNotNull()).groupBy("id", "v").agg(F.count("*").alias("n"), F.count_if("q").alias("m"))
    size = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    n, queries, width, most, asked = rows.agg(F.count("*"), F.count_if(F.col("m") > 0), F.max(F.size("v")), F.max(size), F.max(F.when(F.col("m") > 0, size))).first()
    # estimates and their errors reach four times the largest score of the widened components
    if queries and 4 * (width or 1) * (asked or 0) * ((most or 0) + 2 * (1 << SHIFT)) >= 2.0**63:
        raise ValueError("scores might not fit 63 bits: scale the components down")
    blocks, chunks = -(-max(n, 1) // block), -(-max(queries, 1) // chunk)
    hashed = F.xxhash64("id", "v")
    near = rows.withColumn("b", F.pmod(hashed, F.lit(blocks))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asks = rows.filter("m > 0").withColumn("c", F.pmod(hashed, F.lit(chunks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            width = max(left["v"].map(len).max(), right["v"].map(len).max())
            ids, copies, index = left["id"].to_numpy(), left["n"].to_numpy(), ImpactIndex(_matrix(left["v"], width))
            for query, asked, q in zip(right["id"], right["m"], _matrix(right["v"], width), strict=True):
                at, scores = index.search(q, k, ids == query, ids)
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "score": scores, "times": np.minimum(copies[at], k) * min(asked, k)}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "times": []}, dtype="int64")

    best = near.select("b", "c", "id", "v", "n").groupBy("b", "c").cogroup(asks.select("b", "c", "id", "v", "m").groupBy("b", "c"))
    best = best.applyInPandas(search, "query_id bigint, vec_id bigint, score bigint, times bigint")
    best = best.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
