"""SimHash near-duplicates through a byte-position index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most ``d`` bits
differ in at most ``d`` bytes, so they share at least ``8 - d`` positional bytes: the
guaranteed minimum. Single positional bytes have only 2,048 posting lists, which grow with
the corpus; so the postings are kept under groups of three positions, all taken from the
first four or all from the last four bytes. Whichever five positions a pair shares, three of
them lie in one half, so every pair with the minimum meets in at least one of the eight lists.

Within a list the shared positional bytes are tallied per pair, pairs under the minimum are
dropped, and the rest verified on bits. Lists of more than ``tile`` fingerprints are split into
tiles that meet pair by pair in separate rows. A tile returns a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwether.llm.common import small, stored

POSITIONS = [g for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for g in [tuple(p for p in half if p != out) for out in half]]
CHUNK = 1 << 16
#: Edges that a task joins at once.
EDGES = 1 << 18


def simhash64(data: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit number; 0 without words."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    n = len(words) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        h = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=min(CHUNK, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """SimHash of a text column. A-Z are lower-cased, words end at ASCII white space; null counts as empty."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: simhash64(t, width, seed)).astype("int64")

    return of(F.coalesce(text.cast("binary"), F.lit(b"")))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _posting_keys(fp: Column) -> Column:
    """One number per group of three positions: the group and its bytes."""
    keys = []
    for no, group in enumerate(POSITIONS):
        key = F.lit(no).cast("bigint")
        for p in group:
            key = key * 256 + _byte(fp, p)
        keys.append(key)
    return F.array(*keys)


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the fingerprints of one tile: those linked to a smaller one, and the smallest of their group."""
    fps = np.unique(fps)
    if len(fps) < 2:
        return fps[:0], fps[:0]
    xor = np.bitwise_xor(fps[:, None], fps[None, :])
    shared = (xor[:, :, None].view(np.uint8) == 0).sum(axis=2, dtype=np.uint8)
    near = shared >= 8 - distance
    near &= np.bitwise_count(xor.view(np.uint64)) <= distance
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[child], fps[label[child]]


def links(fingerprints: DataFrame, distance: int = 3, tile: int = 1024) -> DataFrame:
    """(a, b) with a > b: a forest with the same components as all pairs of distinct
    fingerprints ``fp`` within ``distance`` (at most 3) differing bits."""
    if not 0 <= distance <= 3:
        raise ValueError("the posting groups guarantee a meeting for 0 to 3 bits")
    postings = fingerprints.select("fp", F.explode(_posting_keys(F.col("fp"))).alias("key"))
    sizes = stored(postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "posting-sizes")
    dealt = postings.join(sizes, "key").withColumn("tiles", F.ceil(F.col("n") / tile))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    others = F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)
    meets = F.transform(others, lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    tiles = (
        dealt.withColumn("own", own)
        .select("key", "fp", F.explode(meets).alias("at"))
        .groupBy("key", "at")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select("fps")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            found = [_forest(flat[s:e], distance) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return tiles.mapInArrow(compare, "a bigint, b bigint").distinct()


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the pairs: the nodes that are not the smallest of theirs, and the smallest."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    one, other = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least, x, y = label.copy(), label[one], label[other]
        # nodes take the label of their neighbours, and so do the labels themselves, else long chains take a step for each node
        for node, seen in ((one, y), (other, x), (x, y), (y, x)):
            np.minimum.at(least, node, seen)
        least = least[least]
        if (least == label).all():
            break
        label = least
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _forests(edges: DataFrame, rows: int, most: int) -> DataFrame:
    """A forest of each ``most`` edges or a batch more, with the same components; edges go to as few tasks as that takes."""

    def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        pair = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spanning(*pair)], names=["a", "b"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield forest(held)
                held, n = [], 0
        if held:
            yield forest(held)

    return edges.coalesce(max(1, -(-rows // most))).mapInArrow(joined, "a bigint, b bigint")


def smallest_reachable(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes of ``edges`` (a, b) that are not roots.

    Tasks first turn ``most`` edges at a time into a forest. If there are no more, that is the result, in two
    tables instead of three a round, each of a file for every partition. Else the forests
    alternate the large-star and small-star steps until the edges form stars. Minima are
    pre-aggregated and stored before they meet the edges, so a hub is split by the skew join.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    rows = edges.count()
    edges = stored(_forests(edges, rows, most), "forests")
    if rows <= most:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large-star")
        large = stored(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        moved = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _classified(prints: DataFrame, distance: int) -> DataFrame:
    """Rows of ``prints`` (doc_id, fp, ...) with root, the fingerprint that stands for their component, and component_id."""
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = stored(smallest_reachable(links(groups, distance)), "roots")
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return prints.join(stored(rooted.join(least, "root").select("fp", "root", "component_id"), "classes"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3, width: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows
    and repeated ids keep their rows; a component whose ids are all null has a null id; other
    columns are ignored whatever their names. An empty table gives an empty table.
    """
    prints = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), width).alias("fp")), "fingerprints")
    return _classified(prints, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, rows: DataFrame, row_key: Column) -> DataFrame:
    """The row of ``docs`` with the smallest id of each root, once; ``rows`` has doc_id, row_key and root of every row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")).alias("f")
    keepers = stored(rows.groupBy("root").agg(first).select("root", F.col("f.row_key").alias("keeper")), "keepers")
    gone = stored(rows.join(keepers, "root").filter("row_key <> keeper").select("row_key").distinct(), "near-duplicates")
    repeated = rows.groupBy("row_key").count().filter("count > 1").select("row_key")
    repeated = stored(repeated.join(keepers.select(F.col("keeper").alias("row_key")), "row_key", "left_semi"), "repeated")
    kept = docs.select(F.struct("*").alias("row"), row_key.alias("row_key")).join(small(gone), "row_key", "left_anti")
    if not repeated.isEmpty():
        again = small(repeated)
        kept = kept.join(again, "row_key", "left_anti").unionByName(kept.join(again, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return kept.select("row.*")
