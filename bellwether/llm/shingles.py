"""Near-duplicates by SimHash, with every link held to the exact Jaccard similarity of the word shingles and none lost.

The SimHash index of ``llm/simhash.py`` proposes the first links: a set's fingerprint is the majority of its shingles' hashes, and equal
fingerprints and those within three bits are verified on whole sets. Three bits miss many pairs of a similarity of 0.8, so an exact way finds the rest.
Two sets with at least ``similarity`` share an element of their prefixes: of ``n`` elements in any order that
all sets have in common, the first ``n - ceil(similarity * n) + 1``. So every such pair meets in a posting list of
prefix elements; none is lost. Elements that many documents of a sample hold come last in the order, which keeps the
lists short; the sample only decides the order, never who is compared.

One pass over the texts leaves a row per document: a hash of its set, the set's size, its fingerprint, a bitmap and, once per task and
set, the prefix. Whole sets never leave that pass. Elements that occur once are dropped by a count before postings are
joined. Common elements up to the end of the prefix that ends first lie in both prefixes, so similar sets share not
one list but a guaranteed minimum of them (``_minimum``); pairs are tallied over the lists and those under it dropped.

Besides its neighbours by SimHash, every set is compared with the one that most often is the smallest of its lists; what that links needs no further
comparison. Lists that still hold different groups get another head by hash, twice: a set that a head's group does not hold yet is compared
with the best of the heads it is allowed to link to. So a large group of near copies costs rows by its size and not by its square, though no
member be like all. Lists that hold different groups even then are split into tiles that meet pair by pair in separate rows. What leaves a tile is a forest over the pairs
that their bitmaps allow, never the pairs; its trees, joined over all tiles, are blocks outside of which no link is left. Each block is split into tiles again, now of
whole sets, which return a forest over the links between groups. So rows grow with the sets and not with the pairs. Lists
of the same sets, as a shared passage makes them, are compared once. Bitmaps are as long as their sets need: those of
long sets would otherwise be full and allow every pair. A longer one is folded to meet one of half its length. Only the documents of pairs that reach the minimum are read again for their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.llm import simhash
from bellwether.llm.common import hashed_share, small, stored

#: Documents whose shingles are counted for the order, how many of these must hold a shingle that comes last, and how many shingles can.
SAMPLE, OFTEN, MOST = 4_000, 3, 50_000
#: How often mixed lists get another head before all their pairs are compared.
ROUNDS = 2
#: Least and most bits of a bitmap; sets that a task remembers as written.
LEAST_BITS, MOST_BITS, REMEMBERED = 1024, 1 << 15, 1_000_000
#: Elements of a tile of whole sets, on average.
ELEMENTS = 1 << 20


def shingle_hashes(data: bytes | None, width: int = 5) -> np.ndarray:
    """The different XXH64 of all word shingles, sorted; a text under ``width`` words is one shingle, one without words none."""
    words = data.lower().split() if data else []
    if not words:
        return np.zeros(0, dtype=np.int64)
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.unique(np.fromiter((digest(s) for s in shingles), dtype="<u8", count=len(words) - width + 1).view("<i8"))


def bitmap(items: np.ndarray) -> np.ndarray:
    """Which remainders of the elements occur an odd number of times, in a power of two of bits, at least one an element up to ``MOST_BITS``."""
    bits = min(max(LEAST_BITS, 1 << max(len(items) - 1, 0).bit_length()), MOST_BITS)
    return np.packbits(np.bincount(items & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").view("<i8")


def fingerprint(items: np.ndarray) -> int:
    """SimHash of a set: the bits that over half of its elements have, as a signed 64-bit number; 0 for the empty set."""
    ones = np.unpackbits(items.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(items), bitorder="little").view("<i8")[0])


def _texts(docs: DataFrame, row_key: Column, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), row_key.alias("row_key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))


def _often(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a sample that come last, sorted, and their uses: at most ``MOST``."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_py(), width))], names=["key"])

    sample = texts.filter(hashed_share("row_key", SAMPLE, texts.count(), "shingle-order")).select("text").mapInArrow(shingles, "key bigint")
    counts = sample.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= OFTEN)
    often = sorted((r["key"], r["c"]) for r in counts.orderBy(F.desc("c"), "key").limit(MOST).collect())
    keys, uses = (np.array([x[k] for x in often], dtype=np.int64) for k in (0, 1))
    return keys, uses


def _sketches(texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """(doc_id, row_key, sid, n, fp, bits, prefix) per row: set id, set size, fingerprint, bitmap and
    prefix; the prefix is null where the task has written it for an earlier row with this set."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(_often(texts, width))

    def prefix(items: np.ndarray) -> np.ndarray:
        keys, uses = shared.value
        n = len(items)
        if n and len(keys):
            at = np.minimum(np.searchsorted(keys, items), len(keys) - 1)
            items = items[np.argsort(np.where(keys[at] == items, uses[at], 0), kind="stable")]
        return items[: n - math.ceil(similarity * n - 1e-9) + 1]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[int] = set()
        for batch in batches:
            rows = []
            for t in batch.column(2):
                items = shingle_hashes(t.as_py(), width)
                sid = xxhash.xxh64_intdigest(items.tobytes()) - (1 << 63)
                rows.append((sid, len(items), fingerprint(items), bitmap(items), None if sid in written else prefix(items)))
                if len(written) >= REMEMBERED:
                    written.clear()
                written.add(sid)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["doc_id", "row_key", "sid", "n", "fp", "bits", "prefix"])

    schema = texts.select("doc_id", "row_key", F.lit(0).cast("bigint").alias("sid"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("fp"), *(F.lit(None).cast("array<bigint>").alias(c) for c in ("bits", "prefix"))).schema
    return stored(texts.mapInArrow(sketch, schema), "sketches")


def _sets(texts: DataFrame, sketches: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(sid, items) of the sets in ``pairs`` (a, b), from one document each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    one = stored(sketches.select("sid", "row_key").join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("row_key").alias("row_key")), "pair-documents")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[int] = set()
        for batch in batches:
            for sid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if sid not in written:
                    written.add(sid)
                    yield pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([shingle_hashes(text.as_py(), width)], pa.list_(pa.int64()))], names=["sid", "items"])

    met = texts.join(small(one), "row_key").select("sid", "text")
    return stored(met.mapInArrow(whole, "sid bigint, items array<bigint>").dropDuplicates(["sid"]), "shingle-sets")


def _minimum(na: Column, nb: Column, similarity: float) -> Column:
    """How many prefix elements sets of two sizes share at least if they are similar."""
    whole = lambda x: F.ceil(x - 1e-9)
    return F.greatest(F.lit(1), whole((na + nb) * (similarity / (1 + similarity))) - whole(F.greatest(na, nb) * similarity) + 1)


def _likely(tally: DataFrame, marks: DataFrame, similarity: float, whole: bool = True) -> DataFrame:
    """The pairs (a, b, lists) of a tally that share enough and that sizes and bitmaps allow: sets differ in at
    least as many elements as their bitmaps in bits. Unless a tally is of ``whole`` pairs, the lists do not matter."""
    for x in ("a", "b"):
        tally = tally.join(marks.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"_{x}")), x)
    size = F.least(F.size("_a"), F.size("_b"))  # of similar sets one bitmap is at most twice as long

    def folded(bits: str) -> Column:
        halves = F.zip_with(F.slice(bits, 1, size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) > size, halves).otherwise(F.col(bits))

    apart = F.aggregate(F.zip_with(folded("_a"), folded("_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sizes = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
    likely = tally.filter(sizes & (F.col("lists") >= _minimum(F.col("na"), F.col("nb"), similarity)) if whole else sizes)
    return likely.filter(apart <= (F.col("na") + F.col("nb")) * (1 - similarity) / (1 + similarity) + 1e-6).select("a", "b", "lists")


def _alike(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, similarity: float, width: int) -> DataFrame:
    """Of stored pairs (a, b) of set ids those with at least the Jaccard similarity."""
    sets = _sets(texts, sketches, pairs, width)
    one, other = (sets.select(F.col("sid").alias(x), F.col("items").alias(f"_{x}")) for x in ("a", "b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    return pairs.select("a", "b").join(one, "a").join(other, "b").filter(shared / (F.size("_a") + F.size("_b") - shared) >= similarity).select("a", "b")


def _allowed(tile: pa.StructArray, crossed: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a tile's sets that are in different groups and not ruled out; of a crossed tile only those between its halves."""
    sid, root, n, own = (tile.field(k).to_numpy() for k in ("sid", "root", "n", "own"))
    words, ends = tile.field("bits").flatten().to_numpy().view(np.uint64), np.cumsum(pc.list_value_length(tile.field("bits")).to_numpy())
    sizes = np.diff(ends, prepend=0)

    def maps(at: np.ndarray, size: int) -> np.ndarray:
        return words[(ends[at] - size)[:, None] + np.arange(size)]

    found = [(sid[:0], sid[:0])]
    for size in np.unique(sizes):
        same, longer = np.flatnonzero(sizes == size), np.flatnonzero(sizes == 2 * size)
        folded = maps(longer, 2 * size)
        met, bits = np.r_[same, longer], np.r_[maps(same, size), folded[:, :size] ^ folded[:, size:]]
        step = max(1, (1 << 18) // bits.size)
        for at in range(0, len(same), step):
            some = same[at : at + step, None]
            apart = np.bitwise_count(bits[at : min(at + step, len(same)), None] ^ bits[None]).sum(axis=2, dtype=np.int32)
            fits = (apart <= (n[some] + n[met]) * (1 - similarity) / (1 + similarity) + 1e-6) & (np.minimum(n[some], n[met]) >= similarity * np.maximum(n[some], n[met]) - 1e-9)
            fits &= (root[some] != root[met]) & ((sid[some] > sid[met]) | (np.arange(len(met)) >= len(same)))
            if crossed:
                fits &= own[some] != own[met]
            one, other = np.nonzero(fits)
            pair = sid[same[at + one]], sid[met[other]]
            found.append((np.maximum(*pair), np.minimum(*pair)))
    a, b = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b)


def _mixed(placed: DataFrame) -> DataFrame:
    """(key, lists, c, sid, root): of the lists (key, sid, root) that hold different groups one of each set of members, how many
    lists that stands for, and its size."""
    members = F.struct(F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64(F.lit("again"), "sid")).alias("y"), F.count("*").alias("c"))
    lists = placed.groupBy("key").agg(members.alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    lists = lists.groupBy("members").agg(F.min("key").alias("key"), F.count("*").alias("lists")).select("key", "members.c", "lists")
    return stored(placed.join(stored(lists, "mixed-lists"), "key").select("key", "lists", "c", "sid", "root"), "mixed-postings")


def _rejoined(mixed: DataFrame, edges: DataFrame) -> DataFrame:
    """Mixed lists with the groups of all ``edges``, those that hold different ones."""
    found = stored(simhash.smallest_reachable(edges), "round-roots").withColumnRenamed("node", "sid").withColumnRenamed("root", "_root")
    rows = stored(mixed.join(found, "sid", "left").withColumn("root", F.coalesce("_root", "sid")).drop("_root"), "rooted-postings")
    still = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    return stored(rows.join(stored(still, "mixed-lists"), "key").select(*mixed.columns), "mixed-postings")


def _hashed_heads(mixed: DataFrame, marks: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(a, b): each set with the best allowed of the heads, chosen by hash, of its lists that are in other groups."""
    head = F.min(F.struct(F.xxhash64(F.lit(turn), "sid").alias("h"), F.col("sid").alias("head"), F.col("root").alias("other"))).alias("m")
    heads = stored(mixed.groupBy("key").agg(head).select("key", "m.head", "m.other"), "hashed-heads")
    tally = mixed.join(heads, "key").filter("root <> other").groupBy(F.col("sid").alias("a"), F.col("head").alias("b")).agg(F.sum("lists").alias("lists"))
    best = _likely(stored(tally, "head-pairs"), marks, similarity, whole=False).groupBy("a").agg(F.max(F.struct("lists", "b")).alias("m"))
    return stored(best.select("a", "m.b"), "likely-pairs")


def _simhash_pairs(written: DataFrame) -> DataFrame:
    """(a, b): each set with the smallest of its fingerprint, and the forest of the SimHash index over these."""
    prints = written.select("sid", "fp").distinct()
    least = stored(prints.groupBy("fp").agg(F.min("sid").alias("least")), "set-fingerprints")
    near = simhash.links(least.select("fp"))
    for x in ("a", "b"):
        near = near.join(least.select(F.col("fp").alias(x), F.col("least").alias(f"_{x}")), x)
    same = prints.join(least, "fp").filter("sid <> least").select(F.col("sid").alias("a"), F.col("least").alias("b"))
    return same.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def _dealt(rows: DataFrame, tiles: Column) -> DataFrame:
    """Rows of sets with the tile they are in (``own``), once for each pair of tiles (``at``) that their list or block has."""
    rows = rows.withColumn("tiles", tiles)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("tiles")))
    others = F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)
    meets = F.transform(others, lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    return rows.select("*", F.explode(meets).alias("at"))


def _meetings(mixed: DataFrame, marks: DataFrame, similarity: float, tile: int) -> DataFrame:
    """(a, b): a forest that holds any two sets of a mixed list in one tree that are in different groups and not ruled out."""
    rows = _dealt(mixed, F.ceil(F.col("c") / tile)).join(marks, "sid")
    rows = rows.select("key", "at", F.struct("sid", "root", "n", "own", "bits").alias("member"))
    tiles = rows.groupBy("key", "at").agg(F.collect_list("member").alias("members")).select("members", (F.col("at.i") != F.col("at.j")).alias("crossed"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash.spanning(*_allowed(m.values, c.as_py(), similarity)) for m, c in zip(batch.column(0), batch.column(1), strict=True)]
            if found:
                a, b = simhash.spanning(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return tiles.mapInArrow(compare, "a bigint, b bigint").distinct()


def _linked(tile: pa.StructArray, items: pa.ListArray, crossed: bool, similarity: float) -> list[tuple[int, int]]:
    """A forest over the groups of a tile's sets: pairs of sets with at least the Jaccard similarity, none between groups that others join."""
    sid, root = (tile.field(k).to_numpy() for k in ("sid", "root"))
    order = np.argsort(sid)
    a, b = (order[np.searchsorted(sid, x, sorter=order)] for x in _allowed(tile, crossed, similarity))
    values, codes = np.unique(items.flatten().to_numpy(), return_inverse=True)
    ends = np.cumsum(pc.list_value_length(items).to_numpy())
    held = np.split(codes, ends[:-1])
    joined: dict[int, int] = {}

    def group(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    found, mark, marked = [], np.zeros(len(values), dtype=bool), -1
    turn = np.argsort(a, kind="stable")
    for one, other in zip(a[turn].tolist(), b[turn].tolist(), strict=True):
        x, y = group(int(root[one])), group(int(root[other]))
        if x == y:
            continue
        if one != marked:
            mark[:] = False
            mark[held[one]] = True
            marked = one
        shared = int(mark[held[other]].sum())
        if shared / (len(held[one]) + len(held[other]) - shared) >= similarity:
            joined[max(x, y)] = min(x, y)
            found.append((int(sid[one]), int(sid[other])))
    return found


def _links(mixed: DataFrame, marks: DataFrame, texts: DataFrame, sketches: DataFrame, similarity: float, width: int, tile: int) -> DataFrame:
    """(a, b): sets with at least the Jaccard similarity that join all groups of the mixed lists that such pairs join."""
    met = stored(_meetings(mixed, marks, similarity, tile), "met-sets")
    blocks = stored(simhash.smallest_reachable(met), "blocks").select(F.col("node").alias("sid"), F.col("root").alias("block"))
    blocks = blocks.unionByName(blocks.select(F.col("block").alias("sid"), "block").distinct())
    members = stored(blocks.join(mixed.select("sid", "root").distinct(), "sid").join(marks, "sid"), "block-members")
    sizes = members.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / ELEMENTS)).alias("_tiles"))
    rows = _dealt(members.join(stored(sizes, "block-sizes"), "block"), F.col("_tiles")).join(_sets(texts, sketches, met, width), "sid")
    kept = ["sid", "root", "n", "own", "bits"]

    def verify(tile: pa.Table) -> pa.Table:
        member = pa.StructArray.from_arrays([tile[c].combine_chunks() for c in kept], names=kept)
        found = _linked(member, tile["items"].combine_chunks(), tile["i"][0].as_py() != tile["j"][0].as_py(), similarity)
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.select("block", "at.i", "at.j", "items", *kept).groupBy("block", "i", "j").applyInArrow(verify, "a bigint, b bigint")


def roots(texts: DataFrame, sketches: DataFrame, similarity: float = 0.8, width: int = 5, tile: int = 512) -> DataFrame:
    """(sid, root) for each set that is not the smallest of its group."""
    written = sketches.filter("prefix IS NOT NULL")
    postings = written.select("sid", F.explode("prefix").alias("key"))
    again = stored(postings.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "shared-elements")
    shared = stored(postings.join(again, "key"), "shared-postings")
    marks = written.select("sid", "n", "bits").join(shared.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"])
    marks = stored(marks, "bitmaps")
    heads = stored(shared.groupBy("key").agg(F.min("sid").alias("head"), F.max("sid").alias("last")).filter("head < last").drop("last"), "posting-lists")
    tally = shared.distinct().join(heads, "key").filter("sid <> head").groupBy(F.col("sid").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("lists"))
    best = tally.groupBy("a").agg(F.max(F.struct("lists", "b")).alias("m")).select("a", "m.b", "m.lists")
    near = stored(_likely(stored(_simhash_pairs(written), "simhash-pairs").withColumn("lists", F.lit(1)), marks, similarity, whole=False), "likely-prints")
    likely = _likely(stored(best, "head-pairs"), marks, similarity)
    likely = stored(likely.unionByName(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "likely-pairs")
    edges = stored(_alike(likely, texts, sketches, similarity, width), "head-edges")
    found = stored(simhash.smallest_reachable(edges), "head-roots")
    placed = shared.join(heads.select("key"), "key").join(found.withColumnRenamed("node", "sid"), "sid", "left")
    placed = stored(placed.select("key", "sid", F.coalesce("root", "sid").alias("root")).distinct(), "placed-postings")
    mixed = _mixed(placed)
    for turn in range(ROUNDS):
        edges = stored(edges.unionByName(_alike(_hashed_heads(mixed, marks, similarity, turn), texts, sketches, similarity, width)), "head-edges")
        mixed = _rejoined(mixed, edges)
    more = _links(mixed, marks, texts, sketches, similarity, width, tile)
    return simhash.smallest_reachable(edges.unionByName(more)).select(F.col("node").alias("sid"), "root")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of ``docs`` for each group linked by Jaccard similarity: that of the smallest id, with all its columns.

    Null and empty texts, and those of white space, are one group. A null id counts as the largest; of equal ids with different texts
    in a group one stays (the smaller hash), and repeated rows stay once. An empty table gives an empty table; other columns
    are kept whatever their names.
    """
    row_key = F.xxhash64(F.col(doc_id), F.col(text))
    texts = _texts(docs, row_key, doc_id, text)
    sketches = _sketches(texts, similarity, width)
    found = stored(roots(texts, sketches, similarity, width), "roots")
    rooted = sketches.join(found, "sid", "left").select("doc_id", "row_key", F.coalesce("root", "sid").alias("root"))
    return simhash.first_of_each(docs, stored(rooted, "classified"), row_key)
