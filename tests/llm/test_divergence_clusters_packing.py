"""Source divergence, centroid clusters and packing against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bellwether.llm import centroids, divergence, packing, queries, tokens
from bellwether.llm.common import table
from test_corpus_operators import AWKWARD, SF, docs_of

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# source divergence


def audited(rows, min_docs, top):
    docs = [(la or "", s or "", WORD.findall((t or "").translate(LOWER))) for _, t, la, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= min_docs}
        count = defaultdict(Counter)
        for _, s, words in mine:
            count[s].update(w for w in words if w in kept)
        whole = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        for s in count:
            pair = [(o, sum(abs(share(count[s], w) - share(count[o], w)) for w in kept)) for o in count if o != s]
            term = [(w, share(count[s], w) - share(whole, w)) for w in kept if count[s][w]]
            for part, found, limit in (("pair", pair, None), ("term", [x for x in term if x[1] > 0], top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k + 1) for k, x in enumerate(found[:limit])]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("slice_", [40, divergence.SLICE])
def test_audit_against_brute_force(spark, slice_):
    rng = random.Random(3)
    words = ["The", "the", "THE", "abcdefg", "abcdefgh", "abcdefghi", "abcdefgabcdefg", "abcdefgabcdefgh", "naïve", "Ünï", "a" * 15, "a" * 14, "x1y", "　", "e f", "[Z]`{}"]
    text = lambda: rng.choice(["", " ", "-", "\0"]).join(rng.choice(words) + rng.choice([" ", "", ".", "1"]) for _ in range(rng.randint(0, 12)))
    rows = [(i, text(), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None])) for i in range(300)] + AWKWARD
    rows += [(900 + i, "hot the " * 3, "en", "hot") for i in range(150)]
    assert got(divergence.audit(docs_of(spark, rows).repartition(5), min_docs=4, top=3, slice_bytes=slice_)) == audited(rows, 4, 3)


def test_audit_edges(spark):
    assert divergence.audit(docs_of(spark, [])).count() == 0
    assert got(divergence.audit(docs_of(spark, AWKWARD))) == audited(AWKWARD, 30, 50)
    clash = docs_of(spark, AWKWARD).select("*", *(F.lit(1).alias(c) for c in ("term", "n", "docs", "part", "item", "value", "rank", "v", "total", "cells")))
    assert got(divergence.audit(clash, min_docs=1)) == audited(AWKWARD, 1, 50)


def test_pointers_are_sorted_like_words():
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["q" * 100_000] * 2
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    start, length = divergence.word_pointers(data, np.array([len(data)]))
    order, new = divergence.multikey_order(data, start, length)
    found = [data[start[k] : start[k] + length[k]].tobytes().decode() for k in order]
    assert found == sorted(words) and [k for k in range(len(found)) if new[k]] == [k for k in range(len(found)) if not k or found[k] != found[k - 1]]
    assert all(new[k] or order[k] > order[k - 1] for k in range(1, len(order)))


# centroid clusters


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<double>, v string, cluster int, distance double")


@pytest.mark.parametrize(("k", "dims", "spread"), [(1, 3, 5), (2, 1, 2), (16, 64, 40), (40, 2, 3), (300, 8, 1000)])
def test_tree_search_against_all_distances(k, dims, spread):
    rng = np.random.default_rng(k)
    points, queries_ = rng.integers(-spread, spread + 1, (k, dims)), rng.integers(-spread, spread + 1, (500, dims))
    everything = ((queries_[:, None] - points[None]) ** 2).sum(axis=2)
    cluster, square, opened = centroids.nearest(centroids.vantage_tree(points), queries_)
    assert (cluster == everything.argmin(axis=1)).all() and (square == everything.min(axis=1)).all()
    assert opened <= everything.size and (dims > 2 or k < 3 or opened < everything.size)


def clustered(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if groups[n] else c for n, c in enumerate(cents)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, n, d in out:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, n, d in out), key=str)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-9, 10, 4) / 4).tolist()) for i in range(120)] + [(i, [0.5, 0.5, -0.25, 0.0]) for i in range(200, 260)]
    rows += [(5, rows[5][1]), (5, [1.0] * 4), (None, [2.0] * 4), (None, None), (7, None), (8, [1.0] * 3), (9, [1.0, None, 1.0, 1.0]), (10, [float("nan")] * 4), (11, [float("-inf")] * 4), (12, [])]
    for k, n in ((5, rows), (16, rows), (16, rows[:7]), (1, rows)):
        frame = centroids.cluster(vectors_of(spark, n).repartition(5), k=k, dims=4, scale=64)
        assert sorted((tuple(r)[:6] for r in frame.collect()), key=str) == clustered(n, k, 3, 4, 64)
    assert centroids.cluster(vectors_of(spark, []), dims=4).count() == 0
    assert centroids.cluster(vectors_of(spark, [(1, None)]), dims=4).count() == 0
    with pytest.raises(ValueError):
        centroids.cluster(vectors_of(spark, [(1, [1e300] * 4)]), dims=4)


# packing


def one_bin_at_a_time(lengths, capacity):
    """The method on a plain list of lengths; returns the bins."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        mine, gap = [], capacity
        for n in list(left):
            if n <= gap:
                mine.append(n)
                left.remove(n)
                gap -= n
        while gap and len(mine) > 1:
            s = min(mine)
            pairs = [(left[a] + left[b], left[a], left[b]) for a in range(len(left)) for b in range(a + 1, len(left)) if s < left[a] + left[b] <= gap + s]
            if not pairs:
                break
            total, *two = max(pairs)
            mine.remove(s)
            mine += two
            for n in two:
                left.remove(n)
            left = sorted([*left, s], reverse=True)
            gap -= total - s
        bins.append(mine)
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_ways_against_one_bin_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 60, 100])
    lengths = [rng.randint(1, rng.choice([capacity // 3, capacity])) for _ in range(rng.randint(0, 90))]
    found = packing.ways(Counter(lengths), capacity)
    used = Counter()
    for taken, times in found:
        assert sum(length * n for length, n in taken.items()) <= capacity and times > 0
        for length, n in taken.items():
            used[length] += n * times
    assert used == Counter(lengths)
    n, plain = sum(times for _, times in found), len(one_bin_at_a_time(lengths, capacity))
    assert packing.fewest(sum(lengths), capacity) <= n <= plain + 1
    if found:  # the first sequence is filled as by the plain method
        assert Counter(one_bin_at_a_time(lengths, capacity)[0]) == Counter(found[0][0])


def test_two_replace_the_smallest():
    # greedy: 6 + 3 leaves 1; 3 gives way to 2 + 2
    assert packing.ways({6: 1, 3: 1, 2: 2}, 10)[0] == ({6: 1, 2: 2}, 1)
    assert packing.ways({6: 4, 3: 4, 2: 8}, 10) == [({6: 1, 2: 2}, 4), ({3: 3}, 1), ({3: 1}, 1)]


def checked(rows, packed, capacity, ids_of):
    """Whether the pieces are those of the rows, and the sequences gapless; the number of sequences."""
    want = Counter()
    for i, t, *_ in rows:
        ids = [*ids_of(t or ""), 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], dtype="<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    at = defaultdict(list)
    for r in packed:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= capacity
    return len(at)


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_packing_query_against_the_tokenizer(spark, ids_of):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    packed = queries.best_fit_packing(spark, SF).collect()
    n = checked(rows, packed, 2048, ids_of)
    assert n <= 1.01 * packing.fewest(sum(r.length for r in packed)) + 1


def test_packing_edges(spark, ids_of):
    rows = docs_of(spark, AWKWARD).repartition(4).select("*", *(F.lit(1).alias(c) for c in ("piece", "length", "part", "nth", "first", "at", "ids")))
    for capacity in (1, 3, 50, 2048):
        packed = packing.pack(rows, capacity=capacity, keep_ids=True)
        checked(AWKWARD, packed.collect(), capacity, ids_of)
    whole = packing.sequences(packed).collect()
    assert all(len(r.ids) == r["length"] <= 2048 for r in whole)
    assert Counter(x for r in whole for x in r.ids) == Counter(x for _, t, *_ in AWKWARD for x in [*ids_of(t or ""), 0])
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_encoder_equals_the_tokenizer(ids_of):
    encode, rng = tokens.encoder(tokens.vocabulary()), random.Random(1)
    parts = [*" \n\t\r.'|", " ", "　", "\x1c", "\x85", "a", "é", "1", "²", "'s", "'re", "<|endoftext|>", "क", "ि", "👍"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert encode(text) == ids_of(text)
    for text in (" " * 300_000, " \n" * 200_000 + "x", "a" * 300_000):
        assert encode(text) == ids_of(text)
