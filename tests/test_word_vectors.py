"""Word vectors: the tree, and training that stays in tasks."""

import heapq
import random
from collections import Counter

import numpy as np
import pytest

from bellwether.operators import models as M
from bellwether.operators import skipgram as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("n", [2, 3, 40, 700])
def test_the_tree_is_the_shortest(n):
    counts = np.sort(np.random.default_rng(n).integers(5, 2000, n))[::-1]
    parent, bit, weight = S.huffman(counts)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    depth = 0
    for w in range(n):
        k = w
        while k != 2 * n - 2:
            k, depth = parent[k], depth + int(counts[w])
    assert depth == cost and weight[-1] == counts.sum() and (np.diff(weight) >= 0).all()
    assert sorted(parent[:-1].tolist()) == sorted([*range(n, 2 * n - 1)] * 2) and bit[:-1].sum() == n - 1


def test_trees_with_few_words(spark):
    for texts, words in (([[], None], 0), ([["a"] * 9], 1), ([["a", "b"] * 9], 2), ([["a"]] * 6 + [["b", "b"]] * 3, 2)):
        got = M.word_vectors(spark.createDataFrame([(t,) for t in texts], "toks array<string>"), dim=8).collect()
        assert len(got) == words and all(len(r.vec) == 8 and np.isfinite(r.vec).all() for r in got)


def test_every_pair_is_trained_and_neighbours_are_near(spark):
    rng = random.Random(2)
    groups = [[f"{g}{i}" for i in range(25)] for g in "xyz"]
    texts = [([rng.choice(groups[k % 3]) for _ in range(40)],) for k in range(900)] + [(["x1", "rare"],)] * 4
    rows = spark.createDataFrame(texts, "toks array<string>").repartition(4)
    out = M.word_vectors(rows, dim=20)
    # vectors are trained in tasks and stay there: the driver holds no table of them
    assert "LocalTableScan" not in plan(out)
    got = {r.form: np.array(r.vec) for r in out.collect()}
    assert sorted(got) == sorted(w for g in groups for w in g)
    x = np.array([got[w] / np.linalg.norm(got[w]) for g in groups for w in g])
    near = x @ x.T
    same = np.kron(np.eye(3), np.ones((25, 25))) == 1
    assert near[same].mean() > near[~same].mean() + 0.4


def test_counts_of_pairs_reach_the_trainer():
    ids, text = np.random.default_rng(4).integers(0, 300, (2, 60_000))
    text.sort()
    counts = np.bincount(ids, minlength=300)
    order = np.argsort(-counts)
    ids, counts = np.argsort(order)[ids], counts[order]
    t = S.Trainer(counts, S.huffman(counts), 10, 5, 13, 0, 1.0)
    t.train(ids, text)
    reach = np.random.default_rng([13, 0]).integers(1, 6, len(ids), dtype=np.int8)
    used = Counter()
    for _, context in S.neighbours(text, reach, 5, 0, len(ids)):
        used.update(ids[context].tolist())
    assert {int(w): int(n) for w, n in zip(t.words.ids[:t.words.n], t.words.uses, strict=False)} == used
    assert t.done == len(ids) and t.nodes.n == 299
