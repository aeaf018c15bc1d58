"""Skip-gram pairs against a plain reading, and what they move."""

import random
from collections import Counter

import numpy as np
import pytest

from bellwether.operators import skipgram as S
from bellwether.operators import text as T
from bellwether.sources.views import Views

PAIRS = "news_id bigint, toks array<string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def draw(b, i, seed):
    return (b * 7919 + i * 104729 + seed) % 2147483647 * 48271 % 2147483647


def brute(texts, vocab, window=5, t=1e-3, seed=13):
    total, found = sum(n for _, n in vocab.values()), Counter()
    for news in {k for k, _ in texts if k is not None}:
        # texts of one id are one text, by the places of their tokens
        tokens = sorted((p, w) for k, toks in texts if k == news for p, w in enumerate(toks or [], 1) if w in vocab)
        z = {w: n / total for w, (_, n) in vocab.items()}
        tokens = [(p, w) for p, w in tokens if draw(news, p, seed) / 2147483647 < min(1, ((z[w] / t) ** 0.5 + 1) * (t / z[w]))]
        for i, (p, w) in enumerate(tokens):
            reach = draw(p, news, seed + 1) % window + 1
            for j in range(max(0, i - reach), min(len(tokens), i + reach + 1)):
                if j != i:
                    found[vocab[w][0], vocab[tokens[j][1]][0]] += 1
    return found


@pytest.mark.parametrize("bucket", [2_000_000, 40])
def test_pairs_equal_a_plain_count(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, [rng.choice(words) for _ in range(rng.randint(0, 30))]) for i in range(80)]
    texts += [texts[3], texts[9], texts[9], (7, texts[7][1][:4]), (None, ["w1", "w2"]), (500, None), (501, [])]
    counts = Counter(w for _, toks in texts for w in toks or [])
    vocab = {w: (i, n) for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])), 1) if n > 12}
    v = spark.createDataFrame([(w, i, n) for w, (i, n) in vocab.items()], "form string, word_id bigint, n bigint")
    rows = spark.createDataFrame(texts, PAIRS).repartition(3)
    got = T.skipgram_pairs(rows, v, t=0.02).collect()
    assert {(r.center, r.context): r.n for r in got} == brute(texts, vocab, t=0.02) and len(got) > 500
    assert not T.skipgram_pairs(rows, v.limit(0)).collect()


def test_pairs_move_packed_and_texts_stay(spark, tmp_path):
    texts = [(i, f"alpha beta gamma delta {'alpha' * (i % 3 + 1)}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    docs.repartition(32).write.parquet(f"{tmp_path}/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one/documents.parquet")
    even, one = Views(spark, str(tmp_path)).spread_tokens, Views(spark, f"{tmp_path}/one").spread_tokens
    assert "Exchange" not in plan(even) and plan(one).count("Exchange") == 1
    assert sorted(map(str, even.collect())) == sorted(map(str, one.collect()))
    found = plan(T.skipgram_pairs(even, T.vocabulary(even.selectExpr("explode(toks) as form"), 5)))
    assert found.count("Exchange") == 1 and "Exchange hashpartitioning(bucket" in found and "Window" not in found


def test_packed_counts_of_tasks_add_up():
    rng = np.random.default_rng(1)
    want, blobs = Counter(), []
    for _ in range(3):
        p = S.Packer(50, 7)
        for _ in range(2):
            c, x = rng.integers(0, 50, (2, 900))
            want.update(zip(c.tolist(), x.tolist(), strict=True))
            p.add(c, x)
        blobs += p.blobs()
        assert not list(p.blobs())
    got = {}
    for k in range(7):
        for c, x, n in zip(*p.pairs(k, [b[1:] for b in blobs if b[0] == k]), strict=True):
            assert (c, x) not in got
            got[int(c), int(x)] = int(n)
    assert got == want


def test_draws_are_those_of_sql(spark):
    from pyspark.sql import functions as F

    from bellwether.functions.scalar import mix

    b, i = np.array([-9, -1, 0, 5, 10**9]), np.array([3, 7, 0, 20_000, 1])
    rows = spark.createDataFrame([*zip(b.tolist(), i.tolist(), strict=True)], "b bigint, i bigint")
    assert [r[0] for r in rows.select(mix(F.col("b"), F.col("i"), 13)).collect()] == S.draws(b, i, 13).tolist()
