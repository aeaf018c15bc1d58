"""Invariants of fitted results, on the smallest tables."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bellwether.operators import models as M
from bellwether.session import frozen

ROWS_ONLY = sorted(set(entry.queries()) - set(entry.oracle_sql()))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs_and_is_bounded(spark, name):
    rows = entry.queries()[name](spark, SMALL).collect()
    assert rows
    for r in rows:
        d = r.asDict()
        for c in ("acc", "base", "acc_all", "hit_first", "rate", "mean_p", "mean_cal"):
            assert d.get(c) is None or 0 <= d[c] <= 1
        if "tp" in d:
            assert d["tp"] + d["fp"] + d["fn"] + d["tn"] == d["n"]


@pytest.fixture(scope="module")
def rows(views):
    return frozen(M.feature_table(views.panel))


def test_split_is_in_time_order(rows):
    s = {r.split: (r.a, r.b) for r in M.time_split(rows).groupBy("split").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    assert s["train"][1] < s["dev"][0] <= s["dev"][1] < s["test"][0]


def test_walk_forward_keeps_rows_and_looks_back_only(rows):
    def make():
        return M.logistic(["lagret_1", "gap"])

    p = M.walk_forward(rows, make, step=20, min_rows=50)
    first = p.agg(F.min("date")).first()[0]
    assert p.count() == rows.filter(F.col("date") >= F.lit(first)).count()
    # labels of the last block cannot matter for the blocks before it
    last = p.agg(F.max("block")).first()[0]
    late = F.col("date") >= F.lit(last)
    q = M.walk_forward(rows.withColumn("label", F.when(late, 1 - F.col("label")).otherwise(F.col("label"))), make, step=20, min_rows=50)

    def head(d):
        return sorted((r.ticker, str(r.date), round(r.p, 9)) for r in d.filter(F.col("block") < F.lit(last)).collect())

    assert head(p) == head(q)


def test_seeded_fits_repeat(rows):
    def fit():
        m = M.forest(["lagret_1", "gap"], trees=3).fit(rows)
        return [round(r.p, 9) for r in M.score(m, rows).orderBy("ticker", "date").limit(50).collect()]

    assert fit() == fit()


def test_tfidf_of_a_day_is_counted_over_its_texts(spark):
    import math
    from collections import Counter

    said = {1: [["a", "b", "a"], [], ["c", "b"]], 2: [["b", "c", "b"], None, ["a", "b"]], 3: [["a"], ["b", "zz"]], 4: [["qq"]]}
    texts = [("t", d, k, 10 * d + k, toks) for d, day in said.items() for k, toks in enumerate(day)]
    texts = spark.createDataFrame(texts, "ticker string, date int, published_at int, news_id int, toks array<string>")
    days = spark.createDataFrame([("t", d, "train" if d < 4 else "test", 1.0) for d in said], "ticker string, date int, split string, label double")
    counts = {}
    for d, day in said.items():
        w = [t for toks in day for t in toks or []]
        counts[d] = Counter(w) + Counter(map(" ".join, zip(w, w[1:], strict=False)))
    both = counts[1] + counts[2] + counts[3]
    df = Counter(g for d in (1, 2, 3) for g in counts[d])
    kept = sorted((g for g in both if df[g] > 1), key=lambda g: (-both[g], g))
    assert len({df[g] for g in kept}) == 2 and "b c" not in kept and "a b" in kept
    for vocab in (20, 2):
        terms = kept[:vocab]
        for r in M.tfidf_features(texts, days, vocab).collect():
            assert r.x.size == len(terms) and list(r.x.toArray()) == pytest.approx([counts[r.date][g] * math.log(4 / (1 + df[g])) for g in terms])
    assert "collect_list" not in M._grams(texts)._jdf.queryExecution().toString()


def test_bags_are_poisson_and_the_same_under_repartition(spark):
    from collections import Counter
    import math

    rows = spark.range(40_000).select(F.col("id"), F.col("id").cast("string").alias("k"))
    draws = {parts: {r.id: (r.a, r.b) for r in rows.repartition(parts).select("id", M.poisson_weight(["k"], 0).alias("a"), M.poisson_weight(["k"], 1).alias("b")).collect()} for parts in (1, 7)}
    assert draws[1] == draws[7]
    a, b = zip(*draws[1].values(), strict=True)
    for xs in (a, b):
        seen = Counter(xs)
        chi = sum((seen[k] - (e := 40_000 * math.exp(-1) / math.factorial(k))) ** 2 / e for k in range(6))
        assert chi < 25 and abs(sum(xs) / 40_000 - 1) < 0.02
    assert abs(sum(x * y for x, y in zip(a, b, strict=True)) / 40_000 - 1) < 0.04
    low = [r.w for r in rows.select(M.poisson_weight(["k"], 0, rate=6.5).alias("w")).collect()]
    assert abs(sum(low) / 40_000 - 6.5) < 0.06


def test_bagging_repeats_under_repartition(rows):
    def make():
        return M.logistic(["lagret_1", "gap"])

    def fit(train):
        out = M.bagging(train, rows, make, bags=2)
        return {(r.ticker, r.date): r.p for r in out.select("ticker", "date", "p").collect()}

    one, other = fit(rows), fit(rows.repartition(5))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-6 for k in one)


def test_scores_and_rows_of_meta_label_are_written_once(rows, monkeypatch):
    written = []
    monkeypatch.setattr(M, "frozen", lambda d: written.append(d.columns) or frozen(d))
    cols = ["lagret_1", "gap"]
    s = M.time_split(rows).select("date", "split", "label", "weight", *cols)
    got = M.meta_label(s.filter("split = 'train'"), s.filter("split = 'test'"), lambda: M.logistic(cols), lambda: M.logistic([*cols, "p"]))
    assert got.count() == s.filter("split = 'test'").count() and len(written) == 3


def test_walks_write_only_the_columns_they_use(views, monkeypatch):
    from bellwether.plans import models as plans

    made = []
    monkeypatch.setattr(plans, "frozen", lambda d: made.append(set(d.columns)) or d)
    plans.features(views, M.FEATURES["trend"])
    assert made == [{"ticker", "date", "ret", "label", "weight", *M.FEATURES["trend"]}]
