"""Cases that the SQL rows do not reach: ties, nulls, interrupted writes, short texts, very many trials."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from bellwether.functions import text as X
from bellwether.operators import aggregates, joins, linking, selection, similarity, stats
from bellwether.sources import sinks


def test_first_per_key_with_repeated_and_null_orders(spark):
    rows = [("a", 1, 10), ("a", 2, 11), ("b", 1, 20), ("b", 2, 21), ("c", 2, 30), ("d", None, 40), ("d", 5, 41), (None, 3, 50)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.v) for r in selection.first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {("a", 10), ("b", 20), ("c", 30), ("d", 40), (None, 50)}


def test_append_missing_drops_duplicates_within_a_batch(spark, tmp_path):
    p = str(tmp_path / "store")
    for rows in ([(1, "x"), (1, "x"), (2, "y")], [(2, "z"), (3, "q"), (3, "q")]):
        sinks.append_missing(spark.createDataFrame(rows, "k int, v string"), p, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(p).collect()) == [(1, "x"), (2, "y"), (3, "q")]


def test_interrupted_stage_is_built_again(spark, tmp_path):
    p = tmp_path / "stage"
    os.makedirs(p / "_temporary" / "0")
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    assert sinks.stage_cached(spark, str(p), build).count() == 5
    assert sinks.stage_cached(spark, str(p), build).count() == 5 and len(built) == 1
    assert os.listdir(tmp_path) == ["stage"]


def test_token_runs_of_short_texts(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "t array<string>")
    got = [sorted(r[0]) for r in df.select(X.token_runs("t", 4)).collect()]
    assert got == [[], ["a"], ["a", "ab", "b"], ["a", "ab", "abc", "b", "bc", "c"]]


@pytest.mark.parametrize(("n", "p"), [(1, 0.3), (40, 0.07), (3000, 0.5), (3000, 0.001)])
def test_binomial_tail_against_the_sum(spark, n, p):
    hits = sorted({0, 1, n // 3, int(n * p), min(n, int(n * p) + 5), n})
    df = spark.createDataFrame([(h,) for h in hits], "h int")
    got = {r.h: r.p for r in df.select("h", stats.binomial_tail(F.col("h"), F.lit(n), F.lit(p)).alias("p")).collect()}
    for h in hits:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) for k in range(h, n + 1))
        assert got[h] == pytest.approx(min(1.0, want), abs=1e-9)


def test_a_thousand_million_trials(spark):
    n = 1_000_000_000
    df = spark.range(1).select(stats.binomial_tail(F.lit(n // 2), F.lit(n), F.lit(0.5)).alias("p"))
    assert df.first().p == pytest.approx(0.5, abs=1e-4)


def test_nearest_in_blocks_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"t{i % 90}", [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, text string, vec array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = set()
    for q, qt, _ in rows[:25]:
        best = {}
        for i, t, _ in rows:
            if i != q and t != qt:
                best[t] = max(best.get(t, (-9, 0)), (round(float(unit[q] @ unit[i]), 6), -i))
        ranked = sorted(best.values(), reverse=True)[:4]
        want |= {(q, k + 1, -i) for k, (_, i) in enumerate(ranked)}
    for block in (7, 1000):
        got = similarity.nearest(df, df.filter("id < 25"), 4, block=block).collect()
        assert {(r.query_id, r["rank"], r.id) for r in got} == want


def test_week_counts_with_equal_times(spark):
    rows = [("a", d, s, i) for i, (d, s) in enumerate([(1, 0), (1, 0), (1, 0), (8, 0), (8, 1), (9, 0), (20, 0)])] + [("b", 1, 0, 9)]
    df = spark.createDataFrame(rows, "ticker string, d int, s int, news_id bigint").withColumn(
        "published_at", F.expr("timestampadd(SECOND, d * 86400 + s, timestamp_ntz'2024-01-01 00:00:00')"))
    got = {r.news_id: r.n7 for r in joins.prior_week_counts(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1, 5: 2, 6: 0, 9: 0}


def test_linking_gathers_nothing_in_one_task(views):
    for df in (linking.mentions(views.news, views.aliases.select("alias")), joins.enrich(views.news, views.sentiment, ["news_id"], "sent", 0.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan


def test_parts_put_together_are_the_whole_day(views):
    day = F.to_date("published_at")
    whole = {(r.ticker, r.date): r.doc_text for r in aggregates.joined_text(views.news, day, part_chars=1 << 40).collect()}
    parts = aggregates.joined_text(views.news, day, part_chars=2000).orderBy("ticker", "date", "part").collect()
    joined = {}
    for r in parts:
        joined.setdefault((r.ticker, r.date), []).append(r.doc_text)
    assert {k: " . ".join(p) for k, p in joined.items()} == whole and len(parts) > len(whole)


def test_longest_names_hide_those_inside_them(spark):
    news = spark.createDataFrame([(1, "we met acme north today"), (2, "acme and north"), (3, "acme northern"), (4, "old acme north star")], "news_id bigint, title string")
    rules = spark.createDataFrame([(a, "word", False, None) for a in ("acme", "north", "acme north", "north star")], "alias string, kind string, ambiguous boolean, tight string")
    got = {(r.news_id, r.alias, r.status) for r in linking.classify_mentions(news, rules, ["x"]).collect()}
    assert got == {(1, "acme north", "linked"), (2, "acme", "linked"), (2, "north", "linked"), (3, "acme north", "boundary"), (4, "acme north", "linked")}
