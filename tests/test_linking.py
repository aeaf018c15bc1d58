"""Names found by positional joins, against regular expressions."""

import random
import re

from bellwether.functions import text as X
from bellwether.operators import linking as L


def test_places_against_patterns(spark):
    rng = random.Random(2)
    names = ["ab", "abc", "b a", "aa", "a b c", "c&", "é", "b", "ca\nb", "a  b"]
    titles = ["".join(rng.choice(["a", "b", "c", " ", "&", "é", "\n", ".", "A"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", " ", "a b c", "xab", "aaa", None]
    news = spark.createDataFrame(list(enumerate(titles)), "news_id bigint, title string").repartition(5)
    rules = spark.createDataFrame([(a, "word", False, None) for a in names], "alias string, kind string, ambiguous boolean, tight string")
    got = {(r.news_id, r.alias) for r in L.mentions(news, rules).collect()}
    assert got == {(i, a) for i, t in enumerate(titles) for a in names if a in (t or "")}
    pattern = re.compile("|".join(map(re.escape, sorted(names, key=lambda a: (-len(a), a)))))
    want = set()
    for i, t in enumerate(titles):
        for a in set(pattern.findall(t or "")):
            free = re.search(f"(?<![0-9A-Za-z&]){re.escape(a)}(?![0-9A-Za-z&])", t)
            want.add((i, a, "linked" if free else "boundary"))
    judged = [tuple(r) for r in L.classify_mentions(news, rules, ["x"]).select("news_id", "alias", "status").collect()]
    assert set(judged) == want and len(judged) == len(want)
    plan = L.classify_mentions(news, rules, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "\\Q" not in plan and plan.count("regexp_extract_all(") == plan.count("regexp_extract_all(lower(title")


def _awkward(spark):
    rng = random.Random(7)
    names = ["ab", "abc", "b a", "aa", "a b c", "c&", "é", "b", "ca\nb", "a  b", " b", "abcabcab", "abcé a"]
    titles = ["".join(rng.choice(["a", "b", "c", " ", "&", "é", "\n", ".", "A", "abc"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", None, "b", "é"]
    news = spark.createDataFrame(list(enumerate(titles)), "news_id bigint, title string").repartition(3)
    rules = spark.createDataFrame([(a, "word" if i % 3 else "run", i % 4 == 0, None) for i, a in enumerate(names)] + [("  ", "word", False, None)],
                                  "alias string, kind string, ambiguous boolean, tight string")
    return news, rules


def test_few_names_and_many_names_give_the_same(spark, monkeypatch):
    news, rules = _awkward(spark)
    calls = (L.mentions, L.bounded_mentions, lambda n, r: L.classify_mentions(n, r, ["abc"]))
    monkeypatch.setattr(L, "_SLICE", 64)  # names that lie across the slices
    few = [sorted(map(tuple, f(news, rules).collect())) for f in calls]
    monkeypatch.setattr(L, "_BROADCAST", 0)
    many = [sorted(map(tuple, f(news, rules).collect())) for f in calls]
    assert few == many and all(len(x) > 300 for x in few)


def test_few_names_are_read_without_exchanging_words(spark):
    news, rules = _awkward(spark)
    for found in (L.mentions(news, rules), L.bounded_mentions(news, rules), L.classify_mentions(news, rules, ["x"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("hashpartitioning(") == 1 and "Aggregate" not in plan


def test_runs_of_tokens_that_are_names(spark):
    rng = random.Random(3)
    names = ["ab", "abc", "abab", "cab", "c", "abcabc", "zz", "a", "b c", "ababab"]
    texts = [(i, [rng.choice(["ab", "a", "b", "c", "ca", "abc"]) for _ in range(rng.randint(0, 9))], rng.sample(names, rng.randint(0, 9))) for i in range(200)]
    rows = spark.createDataFrame(texts, "id bigint, t array<string>, n array<string>")
    got = {r.id: set(r.got) for r in rows.select("id", X.named_runs("t", "n").alias("got")).collect()}
    assert got == {i: {x for x in n if any("".join(t[a : a + k]) == x for a in range(len(t)) for k in range(1, 5) if a + k <= len(t))} for i, t, n in texts}
