"""Event triples from tag texts, against a plain reading of the rules."""

import random

from bellwether.operators.text import triples_from_tags


def brute(toks, tags):
    phrases, marks = [], []  # words of each phrase; (tag, place, phrase before it)
    for k, (w, t) in enumerate(zip(toks, tags, strict=True)):
        if t == "N":
            if not k or tags[k - 1] != "N":
                phrases.append([])
            phrases[-1].append(w)
        else:
            marks.append((t, k, len(phrases) - 1))
    verbs = [(k, i, t) for t, k, i in marks if t == "V" or (t == "A" and k and tags[k - 1] == "N")]
    if len(phrases) < 2 or not verbs:
        return None
    k, i, t = verbs[-1]
    p = phrases[i] if t == "A" else [toks[k]]
    one = next((i for t, _, i in marks if t == "S" and i >= 0), 0)
    last = len(phrases) - 1
    two = next((i for t, _, i in reversed(marks) if t == "O" and i >= 0), last)
    if one == two:
        two = last if one != last else 0
    o1, o2 = phrases[one], phrases[two]
    return None if p in (o1, o2) or o1 == o2 else (o1, p, o2)


def test_triples_equal_a_plain_reading(spark):
    draw = random.Random(3)
    rows = [(0, None, None), (1, [], ""), (2, ["a"], "N"), (3, ["a", "b", "c"], "VNA")]
    for i in range(4, 600):
        tags = "".join(draw.choice("NNSOVAX") for _ in range(draw.randint(1, 14)))
        rows.append((i, [draw.choice("abcdefg") for _ in tags], tags))
    tagged = spark.createDataFrame(rows, "news_id bigint, toks array<string>, tags string")
    got = {r.news_id: (r.o1, r.p, r.o2) for r in triples_from_tags(tagged).collect()}
    want = {i: brute(toks, tags) for i, toks, tags in rows if toks}
    assert got == {i: t for i, t in want.items() if t is not None}


def test_tokens_stay_in_their_text(views):
    # the texts are dealt out once; their tokens are neither exchanged nor sorted
    plan = triples_from_tags(views.tagged)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "Window" not in plan


def test_stats_do_not_gather_vectors(views):
    from bellwether.operators import text as T

    plan = T.known_events(views.events, views.words)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ObjectHashAggregate" not in plan


def test_argument_vectors_move_each_use_once(spark):
    from bellwether.operators.text import argument_vectors

    words = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [3.0, 5.0]), ("c", [7.0, 0.0])], "form string, vec array<float>")
    events = spark.createDataFrame([(1, ["a", "b"], ["c"], ["a", "x"]), (2, ["x"], ["a"], ["b"])], "news_id bigint, o1 array<string>, p array<string>, o2 array<string>")
    got = argument_vectors(events, words)
    assert [(r.news_id, r.v_o1, r.v_p, r.v_o2) for r in got.collect()] == [(1, [2.0, 4.0], [7.0, 0.0], [1.0, 3.0])]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(news_id") == 1
