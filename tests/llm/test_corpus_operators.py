"""Operators of the corpus package: SQL, brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import itertools
import json
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from check_oracle import compare, connect
from pyspark.sql import functions as F

from bellwether.llm import chat, decontamination, impact, langid, lengths, mixing, quality, queries, sharding, shingles, simhash, urlfilter
from bellwether.llm.common import crc_of, table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, pass string, fp string, score string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, la, s, None, "k", "p", "f", "s") for i, t, la, s in rows], DOCS)


AWKWARD = [
    (None, None, None, None), (1, None, "en", "a"), (2, "", None, "a"), (3, "  \n\t ", "en", None), (4, "word", "en", "a"),
    (5, "word", "en", "a"), (5, "word", "en", "a"), (None, "no id here", "en", "b"), (6, "x" * 300_000, "de", "b"), (7, "ab " * 60_000, "de", "b"),
    (8, "5 kg \u0000 \U0001f600 naïve Ünïcode", "fr", "c"), (9, "12345 !!!", "fr", "c"),
]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    diff, n = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name])
    assert diff is None and n > 0


# language identification


def test_language_accuracy_on_held_out(spark):
    truth = table(spark, SF, "documents").select("doc_id", "lang")
    got = queries.language_id(spark, SF).join(truth, "doc_id").filter("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_backs_off_to_pieces(spark):
    rows = [(i, "the king sings loudly", "en", "a") for i in range(5)] + [(i + 9, "der könig singt laut", "de", "a") for i in range(5)]
    model = langid.train(docs_of(spark, rows))
    assert model.predict("the der")[0] in ("en", "de")
    assert "kings" not in model.words and model.predict("könige")[0] == "de" and model.predict("loud")[0] == "en"
    assert np.allclose(model.backed_off("king"), model.gram_logs[[model.grams["^king"], model.grams["$"]]].mean(axis=0))


def test_language_edges(spark):
    model = langid.train(docs_of(spark, AWKWARD))
    got = langid.identify(docs_of(spark, AWKWARD), model).collect()
    assert len(got) == len(AWKWARD)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3, 9))
    empty = docs_of(spark, [])
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs_of(spark, AWKWARD), langid.train(empty)).collect()} == {"und"}


def test_language_training_on_texts_without_letters(spark):
    rows = docs_of(spark, AWKWARD).repartition(len(AWKWARD))
    model = langid.train(rows)
    assert model.langs == ["de", "en", "fr"]
    assert langid.identify(rows, model).count() == len(AWKWARD)
    blank = langid.train(docs_of(spark, [(1, "  ", "en", "a"), (2, "12 ½ ²", "de", "a")]))
    assert blank.langs == ["de", "en"] and blank.predict("½ ² 3") == ("und", 0.0)
    assert langid.words_of("नमस्ते ½ a1b") == ["नमस्ते", "a", "b"]


def test_language_model_against_counting(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    model = langid.train(docs_of(spark, [(*r, "a") for r in rows]), max_words=400, max_grams=400)
    words = defaultdict(Counter)
    for _, t, la in rows:
        if t is not None and la is not None:
            words[la].update(langid.words_of(t))
    assert model.langs == sorted(words)
    for of, index, bound in ((lambda c: c, model.words, 400), (lambda c: sum((Counter({g: n * k for g, k in Counter(langid.grams_of(w)).items()}) for w, n in c.items()), Counter()), model.grams, 400)):
        counts = {la: of(words[la]) for la in words}
        kept = {x for la in words for x, _ in sorted(counts[la].items(), key=lambda p: (-p[1], p[0].encode()))[: bound // len(words)]}
        assert set(index) == kept
        logs = model.word_logs if index is model.words else model.gram_logs
        for i, la in enumerate(model.langs):
            total = sum(counts[la][x] for x in kept) + 0.5 * len(kept)
            assert all(abs(logs[index[x], i] - math.log((counts[la][x] + 0.5) / total)) < 1e-5 for x in kept)


@pytest.mark.parametrize("extra", [["_gone", "_again", "_bad", "_p", "_w", "_decided", "pass", "block", "block_at", "row_at"], ["row", "key", "k", "s", "document", "decided", "written", "predicted", "own", "at"]])
def test_clashing_names_keep_their_values(spark, extra):
    import corpus_pipeline

    mine = [F.lit(f"mine {c}").alias(c) for c in extra]
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("*", *mine)
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert set(extra) <= set(kept.columns), name
        assert [tuple(r) for r in kept.select(extra).distinct().collect()] == [tuple(f"mine {c}" for c in extra)], name
    other = [c for c in extra if c not in ("written", "decided", "key")]
    pages = table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "url", *mine)
    judged = urlfilter.judge(pages, queries.URL_RULES)
    assert [tuple(r) for r in judged.select(extra).distinct().collect()] == [tuple(f"mine {c}" for c in extra)]
    named = langid.identify(docs, langid.train(docs.limit(20)))
    assert [tuple(r) for r in named.select(other).distinct().collect()] == [tuple(f"mine {c}" for c in other)]
    turns = chat.canonical_turns(spark.createDataFrame([(1, '{"prompt": "q", "completion": "a"}')], "id int, record string"), "id").select("*", *mine)
    assert [tuple(r) for r in chat.format_turns(turns).select(extra).distinct().collect()] == [tuple(f"mine {c}" for c in extra)]


# token counts


def test_suffix_sums_against_brute_force(spark):
    sizes = [0, 0, 3, 3, 3, 1023, 1024, 1025, 5000, 5000, 70_000]
    counts = spark.createDataFrame([(n,) for n in sizes], "length bigint").groupBy("length").agg(F.count("*").alias("docs"))
    rows = {r["length"]: r for r in lengths.suffix_sums(counts, (2, 2048)).collect()}
    assert sorted(rows) == sorted({*sizes, 2, 2048})
    for limit, r in rows.items():
        assert r.docs == sizes.count(limit)
        assert r.truncated_tokens == sum(min(n, limit) for n in sizes)
        assert (r.docs_over, r.tokens_over) == (sum(n > limit for n in sizes), sum(n for n in sizes if n > limit))
        assert (r.total_docs, r.total_tokens) == (len(sizes), sum(sizes))
    for p in range(101):
        want = sorted(sizes)[max(0, math.ceil(p * len(sizes) / 100) - 1)]
        assert [n for n, r in rows.items() if r.first_percentile is not None and r.first_percentile <= p <= r.last_percentile] == [want]


def test_token_lengths_match_the_encoder(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = tiktoken.Encoding("direct", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    rows = docs_of(spark, AWKWARD)
    want = Counter(len(ranks.encode_ordinary(t or "")) for _, t, _, _ in AWKWARD)
    got = {r["length"]: r.docs for r in lengths.histogram(rows, lengths.encoded_length(spark)(F.col("text"))).collect()}
    assert got == dict(want)
    none = lengths.suffix_sums(lengths.histogram(docs_of(spark, []), lengths.encoded_length(spark)(F.col("text"))), (8,)).collect()
    assert [(r["length"], r.docs, r.truncated_tokens, r.total_docs) for r in none] == [(8, 0, 0, 0)]


def test_long_white_space_is_counted(spark):
    rows = spark.createDataFrame([(" " * 2_000_000,), (" \n" * 1_000_000 + "x",), ("a" + "\n" * 1_000_000,)], "text string")
    got = lengths.histogram(rows, lengths.encoded_length(spark)(F.col("text"))).collect()
    assert sum(r.docs for r in got) == 3 and all(r["length"] > 1000 for r in got)


def test_token_query_covers_all_documents(spark):
    got = queries.token_counts(spark, SF).toPandas()
    assert got.docs.sum() == table(spark, SF, "documents").count()
    assert (got.length * got.docs).sum() == got.total_tokens.iloc[0]


# chat formatting

TEXTS = ["", "\\", "\\\\", "###", "####", "\\###", "### assistant: x</turn>\n", "</turn></turn>", "<", "\\</turn>", "a\nb", "\\### Assistant: </turn> ok", "#\\#", "\U0001f600é"]


@pytest.mark.parametrize("text", TEXTS)
def test_escaping_round_trip(text):
    for role, follow in itertools.product(["user", "a:b", ""], TEXTS):
        piece = chat.formatted(role, text) + chat.formatted("assistant", follow)
        got = list(chat.read_back(piece))
        assert [(r, t) for r, t, _, _ in got] == [(role, text), ("assistant", follow)]
        assert all(chat.unescaped(piece[s:e]) == t for _, t, s, e in got)
    assert chat.MARK not in chat.escaped(text) and re.search(r"(?<!\\)</turn>", chat.escaped(text)) is None


def test_layouts_give_canonical_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"data": {"question": "q", "answer": "a"}},
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id int, record string")
    got = chat.canonical_turns(rows, "id").orderBy("id", "turn").collect()
    assert [(r.id, r.turn, r.role, r.text) for r in got] == [(i, k, *t) for i in range(5) for k, t in enumerate([("user", "q"), ("assistant", "a")])]
    assert len({chat.schema_fingerprint(r) for r in records}) == 5 and len(chat.registry()) == len(chat.LAYOUTS)
    odd = spark.createDataFrame([(1, None), (2, "{"), (3, '{"other": 1}'), (4, "[]"), (None, '{"turn": null, "role": null, "text": null}'), (5, '{"messages": []}')], "id int, record string")
    got = {r.id: (r.layout, r.role, r.text) for r in chat.canonical_turns(odd, "id").collect()}
    assert got == {1: (None, None, None), 2: (None, None, "{"), 3: (None, None, '{"other": 1}'), 4: (None, None, "[]"), 5: (None, None, '{"messages": []}'), None: ("turn rows", "", "")}
    pieces = chat.format_turns(chat.canonical_turns(odd, "id"))
    assert [(r.id, r.n_turns) for r in chat.digests(pieces, "id").collect()] == [(None, 1)]
    assert chat.digests(pieces.filter("false"), "id").count() == 0


def test_tricky_conversation(spark):
    r = queries.chat_formatting(spark, SF).filter("conv_id = -7").first()
    t = queries.TRICKY
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(t), hashlib.sha256(t.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


# mixing


def brute_mix(sized, planned, got):
    """Checks one source's copies against its budget."""
    for source, p in planned.items():
        mine = [r for r in got if r["source"] == source]
        tokens = {r["doc_id"]: r["tokens"] for r in sized if r["source"] == source}
        passes = defaultdict(list)
        for r in mine:
            passes[r["pass"]].append(r)
        for k in range(p.passes):
            assert sorted(r.doc_id for r in passes[k]) == sorted(tokens)
        last = passes.get(p.passes, [])
        spent = sum(tokens[r.doc_id] for r in last)
        assert set(passes) <= set(range(p.passes + 1)) and spent <= p.rest
        order = sorted(tokens, key=lambda i: next((r.block_at, r.block, r.row_at) for r in all_last[source] if r.doc_id == i)) if source in all_last else []
        want, left = [], p.rest
        for i in order:
            if tokens[i] > left:
                break
            want.append(i)
            left -= tokens[i]
        if order:
            assert sorted(want) == sorted(r.doc_id for r in last)


all_last: dict = {}


def test_mixing_spends_each_budget(spark):
    sized = mixing.sized_rows(table(spark, SF, "documents"))
    planned = mixing.plan(mixing.source_table(sized, "source"), max_repeats=1.5)
    rows = {r.source: r for r in planned.collect()}
    got = mixing.mix(sized.withColumnRenamed("_tokens", "tokens"), sized, planned).collect()
    copies = mixing._copies(sized.select(F.col("doc_id").alias("k"), F.col("source").alias("s"), "_tokens"), planned, 7).filter("pass = passes")
    for r in copies.collect():
        all_last.setdefault(r.s, []).append(type("R", (), {"doc_id": r.k, "block_at": r.block_at, "block": r.block, "row_at": r.row_at}))
    plain = [r.asDict() for r in sized.withColumnRenamed("_tokens", "tokens").collect()]
    brute_mix(plain, rows, got)
    repeats = {s: r.budget / r.tokens for s, r in rows.items()}
    assert max(repeats.values()) == pytest.approx(1.5, rel=1e-2) and min(repeats.values()) == pytest.approx(1.0)
    weights = [r.weight for r in rows.values()]
    assert sum(weights) == pytest.approx(1) and all(r.weight == pytest.approx(r.budget / sum(x.budget for x in rows.values()), rel=1e-3) for r in rows.values())


def test_mixing_by_entropy(spark):
    sources = spark.createDataFrame([("a", 1, 1000), ("b", 1, 100), (None, 1, 10)], "source string, docs bigint, tokens bigint")
    rows = mixing.plan(sources, max_repeats=None, entropy=0.9, budget=600).collect()
    assert -sum(r.weight * math.log(r.weight) for r in rows) == pytest.approx(0.9, abs=1e-6)
    assert sum(r.budget for r in rows) == pytest.approx(600, abs=2)
    assert mixing.exponent_for_entropy(sources, 0.0) == 1.0 and mixing.exponent_for_entropy(sources, 9.0) == 0.0


def test_mixing_edges(spark):
    rows = docs_of(spark, AWKWARD)
    got = mixing.mixed(rows, max_repeats=1.5)
    assert {c for c in got.columns} == {*rows.columns, "block", "block_at", "row_at"}
    first = got.filter("pass = 0")
    assert first.count() == len(AWKWARD) and got.count() >= len(AWKWARD)
    assert mixing.mixed(docs_of(spark, [])).count() == 0


# decontamination

ITEM = "In the village market Anna sold 12 baskets of plums to Carl, and later Anna gave 30 more baskets to him for 5 kg of flour."


def test_reparameterised_questions_are_found(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (4, "a wholly different text about nothing that occurs in any document at all today")], "item_id int, text string")
    same = ITEM.replace("Anna", "Berta").replace("Carl", "Dora").replace("12", "77").replace("30", "3.5").replace("5 kg", "9 pounds")
    mixed_up = ITEM.replace("later Anna", "later Emil").replace("12", "77")
    rows = docs_of(spark, [
        (1, "Before it. " + ITEM + " After it.", "en", "a"), (2, "so " + same, "en", "a"), (3, "so " + mixed_up, "en", "a"), (4, ITEM.upper().lower(), "en", "a"),
        (5, " ".join(ITEM.split()[:9]), "en", "a"), (6, None, "en", "a"), (7, "", "en", "a"), (None, "x " + ITEM, "en", "a"), (8, "nothing of it " * 40_000, "en", "a"), (1, "again", "en", "a"),
    ])
    got = {r.doc_id: r for r in decontamination.contaminated(rows, bench).collect()}
    assert {1, 2, None} <= set(got) and not {5, 6, 7, 8} & set(got)
    assert got[1].verbatim and not got[2].verbatim and got[1].item_ids == [1]
    swapped = decontamination.contaminated(rows.filter("doc_id = 3"), bench, coverage=0.8).collect()
    assert swapped == []
    kept = decontamination.without_contaminated(rows, bench)
    assert kept.columns == rows.columns and kept.filter("text = 'again'").count() == 1 and kept.filter("doc_id is null").count() == 0
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontamination.contaminated(rows, none).count() == 0 and decontamination.contaminated(docs_of(spark, []), bench).count() == 0


def test_copies_are_found_whatever_their_case_and_breaks(spark):
    short = "Seven apples lie in Anna's basket all day"
    bench = spark.createDataFrame([(1, ITEM), (2, short)], "item_id int, text string")
    copies = [ITEM.upper(), ITEM.lower(), ITEM.title(), ITEM.replace(" ", "\n"), "so, " + short, "AND, " + short.upper(), short.lower(), "x " + short.replace(" ", "  ")]
    got = {r.doc_id: r for r in decontamination.contaminated(docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(copies)]), bench).collect()}
    assert {i: (r.item_ids, r.coverage, r.verbatim) for i, r in got.items()} == {i: ([1 if i < 4 else 2], 1.0, True) for i in range(len(copies))}


def test_every_copy_is_judged_by_itself(spark):
    item = "A shop sells 4 red pens and 5 blue pens. It gets 4 more and sells 5 more."
    other, third = (item.replace("4", a).replace("5", b) for a, b in (("3", "9"), ("8", "2")))
    longer = other.replace("red pens", "new red pens")
    texts = [item + " " + other, other + " " + third, third + " then came " + other + " " + item, other, "It gets 3 more and sells 9 more.", longer + " " + longer]
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    got = {r.doc_id: r for r in decontamination.contaminated(docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), bench).collect()}
    assert all(got[i].coverage == 1.0 for i in range(4)) and 4 not in got
    assert [got[i].verbatim for i in range(4)] == [True, False, True, False]
    mixed = item.replace("sells 4", "sells 3").replace("and 5", "and 9").replace("gets 4", "gets 6").replace("sells 5", "sells 1")
    alone = decontamination.contaminated(docs_of(spark, [(1, mixed, "en", "a")]), bench, coverage=0.9).collect()
    assert alone == []


def test_whole_items_are_found_whatever_their_case(spark):
    sf = "/root/testdata/sf0.1"
    items = [(r.item_id, " ".join(brute_words(r.text))) for r in table(spark, sf, "benchmark").collect()]
    docs = [(r.doc_id, " ".join(brute_words(r.text or ""))) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t and f" {x} " in f" {t} "}
    got = {(r.doc_id, i) for r in queries.benchmark_decontamination(spark, sf).collect() for i in r.item_ids}
    assert len(want) >= 247 and want <= got


def brute_words(text):
    return [w for w in re.sub(r"[^\w\s]|_", "", text.lower()).split() if w]


def test_decontamination_against_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    items = [(r.item_id, brute_words(r.text)) for r in table(spark, SF, "benchmark").collect()]
    windows = defaultdict(set)
    for i, w in items:
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].add(i)
    sizes = {i: len({tuple(w[k : k + 8]) for k in range(len(w) - 7)}) for i, w in items}
    want = defaultdict(set)
    for r in docs:
        w, held = brute_words(r.text), defaultdict(set)
        for k in range(len(w) - 7):
            for i in windows.get(tuple(w[k : k + 8]), ()):
                held[i].add(tuple(w[k : k + 8]))
        for i, h in held.items():
            if len(h) >= 0.5 * sizes[i]:
                want[r.doc_id].add(i)
    got = {r.doc_id: set(r.item_ids) for r in queries.benchmark_decontamination(spark, SF).collect()}
    assert got == dict(want)


def test_decontamination_runs_no_python(spark):
    plan = queries.benchmark_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# exact top-k


def brute_top_k(rows, width, k=10):
    """Each query id's best pairs of one of its rows with a row of another id."""
    whole = [(i, np.array([math.floor(1024 * x) for x in v] + [0] * (width - len(v)), dtype=np.int64)) for i, v in rows]
    out = []
    for q in {i for i, _ in whole if i % 100 == 0}:
        best = sorted((-int(x @ v), i) for p, x in whole if p == q for i, v in whole if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.2, (700, 12))
    vectors[100:160] = vectors[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, [float("nan")] * 12), (1002, [None] + [0.5] * 11), (1003, [float("inf")] * 12), (None, [9.0] * 12), (1004, []), (1100, [0.5] * 3), (7, [0.0] * 12)]
    odd += [(200, [0.9] * 12), (300, rows[300][1]), (300, rows[300][1]), *[(7, rows[100][1])] * 15]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id bigint, embedding array<double>, score string")
    want = brute_top_k([*rows, *(r for r in odd if r[0] in (1004, 1100, 7, 200, 300))], 12)
    got = impact.top_k(df, F.col("vec_id") % 100 == 0, block=100, chunk=3)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert impact.top_k(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert impact.top_k(df.filter("vec_id in (400, 201)"), F.col("vec_id") % 100 == 0).count() == 1


def test_top_k_of_too_large_components_raises(spark):
    df = spark.createDataFrame([(0, [1e10, 1.0]), (1, [1e10, 2.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError):
        impact.top_k(df, F.col("vec_id") == 0)
    got = impact.top_k(df, F.col("vec_id") == 0, scale=1 / 16)
    assert [r.score for r in got.collect()] == [625_000_000**2]


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_of_repeated_ids_against_sql(spark, seed, tmp_path):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 3) / 8]) for i in rng.choice([0, 1, 2, 3, 100], 60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.SQL["op6_exact_top_k"]).fetchall()
    got = impact.top_k(df, F.col("vec_id") % 100 == 0, block=7, chunk=4).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_index_stops_before_the_end(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-300, 300, (4000, 16))
    vectors[:12] *= 20
    index = impact.ImpactIndex(vectors)
    touched = []
    index.members = [m for m in index.members]

    class Spy(list):
        def __getitem__(self, k):
            touched.append(k)
            return super().__getitem__(k)

    index.members = Spy(index.members)
    ids = np.arange(4000)
    at, scores = index.search(vectors[0], 5, ids == 0, ids)
    exact = vectors @ vectors[0]
    order = [i for i in np.lexsort((ids, -exact)) if i != 0][:5]
    assert list(at) == order and list(scores) == list(exact[order]) and len(touched) < len(index.members)


# URL filters


def brute_rule(rules, host, path):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fit, key=urlfilter.precedence) if fit else None


def test_url_rules_against_brute_force(spark):
    raw = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/x"), ("allow", "a.example.net", ""), ("block", "org", "/fr/"), ("allow", "org", "/fr/"), ("block", "b.org", "/f")]
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET", "http://example.net/en/x1?q", "http://example.net/en/y#f", "http://example.net/en", "http://example.net?x", "http://c.b.org/fr/1", "http://b.org/f", "x://b.org:80/f", "http://net/", "http://xnet/", "http://.net/a", "a://b://c.net/"]
    urls += [f"http://{h}/{p}" for h, p in itertools.product(["a.example.net", "q.a.example.net", "example.net", "b.org", "org"], ["", "en", "en/", "en/x/", "fr/", "f", "//"])]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    rules = urlfilter._ordered(raw)
    by_join = spark.createDataFrame(raw, "verdict string, host string, path string")
    for got in (urlfilter.judge(pages, raw, default="none"), urlfilter.judge_by_join(pages, by_join, default="none")):
        rows = got.collect()
        assert len(rows) == len(urls) and got.columns.count("rule") == 1
        for r in rows:
            m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
            host, path = (m[1].lower(), m[2]) if m else ("", "")
            want = brute_rule(rules, host, path)
            assert (r.host, r.path) == (host, path)
            assert (r.rule, r.verdict) == ((want.name, want.verdict) if want else (None, "none")), r.url
    assert urlfilter.judge(pages.filter("false"), raw).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, []).collect()} == {"allow"}


# quality


def test_quality_on_held_out(spark):
    labels = table(spark, SF, "labels").select("doc_id", "quality")
    got = queries.quality_classifier(spark, SF)
    assert got.count() == table(spark, SF, "documents").count()
    got = got.join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(bad) > 3 and (good.predicted == 1).mean() > 0.95 and (bad.predicted == 0).mean() > 0.7
    assert good.score.min() >= 0 and got.score.max() <= 1


def test_negative_labels_are_not_used(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    a = quality.train(docs, labels)
    b = quality.train(docs, labels.filter("quality = 1"))
    assert np.allclose(a.weights, b.weights) and 0.5 < a.prior <= 0.98


def test_non_negative_risk_recovers_the_classes():
    rng = np.random.default_rng(3)
    width = len(quality.FEATURES)
    p, n = rng.normal(1, 1, (1500, width)) * 0.3, rng.normal(-1, 1, (450, width)) * 0.3
    model = quality.fit(p[:500], np.vstack([p[500:], n]))
    assert abs(model.prior - 1000 / 1450) < 0.12
    assert (model.scores(p) >= 0.5).mean() > 0.95 and (model.scores(n) < 0.5).mean() > 0.95


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 1), (6, 0), (6, 1)], "doc_id bigint, quality int")
    rows = docs_of(spark, AWKWARD)
    for model in (quality.train(rows, labels, folds=2, held_out=7), quality.train(rows, labels.filter("false")), None):
        got = quality.classify(rows, model).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert quality.train(docs_of(spark, []), labels) is None and quality.classify(docs_of(spark, []), None).count() == 0


# sharding


def test_table_is_balanced_and_stable():
    names = [f"s{k}" for k in range(13)]
    full = sharding.fill_table(names, 2003)
    shares = Counter(full)
    assert max(shares.values()) - min(shares.values()) <= 1 and set(full) == set(range(13))
    less = sharding.fill_table(names[:-1], 2003)
    moved = sum(names[a] != names[b] for a, b in zip(full, less, strict=True) if names[a] != "s12")
    assert moved < 0.25 * 2003
    with pytest.raises(ValueError):
        sharding.fill_table(names, 2000)


def test_preferences_are_permutations_and_claimed_in_turn():
    names, size = ["x", "y", "z"], 31
    wish = {}
    for n in names:
        offset, skip = sharding._hash(n, "offset") % size, sharding._hash(n, "skip") % (size - 1) + 1
        wish[n] = [(offset + k * skip) % size for k in range(size)]
        assert sorted(wish[n]) == list(range(size))
    slots = {}
    while len(slots) < size:
        for i, n in enumerate(names):
            if len(slots) < size:
                slots[next(s for s in wish[n] if s not in slots)] = i
    assert [slots[s] for s in range(size)] == sharding.fill_table(names, size)


def test_placement(spark):
    got = queries.shard_placement(spark, SF).toPandas()
    full = sharding.fill_table(queries.SHARDS)
    assert len(got) == table(spark, SF, "documents").count()
    for r in got.itertuples():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, full[slot])
    rows = docs_of(spark, AWKWARD).withColumn("shard", F.lit("old"))
    edge = sharding.place(rows, ["a", "b"], size=101)
    assert edge.count() == len(AWKWARD) and edge.filter("doc_id is null").select("shard").distinct().count() == 1
    assert sharding.place(docs_of(spark, []), ["a"]).count() == 0


def test_write_shards(spark, tmp_path):
    placed = sharding.place(docs_of(spark, AWKWARD), ["a", "b", "c"], size=101)
    sharding.write_shards(placed, str(tmp_path / "out"), pieces=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(AWKWARD)


# SimHash


def slow_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """doc_id -> smallest reachable, by comparing all pairs."""
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_near_duplicates_against_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    prints = {r.doc_id: slow_simhash(r.text) for r in docs}
    want = components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.near_duplicate_components(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_links_keep_components_in_crowded_lists(spark):
    rng = np.random.default_rng(11)
    centre = int(rng.integers(0, 1 << 62))
    prints = {i: centre for i in range(1)}
    for i in range(1, 260):
        f = prints[int(rng.integers(0, i))]
        for bit in rng.integers(0, 24 if i % 3 else 64, int(rng.integers(1, 5))):
            f ^= 1 << int(bit)
        prints[i] = f
    want = components(prints)
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "doc_id bigint, fp bigint")
    for tile in (16, 1024):
        edges = simhash.links(rows, tile=tile)
        roots = {r.node: r.root for r in simhash.smallest_reachable(edges).collect()}
        group = defaultdict(set)
        for r in rows.collect():
            group[roots.get(r.fp, r.fp)].add(r.doc_id)
        assert sorted(map(sorted, group.values())) == sorted(sorted(i for i in want if want[i] == w) for w in set(want.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 300), (300, 100)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.smallest_reachable(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100, 300: 100}


def test_few_edges_are_joined_in_two_tables_and_many_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = [(i, i + 1) for i in range(40)] + rng.integers(100, 400, (150, 2)).tolist() + [(7, 7), (9, 8)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(6)
    group = {x: x for p in pairs for x in p}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    want, labels, write = {x: r for x, r in group.items() if x != r}, [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, label: labels.append(label) or write(df, label))
    assert {r.node: r.root for r in simhash.smallest_reachable(edges).collect()} == want and len(labels) <= 2
    assert {r.node: r.root for r in simhash.smallest_reachable(edges, most=16).collect()} == want and len(labels) > 4


def test_chains_of_any_order_are_joined():
    for ids in (np.arange(50_000), np.random.default_rng(3).permutation(50_000)):
        child, root = simhash.spanning(ids[1:], ids[:-1])
        assert sorted(child) == list(range(1, 50_000)) and set(root) == {0}


def test_near_duplicate_edges(spark):
    got = simhash.near_duplicates(docs_of(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_representative_edges(spark):
    rows = docs_of(spark, AWKWARD).select("*", *(F.lit(7).alias(c) for c in ("row", "row_key", "root", "sid", "_gone", "_again", "keeper", "bits")))
    kept = shingles.representatives(rows)
    assert kept.columns == rows.columns and {r._gone for r in kept.collect()} == {7}
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 4, 6, 7, 8, 9]
    assert shingles.representatives(docs_of(spark, [])).count() == 0


def jaccard_groups(texts, similarity=0.8, width=5):
    """The smallest id of each id's group, by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset([tuple(w)] if w else [])
    where, least = defaultdict(list), {i: i for i in sets}
    for i in sorted(sets):
        for x in sets[i] or [None]:
            where[x].append(i)

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in {p for held in where.values() for p in itertools.combinations(held, 2)}:
        both = len(sets[a] & sets[b])
        if not sets[a] or both / (len(sets[a]) + len(sets[b]) - both) >= similarity:
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("tile", [3, 512])
def test_jaccard_roots_against_all_pairs(spark, tile):
    import random

    rng = random.Random(tile)
    bases = [[f"{b}.{k}" for k in range(60)] for b in range(3)]
    texts = {}
    for i in range(150):  # copies with some words changed, around the limit, that share a hot passage
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        texts[i] = " ".join(words + ["hot"] * rng.choice([0, 6]) + [f"h{k}" for k in range(rng.choice([0, 20]))])
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(6)
    texts_ = shingles._texts(rows, F.xxhash64("doc_id", "text"), "doc_id", "text")
    sketches = shingles._sketches(texts_, 0.8, 5)
    roots = {r.sid: r.root for r in shingles.roots(texts_, sketches, tile=tile).collect()}
    got = {r.doc_id: roots.get(r.sid, r.sid) for r in sketches.collect()}
    want = jaccard_groups(texts)
    assert len(set(want.values())) > 5
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a, b in itertools.combinations(texts, 2))


def test_bitmaps_grow_with_sets_and_fold():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1024, 1025, 5000, 40_000):
        items = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        bits = shingles.bitmap(items)
        assert 64 * len(bits) == min(max(1024, 2 ** math.ceil(math.log2(max(n, 1)))), shingles.MOST_BITS)
    long, short = np.unique(rng.integers(0, 2**62, 1100)), None
    short = long[:1000]
    both = [(7, 1, long), (9, 2, short), (3, 3, np.unique(rng.integers(0, 2**62, 1000))), (5, 4, short[:700])]
    rows = [{"sid": s, "root": r, "n": len(x), "own": 0, "bits": shingles.bitmap(x).tolist()} for s, r, x in both]
    tile = pa.array(rows, pa.struct([("sid", pa.int64()), ("root", pa.int64()), ("n", pa.int32()), ("own", pa.int64()), ("bits", pa.list_(pa.int64()))]))
    for order in itertools.permutations(range(4)):
        a, b = shingles._allowed(tile.take(pa.array(order)), False, 0.8)
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(9, 7)]


def test_list_of_alike_sets_leaves_a_forest_not_its_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 300)
    sets = [np.unique(np.r_[base, rng.integers(0, 2**62, 8)]) for _ in range(120)]
    mixed = spark.createDataFrame([(1, 1, len(sets), i, i) for i in range(len(sets))], "key bigint, lists bigint, c bigint, sid bigint, root bigint")
    marks = spark.createDataFrame([(i, len(x), shingles.bitmap(x).tolist()) for i, x in enumerate(sets)], "sid bigint, n int, bits array<bigint>")
    for tile in (50, 512):
        rows = shingles._meetings(mixed, marks, 0.8, tile).collect()
        assert len(rows) < 3 * len(sets) and {r.a for r in rows} | {r.b for r in rows} == set(range(len(sets)))


def test_linked_tiles_return_forests_of_exact_links():
    rng = np.random.default_rng(6)
    bases = [rng.integers(0, 2**62, 200) for _ in range(3)]
    sets = [np.unique(np.r_[bases[i % 3][: 200 - 4 * (i // 3)], rng.integers(0, 2**62, 3)]) for i in range(30)]
    names = ["sid", "root", "n", "own", "bits"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    rows = list(zip(*[(1000 - i, 1000 - i, len(x), i % 2, shingles.bitmap(x).tolist()) for i, x in enumerate(sets)], strict=True))
    tile = pa.StructArray.from_arrays([pa.array(list(r), k) for r, k in zip(rows, kinds, strict=True)], names=names)
    items = pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))
    for crossed in (False, True):
        got = shingles._linked(tile, items, crossed, 0.8)
        where = lambda x: 1000 - x
        assert len(got) == 27 and all(len(np.intersect1d(sets[where(a)], sets[where(b)])) / len(np.union1d(sets[where(a)], sets[where(b)])) >= 0.8 for a, b in got)
        assert not crossed or all((a - b) % 2 for a, b in got)


def test_simhash_proposes_links_between_sets(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    texts = [(i, " ".join([*words[:400 - i], *(f"x{i}.{k}" for k in range(i))])) for i in range(6)] + [(9, "some other text of few words")]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    sketches = shingles._sketches(shingles._texts(rows, F.xxhash64("doc_id", "text"), "doc_id", "text"), 0.8, 5).cache()
    held = {r.sid: r for r in sketches.collect()}
    for i, t in texts:
        items = shingles.shingle_hashes(t.encode())
        bits = "".join("1" if 2 * sum(int(x) >> k & 1 for x in items) > len(items) else "0" for k in reversed(range(64)))
        assert [r.fp for r in held.values() if r.doc_id == i] == [int(bits, 2) - (int(bits[0]) << 64)]
    pairs = {(r.a, r.b) for r in shingles._simhash_pairs(sketches).collect()}
    assert pairs and all(9 not in (held[a].doc_id, held[b].doc_id) for a, b in pairs)
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: asked.append(1) or links(*a))
    assert sorted(r.doc_id for r in shingles.representatives(rows).collect()) == [0, 9] and asked


def test_long_texts_of_one_passage_and_near_copies_of_two_lengths(spark):
    import random

    rng = random.Random(1)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    passage, base = fresh(60), fresh(2000)
    texts = {i: " ".join(fresh(1500) + passage + fresh(500)) for i in range(12)}
    for i in range(12, 20):  # a chain of near copies across the step from 2048 bits to 4096
        base = base + fresh(30)
        texts[i] = " ".join(base)
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = sorted(r.doc_id for r in shingles.representatives(rows).collect())
    assert got == sorted(set(jaccard_groups(texts).values())) == [*range(13)]


def test_held_out_remainder(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id bigint").withColumn("r", crc_of("doc_id", 4)).collect()
    assert all(r.r == (zlib.crc32(str(r.doc_id).encode()) % 4 if r.doc_id is not None else 0) for r in rows)
