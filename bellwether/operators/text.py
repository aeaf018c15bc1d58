"""Vocabulary, event triples, training pairs and argument vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.functions import vectors as V
from bellwether.functions.scalar import mix
from bellwether.operators import ranks as R
from bellwether.operators import skipgram as S
from bellwether.session import frozen


def vocabulary(tokens: DataFrame, min_count: int = 5) -> DataFrame:
    """Tokens with at least ``min_count`` uses, numbered by descending count, then spelling."""
    c = tokens.groupBy("form").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    return R.global_rank(c, [F.desc("n"), F.asc("form")], "word_id")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last(tags: Column, mark: str) -> Column:
    """Place (from 1) at which the last such mark ends; 0 without one."""
    return F.when(F.contains(tags, F.lit(mark)), F.length(tags) - F.length(F.substring_index(tags, mark, -1))).otherwise(F.lit(0))


def _noun_run(tags: Column) -> Column:
    """Place and length of the last run of nouns."""
    def of(upto: Column) -> Column:
        return _bind(F.length(F.rtrim(upto, F.lit("N"))), lambda n: F.struct((n + 1).alias("at"), (F.length(upto) - n).alias("n")))

    return _bind(F.rtrim(tags, F.lit("SOVA-")), of)


def _triple(toks: Column, tags: Column) -> Column:
    """The parts of one text as a struct, null if it lacks one."""
    before = lambda place: tags.substr(F.lit(1), place - 1)
    words = lambda run: F.slice(toks, run["at"], run["n"])
    tail = tags.substr(F.instr(tags, "N"), F.length(tags))
    facts = F.struct(
        F.struct(F.instr(tags, "N").alias("at"), (F.length(tail) - F.length(F.ltrim(tail, F.lit("N")))).alias("n")).alias("first"),
        _noun_run(tags).alias("final"), F.position(F.lit("S"), tags, F.instr(tags, "N")).alias("s"),
        _last(tags, "O").alias("o"), _last(tags, "V").alias("v"), _last(tags, "NA").alias("a"))

    def chosen(x: Column) -> Column:
        subject = F.when(x["s"] > 0, _noun_run(before(x["s"]))).otherwise(x["first"])
        marked = F.when(x["o"] > x["first"]["at"], _noun_run(before(x["o"]))).otherwise(x["final"])
        moved = lambda y: F.when(y["o1"]["at"] != x["final"]["at"], x["final"]).otherwise(x["first"])
        verb = F.when(x["a"] > x["v"], words(_noun_run(before(x["a"])))).otherwise(F.array(F.get(toks, x["v"] - 1)))
        found = _bind(F.struct(subject.alias("o1"), marked.alias("o2")), lambda y: F.struct(
            words(y["o1"]).alias("o1"), verb.alias("p"),
            words(F.when(y["o1"]["at"] == y["o2"]["at"], moved(y)).otherwise(y["o2"])).alias("o2")))
        return F.when((x["first"]["at"] > 0) & (x["first"]["at"] != x["final"]["at"]) & (x["v"] + x["a"] > 0), found)

    return _bind(facts, chosen)


def triples_from_tags(tagged: DataFrame, key: str = "news_id") -> DataFrame:
    """Actor, predicate and object of each tagged text: ``toks``, its tokens, and ``tags``, a text with one letter per token.

    Tags: N noun, S / O subject and object marks (on the phrase before them), V verb,
    A action suffix (turns the noun phrase right before it into a predicate). Noun runs
    are phrases. The actor is the first subject-marked phrase or the
    first one; the object is the last object-marked phrase or the last one, moved to
    another phrase when both fall together; the predicate is the last one. Texts with fewer than two phrases, without
    predicate, or with equal parts give nothing. Places are found in the text of tags, so tokens
    stay in their row: nothing is exchanged or sorted.
    """
    row = F.array(F.struct("toks", F.regexp_replace("tags", "[^NSOVA]", "-").alias("tags")))
    g = tagged.select(key, F.inline_outer(F.transform(row, lambda x: _triple(x["toks"], x["tags"]))))
    return g.filter((F.col("o1") != F.col("p")) & (F.col("o2") != F.col("p")) & (F.col("o1") != F.col("o2")))


def event_vocabulary(events: DataFrame, train: Column) -> DataFrame:
    """Event keys numbered by descending frequency in the training period."""
    c = events.filter(train).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return R.global_rank(c, [F.desc("n"), F.asc("key")], "event_id")


def event_ids(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """Attach the event number; keys unseen in training get 0."""
    return events.join(vocab.select("key", "event_id"), "key", "left").withColumn(
        "event_id", F.coalesce("event_id", F.lit(0)))


def skipgram_pairs(texts: DataFrame, vocab: DataFrame, window: int = 5, t: float = 1e-3,
                   seed: int = 13) -> DataFrame:
    """(center, context) counts for skip-gram training, from ``texts`` (news_id, toks).

    Frequent words are thinned with the usual keep probability; each kept position draws
    a reach in 1..window. Draws are hashed from (text, position), so they repeat exactly.
    Words go to all tasks, so tokens stay where they are; what moves are the counts of each task, packed. Texts of the same
    news_id count as one, their tokens in the order of their places; only these texts are moved.
    """
    total = vocab.agg(F.sum("n").alias("_total"))
    v = R.with_scalars(vocab, total)
    z = F.col("n") / F.col("_total")
    keep = F.least(F.lit(1.0), (F.sqrt(z / t) + 1) * (t / z))
    listed = v.select("form", "word_id", "n", keep.alias("keep")).toArrow().sort_by("word_id").combine_chunks()
    if not listed.num_rows:
        return texts.sparkSession.createDataFrame([], "center bigint, context bigint, n bigint")
    kept = (listed["n"].to_numpy() * listed["keep"].to_numpy()).sum()
    buckets = int(kept * (window + 1) // S.BUCKET) + 1
    shared = texts.sparkSession.sparkContext.broadcast((pa.concat_arrays(listed["form"].chunks), listed["word_id"].to_numpy(), listed["keep"].to_numpy()))

    def count(batches):
        words, _, keep = shared.value
        packer = S.Packer(len(words), buckets)

        def packed():
            found = list(packer.blobs())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                              ["bucket", "pairs", "body", "counts"])

        for b, ids, row, pos, known in S.numbered(batches, words):
            if "pos" in b.schema.names:
                pos = b.column("pos").flatten().to_numpy(zero_copy_only=False)[known].astype(np.int64)
            news = b.column("news_id").to_numpy(zero_copy_only=False)[row].astype(np.int64)
            on = S.draws(news, pos, seed) / 2147483647.0 < keep[ids]
            ids, row, pos, news = ids[on], row[on], pos[on], news[on]
            reach = np.fmod(S.draws(pos, news, seed + 1), window) + 1
            for center, context in S.neighbours(row, reach, window, 0, len(ids)):
                packer.add(ids[center], ids[context])
            if packer.n >= S.FLUSH:
                yield packed()
        if packer.n:
            yield packed()

    def joined(blobs: pa.Table) -> pa.Table:
        words, numbers, _ = shared.value
        rows = zip(*(blobs[c].to_pylist() for c in ("pairs", "body", "counts")), strict=True)
        center, context, n = S.Packer(len(words), buckets).pairs(blobs["bucket"][0].as_py(), rows)
        return pa.table({"center": numbers[center], "context": numbers[context], "n": n})

    texts = texts.filter("news_id is not null and toks is not null").select("news_id", "toks")
    schema = "bucket int, pairs bigint, body binary, counts binary"
    again = frozen(texts.groupBy("news_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("news_id"))
    if again.isEmpty():
        blobs = texts.coalesce(texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(count, schema)
    else:
        places = texts.join(again, "news_id", "left_semi").select("news_id", F.posexplode("toks").alias("pos", "form"))
        one = places.groupBy("news_id").agg(F.sort_array(F.collect_list(F.struct((F.col("pos") + 1).alias("pos"), "form"))).alias("_t"))
        one = one.select("news_id", F.col("_t.form").alias("toks"), F.col("_t.pos").alias("pos"))
        blobs = texts.join(again, "news_id", "left_anti").mapInArrow(count, schema).unionByName(one.mapInArrow(count, schema))
    return blobs.groupBy("bucket").applyInArrow(joined, "center bigint, context bigint, n bigint")


def _argument_words(events: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, arg, vec): the known words of actor, predicate and object, one row per use."""
    arg = F.explode(F.array(*[F.struct(F.lit(a).alias("arg"), F.col(a).alias("ws")) for a in ("o1", "p", "o2")]))
    long = events.select(key, arg.alias("a")).select(key, "a.arg", F.explode("a.ws").alias("form"))
    return long.join(words.filter("vec is not null").select("form", "vec"), "form").select(key, "arg", "vec")


def known_events(events: DataFrame, words: DataFrame, key: str = "news_id") -> DataFrame:
    """The keys of events whose actor, predicate and object each have a known word; vectors are not moved."""
    bit = F.when(F.col("arg") == "o1", 1).when(F.col("arg") == "p", 2).otherwise(4)
    return _argument_words(events, words, key).groupBy(key).agg(F.bit_or(bit).alias("_args")).filter("_args = 7").select(key)


def argument_vectors(events: DataFrame, words: DataFrame, key: str = "news_id") -> DataFrame:
    """Mean word vector of actor, predicate and object; only events with all three known.

    Words are dealt out by event once, so both groupings stay in their task and no buffers of means are exchanged."""
    m = V.vector_mean(_argument_words(events, words, key).repartition(key), [key, "arg"], "vec", "vec")
    g = m.groupBy(key).agg(*[F.max(F.when(F.col("arg") == a, F.col("vec"))).alias(f"v_{a}") for a in ("o1", "p", "o2")])
    return g.filter("v_o1 is not null and v_p is not null and v_o2 is not null")


def corrupt_events(events: DataFrame, vocab: DataFrame, seed: int = 13, key: str = "news_id") -> DataFrame:
    """Negative samples: the actor or the object is replaced by as many random vocabulary words.

    Word numbers are hashed from (event, position) and joined, so no vocabulary is broadcast.
    """
    size = vocab.agg(F.count(F.lit(1)).alias("_v"))
    e = R.with_scalars(events, size)
    which = (mix(F.col(key), F.lit(0), seed) % 2).cast("int")
    e = e.withColumn("which", which)
    n = F.greatest(F.size(F.when(F.col("which") == 0, F.col("o1")).otherwise(F.col("o2"))), F.lit(1))
    draw = e.select(key, "which", "_v", F.posexplode(F.sequence(F.lit(1), n)).alias("i", "_s"))
    draw = draw.withColumn("word_id", mix(F.col(key), F.col("i") + 1, seed) % F.col("_v") + 1)
    words = draw.join(vocab.select("word_id", "form"), "word_id").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("i", "form"))).alias("_w"))
    j = e.drop("_v").join(words, key)
    repl = F.transform("_w", lambda x: x["form"])
    return j.select(key, "which", F.when(F.col("which") == 0, repl).otherwise(F.col("o1")).alias("o1"), "p",
                    F.when(F.col("which") == 1, repl).otherwise(F.col("o2")).alias("o2"))


def standardise(vectors: DataFrame, vec: str, fit: Column, floor: float = 1e-6) -> DataFrame:
    """Per-dimension (x - mean) / (population deviation + floor), fitted on ``fit`` rows.

    Mean and variance come from one pass of partial aggregates; the two fitted vectors are
    all that is attached to the rows.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    x = V.as_dense(vec)
    s = vectors.filter(fit).agg(
        vector_to_array(Summarizer.mean(x)).alias("_m"),
        vector_to_array(Summarizer.variance(x)).alias("_v"),
        F.count(F.lit(1)).alias("_n"))
    s = s.withColumn("_sd", F.transform(
        "_v", lambda q: F.sqrt(q * (F.col("_n") - 1) / F.col("_n")) + floor))  # sample to population
    j = R.with_scalars(vectors, s.select("_m", "_sd"))
    z = F.zip_with(F.zip_with(F.col(vec), F.col("_m"), lambda a, m: a.cast("double") - m),
                   F.col("_sd"), lambda d, sd: d / sd)
    return j.withColumn("z", z).drop("_m", "_sd")


def event_stats(n_texts: DataFrame, events: DataFrame, known: DataFrame, cutoff: str) -> DataFrame:
    """Events found, how many have all arguments in the vocabulary, eligible share."""
    e = events.join(known.select("news_id", F.lit(1).alias("_ok")), "news_id", "left")
    s = e.agg(F.count(F.lit(1)).alias("rows"), F.count("_ok").alias("in_vocab"),
              F.avg(F.when(F.to_date("published_at") < F.lit(cutoff).cast("date"), 1.0).otherwise(0.0)).alias("eligible"))
    t = n_texts.agg(F.count(F.lit(1)).alias("texts"))
    return R.with_scalars(s, t).withColumn("in_vocab_ratio", F.col("in_vocab") / F.nullif(F.col("rows"), F.lit(0).cast("bigint")))


def top_contributions(items: DataFrame, days: DataFrame, weights: DataFrame, k: int = 6,
                      min_gap: float = 0.03) -> DataFrame:
    """The items that pushed a linear score most on days with a large gap.

    ``items`` is (ticker, date, news_id, vec), ``days`` (ticker, date, gap, pred_up),
    ``weights`` one row (w). The share of an item is dot(w, vec) over the day's item count.
    """
    big = days.filter(F.abs("gap") >= min_gap).withColumn("correct", F.col("pred_up") == (F.col("gap") > 0))
    n = items.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n"))
    j = R.with_scalars(items.join(big, ["ticker", "date"]).join(n, ["ticker", "date"]), weights)
    j = j.withColumn("contrib", V.dot("w", "vec") / F.col("n"))
    w = Window.partitionBy("ticker", "date").orderBy(F.desc(F.abs(F.round("contrib", 9))), "news_id")
    return j.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).select(
        "ticker", "date", "gap", "correct", "n", "rk", "news_id", "contrib")
