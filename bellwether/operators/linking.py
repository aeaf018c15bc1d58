"""Linking news to tickers by the names they mention."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwether.functions import text as X
from bellwether.session import frozen

#: Letters of a name that are joined with the words of texts, and rows of names that are broadcast.
_LONGEST_GRAM, _BROADCAST = 4, 100_000
#: Bytes of text that are cut into grams at once.
_SLICE = 1 << 20


def alias_table(universe: DataFrame, name_min: int = 2, alias_min: int = 3) -> DataFrame:
    """(alias, ticker) rows of a universe (ticker, name, aliases[]): the name and the aliases
    that are long enough. One alias may belong to several tickers."""
    name = F.filter(F.array("name"), lambda n: F.length(n) >= name_min)
    more = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.length(a) >= alias_min)
    return universe.select("ticker", F.explode(F.array_union(name, more)).alias("alias")).distinct()


def _anchors(names: DataFrame) -> DataFrame:
    """The parts of each name between single spaces, and the first characters of the first part that is not empty.
    A text holding the name holds the part inside one of its own words."""
    parts = F.split("alias", " ")
    rows = names.select("alias").distinct().withColumn("parts", parts)
    rows = rows.withColumns({"first": F.get("parts", F.lit(0)), "anchor": F.get(F.filter("parts", lambda x: x != ""), F.lit(0))})
    rows = rows.filter("anchor is not null").withColumn("at", F.array_position("parts", F.col("anchor")).cast("int") - 1)
    return rows.withColumn("gram", F.substring("anchor", 1, _LONGEST_GRAM))


def _grams(word: Column, lengths: list[int]) -> Column:
    """All substrings of one word with the given lengths."""
    n = F.char_length(word)

    def of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)),
                                          lambda i: word.substr(i, F.lit(k)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[of(k) for k in lengths]))


def _small(names: DataFrame) -> DataFrame:
    """Names, or words that hold one, for a join with words of texts: broadcast if they are few."""
    return F.broadcast(names) if names.count() <= _BROADCAST else names.hint("merge")


def _holding(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, alias, parts, at): different words that can hold a name's anchor, the part number ``at``.

    The words are cut into short grams and equi-joined with the first letters of the anchors, then checked: an anchor
    between two spaces of the name is a word, one before a space ends a word, one after a space begins it.
    """
    anchors = _anchors(names)
    lengths = sorted(r[0] for r in anchors.select(F.char_length("gram")).distinct().collect())  # at most ``_LONGEST_GRAM``
    grams = words.select("word").distinct().select("word", F.explode(_grams(F.col("word"), lengths)).alias("gram"))
    last = F.col("at") == F.size("parts") - 1
    fits = (F.when((F.col("at") == 0) & last, F.contains("word", "anchor")).when(F.col("at") == 0, F.endswith("word", F.col("anchor")))
            .when(last, F.startswith("word", F.col("anchor"))).otherwise(F.col("word") == F.col("anchor")))
    return grams.join(_small(anchors), "gram").filter(fits).select("word", "alias", "parts", "at")


def _held(news: DataFrame, words: DataFrame, holding: DataFrame) -> DataFrame:
    """(news_id, alias) of words (news_id, word) that hold a name; names of several parts are checked against the title."""
    hit = words.join(_small(holding), "word").select("news_id", "alias", (F.size("parts") == 1).alias("whole")).distinct()
    several = hit.filter("NOT whole").join(news.select("news_id", "title"), "news_id").filter(F.contains("title", "alias"))
    return hit.filter("whole").select("news_id", "alias").unionByName(several.select("news_id", "alias"))


def _places(data: np.ndarray, ends: np.ndarray, names: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, end, name) of every place in texts that lie one after the other, each from ``ends[i]`` to before ``ends[i + 1]``.

    All short grams of the bytes are looked up among the first letters of the names; what meets is compared letter by letter."""
    letters, size = np.frombuffer(b"".join(names), np.uint8), np.array([len(x) for x in names])
    begin = np.cumsum(size) - size
    heads = defaultdict(list)
    for no, x in enumerate(names):
        k = min(len(x), _LONGEST_GRAM)
        heads[k].append((int.from_bytes(x[:k], "little"), no))
    for k, rows in heads.items():
        codes, nos = (np.array(x) for x in zip(*sorted(rows), strict=True))
        hashed = lambda c: ((c * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)
        known = np.zeros(1 << 16, bool)
        known[hashed(codes.astype(np.uint32))] = True
        for at in range(0, len(data), _SLICE):
            part = data[at : at + _SLICE + k - 1].astype(np.uint32)
            grams = sum(part[j : len(part) - k + 1 + j] << np.uint32(8 * j) for j in range(k)) if len(part) >= k else part[:0]
            here = np.flatnonzero(known[hashed(grams)])
            low, high = (np.searchsorted(codes, grams[here], side) for side in ("left", "right"))
            n = high - low
            start, no = np.repeat(here + at, n), nos[np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())]
            text = np.searchsorted(ends, start, "right") - 1
            fits = start + size[no] <= ends[text + 1]
            start, no, text = start[fits], no[fits], text[fits]
            for j in range(k, size.max()):
                longer = np.flatnonzero(size[no] > j)
                if not len(longer):
                    break
                same = np.ones(len(no), bool)
                same[longer] = data[start[longer] + j] == letters[begin[no[longer]] + j]
                start, no, text = start[same], no[same], text[same]
            yield text, start, start + size[no], no


_INNER = np.array([chr(b).isascii() and (chr(b).isalnum() or chr(b) == "&") for b in range(256)])


def _read(column: pa.Array, names: list[bytes], longest: bool) -> tuple[np.ndarray, ...]:
    """(text, name, free), sorted: the different names of each text; of ``longest`` those that a reading from left to right takes.
    ``free``: at some place no letter, digit or ampersand stands on either side."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    if not data or not data.size:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    ends = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data, ends = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    found = [*zip(*_places(data, ends, names), strict=True)]
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    text, start, stop, no = map(np.concatenate, found)
    around = np.r_[data, np.uint8(32)]
    free = ((start == ends[text]) | ~_INNER[around[start - 1]]) & ((stop == ends[text + 1]) | ~_INNER[around[stop]])
    key = text * len(names) + no
    wanted, freely = np.unique(key), np.unique(key[free])
    if longest:
        order, past, taken = np.lexsort((-stop, start)), 0, []
        for x, a, b in zip(key[order].tolist(), start[order].tolist(), stop[order].tolist(), strict=True):
            if a >= past:
                past = b
                taken.append(x)
        wanted = np.unique(np.array(taken, dtype=key.dtype))
    return wanted // len(names), wanted % len(names), np.isin(wanted, freely)


def _found(news: DataFrame, names: DataFrame, keep: list[str], longest: bool = False) -> DataFrame:
    """The columns ``keep`` of each text with a name, and ``_m``, its names as structs: the columns of ``names``, one row a name, and ``free`` (see ``_read``).

    For names few enough to be broadcast: texts are dealt out once and read where they are; neither words nor places are exchanged.
    """
    rows = names.filter("trim(BOTH ' ' FROM alias) <> ''").toArrow().combine_chunks()
    shared = news.sparkSession.sparkContext.broadcast((rows, [x.encode() for x in rows["alias"].to_pylist()]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, aliases = shared.value
        for batch in batches if aliases else ():
            text, no, free = _read(batch.column(0), aliases, longest)
            taken = table.take(pa.array(no))
            item = pa.StructArray.from_arrays([*(c.combine_chunks() for c in taken.columns), pa.array(free)], names=[*taken.column_names, "free"])
            held, first = np.unique(text, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(text)], pa.int32()), item)
            kept = [batch.column(1 + i).take(pa.array(held)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, lists], names=[*keep, "_m"])

    item = T.StructType([*(T.StructField(f.name, f.dataType) for f in names.schema), T.StructField("free", T.BooleanType())])
    schema = T.StructType([*news.select(*keep).schema.fields, T.StructField("_m", T.ArrayType(item))])
    return news.repartition("news_id").select(F.col("title").cast("binary").alias("_text"), *keep).mapInArrow(read, schema)


def _few(names: DataFrame) -> bool:
    return names.limit(_BROADCAST + 1).count() <= _BROADCAST


def bounded_mentions(news: DataFrame, names: DataFrame) -> DataFrame:
    """(news_id, alias) for every name that a title holds with no letter, digit or ampersand on either side."""
    names = names.select("alias").distinct()
    if _few(names):
        return _found(news, names, ["news_id"]).select("news_id", F.inline("_m")).filter("free").select("news_id", "alias")
    return mentions(news, names).join(news, "news_id").filter(X.word_match("title", "alias")).select("news_id", "alias")


def mentions(news: DataFrame, names: DataFrame) -> DataFrame:
    """(news_id, alias) for every name contained in a title. A name without anything but spaces is never mentioned."""
    names = names.select("alias").distinct()
    if _few(names):
        return _found(news, names, ["news_id"]).select("news_id", F.inline("_m")).select("news_id", "alias")
    words = news.select("news_id", F.explode(F.array_distinct(F.split("title", " "))).alias("word"))
    return _held(news, words, frozen(_holding(words, names)))


def _starts(word: Column, part: Column) -> Column:
    """Places (from 1) where a word holds a part."""
    last = F.char_length(word) - F.char_length(part) + 1
    return F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: word.substr(i, F.char_length(part)) == part)


def occurrences(news: DataFrame, names: DataFrame) -> DataFrame:
    """(news_id, alias, word, start, end, until, free) for every place at which a title holds a name.

    A place is a word's number in the title, split at single spaces, and a character in it: the name reaches from ``start`` in
    ``word`` to before ``until`` in ``end``. ``free``: no letter, digit or ampersand stands on either side.
    """
    words = news.select("news_id", F.posexplode(F.split("title", " ")).alias("pos", "word"))
    holding = frozen(_holding(words, names))
    k = F.size("parts")
    one = holding.filter(k == 1).select("word", "alias", F.explode(_starts(F.col("word"), F.col("alias"))).alias("start"))
    edge = lambda c: (c == "") | ~c.rlike("^[0-9A-Za-z&]")
    around = lambda text: edge(text.substr(F.col("start") + F.char_length("alias"), F.lit(1))) & (
        (F.col("start") == 1) | edge(text.substr(F.col("start") - 1, F.lit(1))))
    until = F.col("start") + F.char_length("alias")
    one = frozen(one.select("word", "alias", "start", until.alias("until"), around(F.col("word")).alias("free")))
    single = words.join(_small(one), "word").select("news_id", "alias", F.col("pos").alias("word"), "start", F.col("pos").alias("end"), "until", "free")

    several = words.join(_small(holding.filter(k > 1)), "word").select("news_id", "alias", "parts", (F.col("pos") - F.col("at")).alias("pos")).filter("pos >= 0")
    several = several.join(news.select("news_id", F.split("title", " ").alias("all")), "news_id")
    several = several.withColumn("here", F.slice("all", F.col("pos") + 1, k)).withColumn("text", F.array_join("here", " "))
    several = several.withColumn("start", F.char_length(F.get("here", F.lit(0))) - F.char_length(F.get("parts", F.lit(0))) + 1)
    several = several.filter((F.col("start") > 0) & (F.col("text").substr(F.col("start"), F.char_length("alias")) == F.col("alias")))
    several = several.select("news_id", "alias", F.col("pos").alias("word"), "start", (F.col("pos") + k - 1).alias("end"),
                             (F.char_length(F.get("parts", k - 1)) + 1).alias("until"), around(F.col("text")).alias("free"))
    return single.unionByName(several)


def _leftmost_longest(places: Column) -> Column:
    """The names of an array of places that a reading from left to right takes, always the longest at a place."""
    order = F.array_sort(F.transform(places, lambda x: F.struct(
        x["word"].alias("word"), x["start"].alias("start"), (-F.char_length(x["alias"])).alias("n"), x["alias"].alias("alias"),
        F.struct(x["end"].alias("word"), x["until"].alias("start")).alias("past"))))
    begin = F.struct(F.struct(F.lit(0).alias("word"), F.lit(0).alias("start")).alias("past"), F.array().cast("array<string>").alias("taken"))

    def read(state: Column, x: Column) -> Column:
        free = F.struct(x["word"].alias("word"), x["start"].alias("start")) >= state["past"]
        return F.when(free, F.struct(x["past"].alias("past"), F.array_union(state["taken"], F.array(x["alias"])).alias("taken"))).otherwise(state)

    return F.aggregate(order, begin, read, lambda state: state["taken"])


def _placed_rules(news: DataFrame, rules: DataFrame) -> DataFrame:
    """(news_id, title, _m): the rules of the names that a reading from left to right takes, for rules too many to broadcast."""
    found = occurrences(news, rules).groupBy("news_id").agg(F.collect_list(F.struct("alias", "word", "start", "end", "until", "free")).alias("_at"))
    taken = found.withColumn("_taken", _leftmost_longest(F.col("_at"))).withColumn("_free", F.transform(F.filter("_at", lambda x: x["free"]), lambda x: x["alias"]))
    m = taken.select("news_id", "_free", F.explode("_taken").alias("alias")).select("news_id", "alias", F.array_contains("_free", F.col("alias")).alias("free"))
    m = m.join(_small(rules), "alias")
    per = m.groupBy("news_id").agg(F.collect_list(F.struct("alias", "kind", "ambiguous", "tight", "free")).alias("_m"))
    return per.join(news.select("news_id", "title"), "news_id")


def link_simple(news: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct (ticker, news_id) where any alias of the ticker is contained in the title."""
    m = mentions(news, aliases)
    return m.join(aliases.select("alias", "ticker").distinct(), "alias").select(
        "ticker", "news_id").distinct()


def classify_mentions(news: DataFrame, rules: DataFrame, cues: list[str]) -> DataFrame:
    """Judge each longest mention by the rule of its name.

    A text is read from left to right, and the longest name at a place is taken; a name that occurs
    only inside longer ones, or overlapping one before it, is not mentioned.

    ``rules`` is (alias, kind, ambiguous, tight): ``word`` names need free edges, ``run``
    names must equal up to four joined consecutive tokens, a ``tight`` pattern replaces
    both, and an ambiguous name without such a pattern needs a cue word in the text.
    Status is ``linked``, ``boundary`` or ``ambiguous``. Few names are read out of the texts where they are; else words are joined with
    the names, and the places of a text are gathered and read in order. No pattern is made of names.
    """
    if _few(rules):
        t = _found(news, rules.select("alias", "kind", "ambiguous", "tight"), ["news_id", "title"], longest=True)
    else:
        t = _placed_rules(news, rules)
    t = t.withColumn("_toks", X.tokenize("title"))
    runs = F.transform(F.filter("_m", lambda x: ~x["kind"].eqNullSafe("word")), lambda x: x["alias"])
    t = t.withColumn("_runs", X.named_runs("_toks", runs))
    t = t.withColumn("_cue", F.arrays_overlap("_toks", F.array(*[F.lit(c) for c in cues])))

    def judge(x: Column) -> Column:
        bounded = F.when(x["kind"] == "word", x["free"]).otherwise(F.array_contains("_runs", x["alias"]))
        plain = (F.when(~bounded, "boundary")
                 .when(x["ambiguous"] & ~F.col("_cue"), "ambiguous").otherwise("linked"))
        return F.struct(x["alias"].alias("alias"), F.when(
            x["tight"].isNotNull(),
            F.when(F.regexp_like("title", x["tight"]), "linked").otherwise("ambiguous")
        ).otherwise(plain).alias("status"))

    # the inner form would make the optimizer push a size filter down, with the regular expression in its lambda
    return t.select("news_id", F.inline_outer(F.transform("_m", judge))).filter("alias is not null")


def link_precise(news: DataFrame, aliases: DataFrame, rules: DataFrame, cues: list[str]) -> DataFrame:
    ok = classify_mentions(news, rules, cues).filter("status = 'linked'")
    return ok.join(aliases.select("alias", "ticker").distinct(), "alias").select(
        "ticker", "news_id").distinct()
