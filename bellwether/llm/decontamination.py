"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders; case and punctuation go. Windows of
``width`` template words of the documents are hash-joined with those of the benchmark. A window
with placeholders counts only if its slots are consistent: wherever the item repeats a value, within
the window or anywhere else in that copy, the document repeats the value in its place. So questions asked again with other numbers or names are found.
Windows of the plain lower-cased words are joined as well: which words become placeholders depends on capitals and on what
stands before them, so only they find every copy, whatever its case and line breaks.

Window hashes are built by doubling (words, pairs, fours, ...); their lowest bit tells
whether a placeholder is in the window, so only the few such hits need their words again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.llm.common import small, stored

WIDTH = 8
SEED = 4
NAME, NUMBER, UNIT, BEYOND = "\ue000", "\ue001", "\ue002", "\ue003"

#: Number words and units that become placeholders. Fixed values.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million "
    "zwei drei vier fünf sechs sieben neun zehn elf zwölf zwanzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce veinte cien mil"
).split()
UNITS = (
    "mm cm m km kg g mg l ml s min h hour hours minute minutes second seconds day days week weeks month months year years "
    "meter meters metre metres mile miles inch inches foot feet pound pounds ounce ounces gram grams liter liters litre litres "
    "dollar dollars euro euros cent cents percent degree degrees stunde stunden tag tage jahr jahre heure heures jour jours hora horas día días"
).split()

#: A word with a capital within a sentence.
NAME_PATTERN = r"\p{Lu}(?<=[\p{Ll}\p{Nd},;]\s{1,2}\p{Lu})[\p{L}\p{M}'’-]*"
#: Digits with separators, maybe after a currency sign. Both patterns begin with a rare character: looking behind comes after it.
NUMBER_PATTERN = r"(?:[$€£](?=\p{Nd})|\p{Nd})(?<![\p{L}\p{Nd}][$€£\p{Nd}])\p{Nd}*(?:[.,:/]\p{Nd}+)*%?"
NOISE_PATTERN = f"[^\\p{{L}}\\p{{Nd}}{NAME}-{UNIT}\\s]+"


def _plain_words(text: Column) -> Column:
    """Lower-cased words without punctuation."""
    return F.split(F.btrim(F.regexp_replace(F.lower(text), NOISE_PATTERN, ""), F.lit(" \n\t\r\x0b\f")), r"\s+")


def _marked_words(text: Column) -> Column:
    """The same words, those with names and numbers in placeholders."""
    return _plain_words(F.regexp_replace(F.regexp_replace(text, NAME_PATTERN, NAME), NUMBER_PATTERN, NUMBER))


def _canonical(words: str):
    """A lambda: template word number i of an array column, with number words and units in placeholders."""

    def of(word: Column, i: Column) -> Column:
        before = F.get(F.col(words), i - 1)
        unit = word.isin(UNITS) & (before.startswith(NUMBER) | before.isin(NUMBER_WORDS))
        return F.when(word.isin(NUMBER_WORDS), F.lit(NUMBER)).when(unit, F.lit(UNIT)).otherwise(word)

    return of


def _is_slot(word: Column) -> Column:
    return (word >= F.lit(NAME)) & (word < F.lit(BEYOND))


def _flagged(h: Column, flag: Column) -> Column:
    return h.bitwiseAND(F.lit(-2)).bitwiseOR(flag)


def _joined(a: Column, b: Column) -> Column:
    return _flagged(F.xxhash64(a, b), a.bitwiseOR(b).bitwiseAND(F.lit(1)))


def _chained(powers: list[int], h: str):
    """A lambda over the hashes of ``powers[0]`` words: joins on those of the next ``powers[1:]`` words, in columns ``h<power>``."""

    def whole(x: Column, i: Column) -> Column:
        at = powers[0]
        for p in powers[1:]:
            x, at = _joined(x, F.get(F.col(f"{h}{p}"), i + at)), at + p
        return x

    return whole


def _with_words(rows: DataFrame) -> DataFrame:
    """Adds ``words``, the template words of ``text``, and ``raw``, its plain words."""
    rows = rows.withColumn("_marked", _marked_words(F.col("text"))).withColumn("raw", _plain_words(F.col("text")))
    return rows.withColumn("words", F.transform("_marked", _canonical("_marked"))).drop("_marked")


def _with_windows(rows: DataFrame, widths: list[int]) -> DataFrame:
    """Adds ``words`` and ``raw`` (template and plain words) and ``w<n>`` and ``p<n>``, the hashes of all their windows of n words, for each n of ``widths``.

    Explode them with the outer form: the inner one makes the optimizer push a filter on the array's size
    below these projections, which would compute the arrays anew for each of their elements.
    """
    rows = _with_words(rows)
    for words, h, w in (("words", "h", "w"), ("raw", "g", "p")):
        rows = rows.withColumn(f"{h}1", F.transform(words, lambda x: _flagged(F.xxhash64(x), F.when(_is_slot(x), F.lit(1)).otherwise(F.lit(0)))))
        fitting = lambda n, words=words: F.greatest(F.size(words) - (n - 1), F.lit(0))
        power = 1
        while 2 * power <= max(widths):
            rows = rows.withColumn(f"{h}{2 * power}", F.transform(F.slice(f"{h}{power}", F.lit(1), fitting(2 * power)), _chained([power, power], h)))
            power *= 2
        for n in widths:
            powers = [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]
            hashes = F.transform(F.slice(f"{h}{powers[0]}", F.lit(1), fitting(n)), _chained(powers, h)) if len(powers) > 1 else F.col(f"{h}{n}")
            rows = rows.withColumn(f"{w}{n}", hashes)
    return rows


def _slots(words: str, raw: str, start: str, n: str) -> Column:
    """The document's own words in the slots of the window at ``start``."""
    at = F.slice(F.col(words), F.col(start) + 1, F.col(n))
    own = F.slice(F.col(raw), F.col(start) + 1, F.col(n))
    return F.transform(F.filter(F.arrays_zip(at.alias("t"), own.alias("r")), lambda x: _is_slot(x["t"])), lambda x: x["r"])


def _seed_hash(words: str):
    """A lambda: hash of the ``SEED`` template words from number i on."""
    return lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(SEED)))


def _candidates(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that may hold a window of at least ``2 * SEED - 1`` words of an item, and few others.

    Such a window covers a whole block of ``SEED`` words at a multiple of ``SEED`` of the document. So the
    document's blocks, which don't overlap, are joined with all windows of that length of the items.
    """

    def every(words: str) -> Column:
        n = F.size(words)
        return F.when(n >= SEED, F.transform(F.sequence(F.lit(0), n - SEED), _seed_hash(words))).otherwise(F.array().cast("array<bigint>"))

    def spaced(words: str) -> Column:
        at = F.sequence(F.lit(0), F.expr(f"size({words}) div {SEED}") - 1)
        return F.when(F.size(words) >= SEED, F.transform(at, lambda i: _seed_hash(words)(i * SEED))).otherwise(F.array().cast("array<bigint>"))

    every, blocks = (F.concat(of("words"), of("raw")) for of in (every, spaced))
    seeds = stored(_with_words(items).select(F.explode_outer(every).alias("seed")).filter("seed IS NOT NULL").distinct(), "benchmark-seeds")
    keys = _with_words(rows).select("key", F.explode_outer(blocks).alias("seed")).join(seeds, "seed").select("key").distinct()
    return rows.join(stored(keys, "candidates"), "key", "left_semi")


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, width: int, least_words: int) -> DataFrame:
    """(item, n, h, plain, at, slots, total): the windows of each item, with hashes of template and plain words, their position and the number of different ones; an item under ``width`` words is one window."""
    items = benchmark.select(F.col(item_id).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    items = items.withColumn("key", F.xxhash64("item", "text")).dropDuplicates(["key"])
    sizes = items.withColumn("n", F.least(F.size(_plain_words(F.col("text"))), F.lit(width))).filter(F.col("n") >= least_words)
    widths = sorted(r["n"] for r in sizes.select("n").distinct().collect())
    parts = []
    for n in widths:  # at most ``width`` of them
        rows = _with_windows(sizes.filter(F.col("n") == n), [n])
        rows = rows.select("item", "n", "words", "raw", F.col(f"p{n}").alias("ps"), F.posexplode_outer(f"w{n}").alias("pos", "h"))
        parts.append(rows.filter("h IS NOT NULL").select("item", "n", "h", F.get("ps", F.col("pos")).alias("plain"), F.col("pos").alias("at"), _slots("words", "raw", "pos", "n").alias("slots")))
    if not parts:
        return stored(benchmark.sparkSession.createDataFrame([], f"item {items.schema['item'].dataType.simpleString()}, n int, h bigint, plain bigint, at int, slots array<string>, total bigint"), "benchmark-windows")
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    rows = rows.distinct()
    totals = rows.groupBy(F.col("item").alias("_item")).agg(F.count_distinct("h").alias("total"))
    return stored(rows.join(totals, F.col("item").eqNullSafe(F.col("_item"))).drop("_item"), "benchmark-windows")


def _copies(windows: DataFrame) -> DataFrame:
    """Adds ``copy`` to windows with ``pos`` and ``at``, their positions in document and item: the groups that are judged by themselves.

    Windows of one copy lie equally far from their places in the item (group 1), or nearly so if words were added or left out
    (groups 2 and 3: shifts within an item's length, with cuts at two places). Group 0 is the whole document."""
    shift, width = F.col("pos") - F.col("at"), F.col("total").cast("bigint")
    half = F.expr("total div 2")
    near = lambda x: F.floor(x / width)
    places = [F.lit(0), shift, near(shift), near(shift + half)]
    return windows.withColumn("copy", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), p.cast("bigint").alias("p")) for k, p in enumerate(places)])))


def _agreeing(windows: DataFrame) -> DataFrame:
    """Of the windows (key, item, copy, h, slots, own) those whose fillings agree over the copy: different (key, item, copy, total, h).

    Each value of an item stands for the one value that most windows of the copy give it."""
    place = ["key", "item", "copy", "total", "h", "own"]
    pairs = windows.select(*place, "slots", F.explode(F.array_distinct(F.arrays_zip("slots", "own"))).alias("p"))
    pairs = stored(pairs.select(*place, "slots", F.col("p.slots").alias("value"), F.col("p.own").alias("filling")).distinct(), "fillings")
    votes = pairs.select(*place, "value", "filling").distinct().groupBy("key", "item", "copy", "value", "filling").agg(F.count("*").alias("n"))
    chosen = votes.groupBy(F.col("key").alias("k"), F.col("item").alias("i"), F.col("copy").alias("c"), F.col("value").alias("v"))
    chosen = chosen.agg(F.min_by("filling", F.struct(-F.col("n"), "filling")).alias("f"))
    met = pairs.join(chosen, (F.col("key") == F.col("k")) & F.col("item").eqNullSafe(F.col("i")) & (F.col("copy") == F.col("c")) & (F.col("value") == F.col("v")))
    good = met.groupBy(*place, "slots").agg(F.min(F.col("filling") == F.col("f")).alias("ok")).filter("ok")
    return good.select("key", "item", "copy", "total", "h").distinct()


def judged_texts(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = 0.5, enough_words: int = 50,
                 least_words: int = 4, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, key, item, held, total, same) per contaminated document and item; key is a hash of id and text.

    A document is contaminated by an item if it holds ``coverage`` of the item's different windows, or
    as many as ``enough_words`` words have. Windows with the item's own words count wherever they stand, and with them the others of
    the copy that has most. Items of fewer than ``least_words`` words say too little and are not judged. Null
    texts are empty and never contaminated. Repeated rows and repeated ids give one row per id; null ids are one id. Ties in
    coverage keep all items. Other columns are ignored; an empty table on either side gives an empty table.
    """
    bench = benchmark_windows(benchmark, item_id, text, width, least_words)
    both = F.explode(F.array(F.struct(F.lit(False).alias("raw"), "h"), F.struct(F.lit(True).alias("raw"), F.col("plain").alias("h")))).alias("x")
    hashes = stored(bench.select("n", both).select("n", "x.raw", "x.h").distinct(), "benchmark-hashes")
    widths = sorted(r["n"] for r in hashes.select("n").distinct().collect())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    hits, wide = None, 2 * SEED - 1
    likely = _candidates(rows, benchmark.select(F.coalesce(F.col(text), F.lit("")).alias("text")))
    for n in widths or [width]:
        found = _with_windows(likely if n >= wide else rows, [n])
        found = found.select("doc_id", "key", F.explode_outer(F.array(F.struct(F.lit(False).alias("raw"), F.col(f"w{n}").alias("w")), F.struct(F.lit(True).alias("raw"), F.col(f"p{n}").alias("w")))).alias("x"))
        found = found.select("doc_id", "key", F.col("x.raw").alias("raw"), F.posexplode_outer("x.w").alias("pos", "h"))
        found = found.join(hashes.filter(F.col("n") == n), ["raw", "h"])
        hits = found if hits is None else hits.unionByName(found)
    all_hits = stored(hits.select("doc_id", "key", "raw", "n", "pos", "h").distinct(), "window-hits")
    hits, copied = all_hits.filter("NOT raw"), all_hits.filter("raw").select("key", "n", F.col("h").alias("plain")).distinct()
    copied = stored(copied.join(bench, ["n", "plain"]).select("key", "item", "h", "total").distinct(), "copied-windows")

    # Pairs meet only through an item's rarest windows: whoever holds enough of its windows holds one of these.
    need = F.least(F.ceil(F.col("total") * coverage), F.lit(max(1, enough_words - width + 1)))
    uses = bench.groupBy("h").agg(F.count("*").alias("uses"))
    each = bench.select("item", "h", "total").distinct().join(uses, "h")
    order = F.row_number().over(Window.partitionBy("item").orderBy("uses", "h"))
    rare = stored(each.withColumn("at", order).filter(F.col("at") <= F.col("total") - need + 1).select("item", "h"), "rare-windows")
    different = hits.select("key", "h").distinct()
    pairs = different.unionByName(copied.select("key", "h")).distinct().join(rare, "h").select("key", F.col("item").alias("_item")).distinct()
    copied = copied.join(pairs.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & F.col("item").eqNullSafe(F.col("_item")), "left_semi")
    matched = pairs.join(bench, F.col("item").eqNullSafe(F.col("_item"))).drop("_item")

    plain = matched.filter(F.size("slots") == 0).join(different, ["key", "h"], "left_semi")
    places = hits.filter(F.col("h").bitwiseAND(F.lit(1)) == 1).groupBy("key").agg(F.collect_list(F.struct("n", "pos", "h")).alias("places"))
    places = stored(places, "slot-hits")
    slotted = _with_words(rows.join(places, "key").select("key", "text", "places"))
    slotted = slotted.select("key", "words", "raw", F.explode("places").alias("p"))
    slotted = slotted.select("key", "words", "raw", F.col("p.n").alias("n"), F.col("p.pos").alias("pos"), F.col("p.h").alias("h"))
    slotted = stored(slotted.select("key", "h", "pos", _slots("words", "raw", "pos", "n").alias("own")).distinct(), "slot-values")
    values = F.arrays_zip("slots", "own")
    consistent = F.size(F.array_distinct(values)) == F.size(F.array_distinct("slots"))
    filled = matched.filter(F.size("slots") > 0).join(slotted, ["key", "h"]).filter(consistent)
    filled = stored(filled.select("key", "item", "total", "h", "pos", "at", "slots", "own"), "filled-windows")
    columns = ["key", "item", "total", "h"]
    own = plain.select(columns).unionByName(copied.select(columns)).unionByName(filled.filter(F.equal_null(F.col("slots"), F.col("own"))).select(columns))
    own = stored(own.distinct(), "own-windows")
    known = own.select(F.col("key").alias("k"), F.col("item").alias("i"), F.col("h").alias("g"))
    met = (F.col("key") == F.col("k")) & F.col("item").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))
    others = _agreeing(_copies(filled)).join(known, met, "left_anti").groupBy("key", "item", "total", "copy").agg(F.count("*").alias("n"))
    counts = own.select("key", "item", "total", F.lit(1).alias("own"), F.lit(0).cast("bigint").alias("n"))
    counts = counts.unionByName(others.select("key", "item", "total", F.lit(0).alias("own"), "n"))
    judged = counts.groupBy("key", "item", "total").agg((F.sum("own") + F.max("n")).alias("held"), (F.max("n") == 0).alias("same"))
    judged = judged.filter(F.col("held") >= need)
    return judged.join(all_hits.select("doc_id", "key").distinct(), "key").select("doc_id", "key", "item", "held", "total", "same")


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """One row per contaminated document: doc_id, item_ids (sorted), coverage (the best), verbatim (an item with
    its own values). See ``judged_texts`` for the rule and its settings."""
    return judged_texts(docs, benchmark, **settings).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item")).alias("item_ids"), F.max(F.col("held") / F.col("total")).alias("coverage"), F.max("same").alias("verbatim")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; rows that share an id are told apart by their texts."""
    bad = judged_texts(docs, benchmark, doc_id=doc_id, text=text, **settings)
    bad = small(stored(bad.select("key").distinct(), "contaminated"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))).alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")
