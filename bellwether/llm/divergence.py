"""Which terms set a source apart from the others of its language: counts by sorted word-start pointers.

A slice of texts stays in its Arrow buffer. Pointers to the first byte of every word are sorted by the words they
point at with a multikey quicksort: seven bytes and whether the word goes on are one key, all pointers are sorted by their first key, and
each run of equal keys whose words go on is sorted by its next one, until every run is one word. Within a word the pointers stay in the order of their documents, and
documents are ordered by source, so a run gives the word's count and its document count per source, and nothing but these sums leaves the slice. A slice holds whole
documents, so document counts add up; it ends at ``slice_bytes``, or after a single longer document.

The counts are added up by Spark. What follows works on (term, source) rows: kept terms by document frequency within
the language, smoothed shares as exact integers, their absolute differences summed for each pair of sources in matrices of
(sources x sources) per task, and the terms with the greatest excess over the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.llm.common import stored

#: Bytes of text whose pointers are sorted together.
SLICE = 8 << 20
#: Words are runs of ASCII letters and of bytes of non-ASCII characters; only A-Z are lower-cased.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first 0 to 7 bytes of a big-endian key.
_MASK = np.array([(1 << 64) - (1 << 8 * (8 - n)) for n in range(8)], dtype=np.uint64)


def word_pointers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every word of texts that follow each other in a byte buffer; ``ends`` has the end of each text."""
    letter = _LETTER[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[ends], cut[0], cut[-1] = True, True, True
    cut[1:-1] |= letter[1:] != letter[:-1]
    return np.flatnonzero(letter & cut[:-1]), np.flatnonzero(letter & cut[1:]) + 1 - np.flatnonzero(letter & cut[:-1])


def multikey_order(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts pointers by word, then by position, and for each place in it whether a new word begins.

    Words hold no zero bytes."""
    order, new = np.arange(len(start)), np.zeros(len(start), dtype=bool)
    new[:1] = True
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, dtype=np.uint8)]), 8)
    places, depth = np.arange(len(start)), 0  # of runs that may still hold different words
    while len(places):
        at, run = order[places], np.cumsum(new[places])
        rest = length[at] - depth
        key = windows[start[at] + depth].view(">u8").ravel().astype(np.uint64) & _MASK[np.minimum(rest, 7)] | (rest > 7).astype(np.uint64)
        by = np.lexsort((key, run)) if depth else np.argsort(key, kind="stable")
        order[places], key = at[by], key[by]
        new[places[1:]] |= key[1:] != key[:-1]
        goes_on = (key & np.uint64(1)) == 1
        last = np.append(new[places[1:]], True)  # a run of one pointer is sorted
        places = places[goes_on & ~(new[places] & last)]
        depth += 7
    return order, new


def _cells(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Term, group, count and document count of each (term, group) of a slice; texts come in the order of their groups."""
    start, length = word_pointers(data, ends)
    words = np.diff(np.searchsorted(start, ends), prepend=0)
    text = np.repeat(np.arange(len(ends)), words)
    order, new = multikey_order(data, start, length)
    text = text[order]
    groups = group[text]
    new[1:] |= groups[1:] != groups[:-1]
    other = new.copy()
    other[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(new)
    first, size = start[order[at]], length[order[at]]
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])]
    terms = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return terms, groups[at], np.diff(np.append(at, len(new))), np.add.reduceat(other, at, dtype=np.int64) if len(at) else at


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", slice_bytes: int = SLICE) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group; nulls count as empty."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(k).cast(pa.large_string()).dictionary_encode() for k in (0, 1)]
            codes = names[0].indices.to_numpy().astype(np.int64) * len(names[1].dictionary) + names[1].indices.to_numpy()
            by = np.argsort(codes, kind="stable")
            column, codes = batch.column(2).take(pa.array(by)), codes[by]
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            whole = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
            i = 0
            while i < len(column):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + slice_bytes, side="right")) - 1)
                terms, group, n, seen = _cells(_LOWER[whole[offsets[i] : offsets[j]]], offsets[i + 1 : j + 1] - offsets[i], codes[i:j])
                known = [d.dictionary.take(pa.array(c)).cast(pa.string()) for d, c in zip(names, np.divmod(group, len(names[1].dictionary)), strict=True)]
                yield pa.RecordBatch.from_arrays([*known, terms.cast(pa.string()), pa.array(n), pa.array(seen)], names=["lang", "source", "term", "n", "docs"])
                i = j

    parts = texts.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * terms)), exactly."""
    over = (n + F.lit(smoothing)).cast("decimal(26,0)") * F.lit(scale).cast("decimal(12,0)")
    under = (total + F.lit(smoothing) * terms).cast("decimal(26,0)")
    return ((over - over % under) / under).cast("bigint") + 1


def _summed_differences(shares: DataFrame) -> DataFrame:
    """(lang, i, j, value), i < j: the sum of |p[i] - p[j]| over all rows (lang, p) of a language."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            for name in np.unique(langs):
                part = batch.column(1).filter(pa.array(langs == name))
                p = part.flatten().to_numpy().reshape(len(part), -1)
                apart = np.stack([np.abs(p - p[:, [k]]).sum(axis=0) for k in range(p.shape[1])])
                sums[name] = sums.get(name, 0) + apart
        rows = [(name, *np.triu_indices(len(m), 1), m[np.triu_indices(len(m), 1)]) for name, m in sums.items()]
        for name, i, j, value in rows:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(value)], names=["lang", "i", "j", "value"])

    return shares.mapInArrow(add, "lang string, i int, j int, value bigint").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, smoothing: int = 5, scale: int = 1_000_000_000, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source", slice_bytes: int = SLICE) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of two parts.

    ``pair``: value is the summed difference of the shares of source and item, another source of the language, over the
    language's kept terms. ``term``: item is a kept term that the source uses more than its language, value the excess, ranks to ``top``.
    Ranks start at 1, greatest value first, ties by the UTF-8 order of the item.

    Null text, language and source count as empty; repeated rows are documents of their own; a language without kept terms has
    pairs of value 0; a source alone in its language has no pairs; an empty table gives an empty table; other columns are ignored
    whatever their names.
    """
    counts = term_counts(docs, text, lang, source, slice_bytes)
    cells = F.collect_list(F.struct("source", "n")).alias("cells")  # at most a cell per source
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), cells).filter(F.col("docs") >= min_docs)
    terms = stored(terms.drop("docs"), "kept-terms")
    cell = stored(terms.select("lang", "term", F.col("n").alias("lang_n"), F.inline("cells")), "kept-cells")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    sums = cell.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    groups = groups.join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = stored(groups.select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "v", "lang_total"))), "groups")

    share = lambda n, total: _share(n, total, F.col("v"), smoothing, scale)
    langs = stored(groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"), F.max("v").alias("v")), "languages")
    used = F.map_from_entries("cells")
    p = F.transform("sources", lambda s: share(F.coalesce(F.try_element_at(F.col("used"), s["source"]), F.lit(0)), s["total"]))
    apart = stored(_summed_differences(terms.join(langs, "lang").withColumn("used", used).select("lang", p.alias("p"))), "differences")
    one = langs.select("lang", "sources", F.posexplode("sources").alias("k", "s"))
    pairs = one.select("lang", "k", F.col("s.source").alias("source"), F.posexplode("sources").alias("other", "o")).filter("k <> other")
    pairs = pairs.select("lang", "source", F.col("o.source").alias("item"), F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"))
    pairs = pairs.join(apart, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    excess = share(F.col("n"), F.col("total")) - share(F.col("lang_n"), F.col("lang_total"))
    single = cell.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(single.filter("value > 0")).filter(F.col("rank") <= top))
