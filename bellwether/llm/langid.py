"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word falls back to
character n-grams: from its start, the longest known n-gram is taken, then shorter and shorter ones, and
the word counts as the mean of its pieces. Scores are summed over all words of a text.

The model is fitted on at most about ``max_docs`` labelled documents of each language, chosen by hash over the whole table,
and keeps at most ``max_words`` words and ``max_grams`` n-grams, an equal number of each language, the most frequent ones;
these three are its bounds. Every whole text is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bellwether.llm.common import stored, unused

UNKNOWN = "und"
#: Letters with their marks. A fixed pattern.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST_GRAM = 5
REMEMBERED = 300_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str) -> Iterator[str]:
    marked = f"^{word}$"
    for n in range(1, LONGEST_GRAM + 1):
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_logs: np.ndarray
    gram_logs: np.ndarray

    def __post_init__(self):
        self._memo: dict[str, int] = {}
        self._most = REMEMBERED * 4 // max(4, len(self.langs))
        self._rows = np.zeros((self._most, len(self.langs)), dtype=np.float32)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("langs", "words", "grams", "word_logs", "gram_logs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def backed_off(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest known pieces; zero if no piece is known."""
        marked, at, found = f"^{word}$", 0, []
        while at < len(marked):
            for n in range(min(LONGEST_GRAM, len(marked) - at), 0, -1):
                row = self.grams.get(marked[at : at + n])
                if row is not None:
                    found.append(row)
                    break
            else:
                n = 1
            at += n
        return self.gram_logs[found].mean(axis=0) if found else np.zeros(len(self.langs), dtype=np.float32)

    def totals(self, text: str) -> tuple[np.ndarray, int]:
        """Summed scores per language, and the number of words. Back-offs are remembered, up to a bound."""
        counts = Counter(words_of(text))
        memo, n_words = self._memo, 0
        if len(memo) >= self._most:
            memo.clear()
        known, known_n, other, other_n = [], [], [], []
        total = np.zeros(len(self.langs))
        for word, n in counts.items():
            n_words += n
            row = self.words.get(word)
            if row is not None:
                known.append(row)
                known_n.append(n)
                continue
            row = memo.get(word)
            if row is None:
                if len(memo) >= self._most:
                    total += n * self.backed_off(word)
                    continue
                row = memo[word] = len(memo)
                self._rows[row] = self.backed_off(word)
            other.append(row)
            other_n.append(n)
        if known:
            total += np.array(known_n, dtype=np.float64) @ self.word_logs[known]
        if other:
            total += np.array(other_n, dtype=np.float64) @ self._rows[other]
        return total, n_words

    def predict(self, text: str) -> tuple[str, float]:
        """Language and its share of the posterior, in which a text counts as at most twenty words."""
        total, n = self.totals(text)
        if not n or not self.langs:
            return UNKNOWN, 0.0
        total = total * min(1.0, 20 / n)
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def _logs(counts: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    shares = (counts + smoothing) / (counts.sum(axis=0, keepdims=True) + smoothing * max(1, len(counts)))
    return np.log(shares).astype(np.float32)


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", max_docs: int = 5_000,
          max_words: int = 60_000, max_grams: int = 60_000) -> Model:
    """Fit on rows with a text and a language. Without any, every prediction is ``und``. A language whose texts hold no letter is learned, with
    every word and n-gram equally unlikely."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 2) / F.lit(float(1 << 62))
    rows = rows.join(sizes, "lang").filter(draw * F.col("docs") < max_docs)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for frame in frames:
            for of, t in zip(frame["lang"], frame["text"], strict=True):
                words.setdefault(of, Counter()).update(words_of(t))
        for of, found in words.items():
            grams: Counter = Counter()
            for word, n in found.items():
                for gram in grams_of(word):
                    grams[gram] += n
            for kind, counter in (("word", found), ("gram", grams)):
                if counter:  # a frame without rows has no types
                    yield pd.DataFrame({"kind": kind, "item": list(counter.keys()), "lang": of, "n": list(counter.values())})

    counted = rows.select("lang", "text").mapInPandas(count, "kind string, item string, lang string, n bigint")
    counted = stored(counted.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")), "item-counts")
    most = F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "item"))
    each = {kind: max(1, bound // max(1, len(langs))) for kind, bound in (("word", max_words), ("gram", max_grams))}
    top = counted.withColumn("at", most).filter(F.col("at") <= F.when(F.col("kind") == "word", each["word"]).otherwise(each["gram"]))
    kept = stored(counted.join(top.select("kind", "item").distinct(), ["kind", "item"], "left_semi"), "kept-items")
    place = {of: i for i, of in enumerate(langs)}
    index: dict[str, dict[str, int]] = {}
    logs: dict[str, np.ndarray] = {}
    for kind in each:
        known = kept.filter(F.col("kind") == kind).toPandas().sort_values(["item", "lang"])
        index[kind] = {item: i for i, item in enumerate(known["item"].drop_duplicates())}
        counts = np.zeros((len(index[kind]), len(langs)))
        counts[known["item"].map(index[kind]).to_numpy(dtype=np.int64), known["lang"].map(place).to_numpy(dtype=np.int64)] = known["n"]
        logs[kind] = _logs(counts)
    return Model(langs, index["word"], index["gram"], logs["word"], logs["gram"])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row, repeated ones too.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if the model knows
    no language. Of equally good languages the first by name is taken. Columns called lang_pred or score are
    replaced. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        return pd.DataFrame([known.predict(t) for t in texts], columns=["lang", "score"])

    mine = unused(docs, "predicted")
    judged = docs.withColumn(mine, predict(F.coalesce(F.col(text), F.lit(""))))
    return judged.withColumns({"lang_pred": F.col(f"{mine}.lang"), "score": F.col(f"{mine}.score")}).drop(mine)
