"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is a sample of all web
text. A logistic model of style features minimises the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``: when the bracket turns negative, its gradient is
reversed. The class prior is estimated from the same two sets: a first model separates
them on one half, and on the other half the prior is the least ratio of the shares of unlabelled
and positive documents above a threshold. Negative labels are never used.

Fitting uses at most about ``max_rows`` documents of each set, chosen by hash over the whole table (the
one bounded sample here); features are taken over whole texts, and every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.llm.common import crc_of, hashed_share

MAX_ROWS = 20_000
THRESHOLD = 0.3
#: Symbols that seldom stand in prose. Fixed values.
SYMBOLS = b"#$%&*+<=>@[]^_{|}~\\`"
_SYMBOLS, _DIGITS, _UPPER, _LOWER = (np.frombuffer(b, dtype=np.uint8) for b in (SYMBOLS, b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))))

FEATURES = (
    "log_chars", "log_words", "symbols", "digits", "upper", "exclamations", "questions", "pipes", "stops", "commas", "letters",
    "word_length", "long_words", "distinct_words", "repeats", "shouted", "distinct_lines", "line_words", "controls",
)


def features(data: bytes) -> list[float]:
    """Style of a whole text, each between 0 and about 3; all zero for an empty text."""
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    of = lambda codes: float(counts[codes].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, lower = of(_UPPER), of(_LOWER)
    seen = set(words)
    return [
        np.log1p(size) / 5, np.log1p(n) / 5, min(3.0, of(_SYMBOLS) / n), min(3.0, of(_DIGITS) / n), upper / max(1.0, upper + lower),
        min(3.0, counts[33] / n), min(3.0, counts[63] / n), min(3.0, counts[124] / n), min(3.0, counts[46] / n), min(3.0, counts[44] / n),
        (upper + lower + float(counts[128:].sum())) / size, min(3.0, size / n / 8), sum(len(w) > 24 for w in words) / n,
        len(seen) / n, sum(map(eq, words, words[1:])) / n, sum(map(bytes.isupper, words)) / n,
        len(set(lines)) / len(lines), min(3.0, n / len(lines) / 20), min(3.0, float(counts[:9].sum() + counts[14:32].sum()) / n),
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_expanded(x, self.mean, self.scale) @ self.weights, -30, 30)))


def _expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their squares (both cut at 6 deviations) and a constant."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, z * z / 6, np.ones((len(z), 1))])


def _descend(gradient, width: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(p: np.ndarray, u: np.ndarray, ridge: float = 1e-3) -> float:
    """Share of positives among ``u``: least ratio of the shares above a threshold, over thresholds that
    keep at least a tenth of the positives (below that the ratio is mostly noise)."""
    fit_p, fit_u, own_p, own_u = p[::2], u[::2], p[1::2], u[1::2]
    if not len(own_p) or not len(own_u):
        return 0.5

    def gradient(w):
        return (-(1 - _sigmoid(fit_p @ w)) @ fit_p / len(fit_p) + _sigmoid(fit_u @ w) @ fit_u / len(fit_u)) / 2 + ridge * w

    w = _descend(gradient, p.shape[1])
    above_p, above_u = np.sort(own_p @ w), np.sort(own_u @ w)
    cuts = above_p[: max(1, int(0.9 * len(above_p)))]
    q_p = 1 - np.searchsorted(above_p, cuts) / len(above_p)
    q_u = 1 - np.searchsorted(above_u, cuts) / len(above_u)
    slack = np.sqrt(np.log(20) / (2 * len(above_u))) + np.sqrt(np.log(20) / (2 * len(above_p)))
    best = np.argmin((q_u + slack) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.02, 0.98))


def fit(positives: np.ndarray, unlabelled: np.ndarray, ridge: float = 1e-4) -> Model | None:
    """None without positives or without unlabelled documents."""
    if not len(positives) or not len(unlabelled):
        return None
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = _expanded(positives, mean, scale), _expanded(unlabelled, mean, scale)
    prior = estimate_prior(p, u)

    def gradient(w):
        on_p, on_u = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        g_negative = on_u @ u / len(u) - prior * (on_p @ p) / len(p)
        if negative < 0:
            return -g_negative
        return prior * (-(1 - on_p) @ p / len(p)) + g_negative + ridge * w

    return Model(mean, scale, _descend(gradient, p.shape[1]), prior)


def _featured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    return docs.select(F.col(doc_id).alias("doc_id"), extract(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("x"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """Fit on documents whose crc32(doc_id) mod ``folds`` is not ``held_out``.

    A document is a trusted positive if all its non-null quality labels are 1."""
    mine = crc_of(doc_id, folds) != held_out
    good = labels.filter(mine).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    texts = docs.filter(mine & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    n_good, n_docs = good.count(), texts.count()
    chosen = good.filter(hashed_share("doc_id", max_rows, n_good, "positive")).withColumn("positive", F.lit(True))
    p = _featured(texts.join(F.broadcast(chosen), "doc_id", "left_semi"), "doc_id", "text").withColumn("positive", F.lit(True))
    u = _featured(texts.filter(hashed_share("doc_id", max_rows, n_docs, "unlabelled")), "doc_id", "text").withColumn("positive", F.lit(False))
    rows = p.unionByName(u).toPandas().sort_values(["positive", "doc_id"], kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    positive = rows["positive"].to_numpy(dtype=bool)
    return fit(x[positive], x[~positive])


def classify(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold) to every row, repeated ones too.

    Null texts count as empty; an empty text has a score like any other. Without a model every
    score is 0.5. Columns called score or predicted are replaced. An empty table gives an empty table.
    """
    if model is None:
        scored = docs.withColumn("score", F.lit(0.5))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            x = np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
            return pd.Series(shared.value.scores(x))

        scored = docs.withColumn("score", score(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
