"""Vector expressions on ``array<float>`` columns; arithmetic in double."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column | str) -> Column:
    v = _c(a)
    n = norm(v) + 1e-9
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def novelty(a: Column | str, b: Column | str) -> Column:
    return 1.0 - cosine(a, b)


def is_zero(a: Column | str) -> Column:
    return ~F.exists(_c(a), lambda x: x != 0)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def as_dense(c: Column | str) -> Column:
    """ML vector of an array column, for Summarizer and estimators."""
    return array_to_vector(_c(c).cast("array<double>"))


def mean_of(vec: Column | str, weight: Column | str | None = None) -> Column:
    """Aggregate expression: element-wise (weighted) mean; one partial row per map task."""
    v = as_dense(vec)
    w = F.lit(1.0) if weight is None else _c(weight)
    return vector_to_array(Summarizer.mean(v, w))


def vector_mean(df: DataFrame, keys: list[str], vec: str, out: str, weight: str | None = None) -> DataFrame:
    """Element-wise mean of ``vec`` per key, skipping null vectors."""
    d = df.filter(F.col(vec).isNotNull())
    if weight is not None:
        d = d.filter(F.col(weight) > 0)
    return d.groupBy(*keys).agg(mean_of(vec, weight).alias(out))


def fold_sum(vectors: Column, dim: int) -> Column:
    """Element-wise sum of an array of vectors."""
    return F.aggregate(vectors, zeros(dim),
                       lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
