"""Numeric and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_zone(ts: Column | str, zone: str = NEW_YORK, source: str = "UTC") -> Column:
    """Zone-less wall time of ``source`` to zone-less wall time of ``zone``."""
    return F.convert_timezone(F.lit(source), F.lit(zone), _c(ts))


def clock(ts: Column | str) -> Column:
    """Seconds since midnight."""
    t = _c(ts)
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t).cast("int")


def fractional_hour(ts: Column | str) -> Column:
    return F.hour(_c(ts)) + F.minute(_c(ts)) / 60.0


def month_key(d: Column | str) -> Column:
    return F.substring(_c(d).cast("string"), 1, 7)


def day_number(d: Column | str) -> Column:
    return F.unix_date(F.to_date(_c(d)))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Null where the denominator is zero."""
    return _c(a) / F.nullif(_c(b).cast("double"), F.lit(0.0))


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Bounded to [lo, hi]; null stays null."""
    x = _c(c)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def sigmoid(margin: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(margin)))


def flow_imbalance(buy: Column | str, sell: Column | str) -> Column:
    b, s = _c(buy), _c(sell)
    return (b - s) / (b + s + 1)


def half_life_weight(day: Column | str, until: Column | str, half_life: float = 252.0) -> Column:
    """0.5 to the age in half-lives."""
    return F.pow(F.lit(0.5), F.datediff(_c(until), _c(day)) / half_life)


def return_weight(ret: Column | str, slope: float = 5.0) -> Column:
    return 1.0 + slope * F.abs(_c(ret))


def class_weight(positive_rate: Column | str, top: float = 25.0) -> Column:
    """Weight of the positive class: negatives per positive, kept within [1, top]."""
    p = _c(positive_rate)
    return F.least(F.greatest((1 - p) / F.greatest(p, F.lit(1e-4)), F.lit(1.0)), F.lit(top))


def mix(b: Column, i: Column, seed: int) -> Column:
    """Repeatable whole-number draw in [0, 2147483647) from a trial and an item number."""
    m = 2147483647
    return ((b.cast("bigint") * 7919 + i.cast("bigint") * 104729 + seed) % m * 48271) % m
