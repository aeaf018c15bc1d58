"""Text expressions: cleaning, tokens, token runs and name matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the token pattern.
TOKEN_PATTERN = r"[a-z][a-z0-9'\-]*"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_title(c: Column | str) -> Column:
    """Null to empty, whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[ \t\r\n\f\x0B]+", " "))


def tokenize(c: Column | str) -> Column:
    """Lower-case word tokens of at least two characters, in order."""
    found = F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 2)


def matches(c: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    return _c(c).rlike(("(?i)" if ignore_case else "") + pattern)


def at(arr: Column | str, index: int, default: str = "") -> Column:
    """Element at a 1-based (or negative) index, or the default when missing."""
    return F.coalesce(F.try_element_at(_c(arr), F.lit(index)), F.lit(default))


def event_key(o1: Column | str, p: Column | str, o2: Column | str) -> Column:
    """Head word of each part: last of the actor, first of the predicate, last of the object."""
    return F.concat_ws("|", at(o1, -1), at(p, 1), at(o2, -1))


def token_runs(tokens: Column | str, longest: int = 4) -> Column:
    """Distinct concatenations of 1..longest consecutive tokens.

    Linear in the text: for each run length the shifted lists are zipped, never nested.
    """
    t = _c(tokens)
    n = F.size(t)

    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(1), n - (k - 1))
        return F.when(n >= k, F.transform(
            starts, lambda i: F.concat(*[F.get(t, i + (j - 1)) for j in range(k)]))
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(k) for k in range(1, longest + 1)]))


def is_run(tokens: Column | str, name: Column | str, longest: int = 4) -> Column:
    """Is ``name`` exactly the concatenation of up to ``longest`` consecutive tokens?

    Only positions whose token begins the name are looked at further.
    """
    t, n = _c(tokens), _c(name)

    def joined(i: Column, k: int) -> Column:
        return F.concat(*[F.get(t, i + j) for j in range(k)]) if k > 1 else F.get(t, i)

    def here(i: Column) -> Column:
        same = joined(i, 1) == n
        for k in range(2, longest + 1):
            same = same | F.coalesce(joined(i, k) == n, F.lit(False))
        return F.startswith(n, F.get(t, i)) & same

    return F.when(F.size(t) > 0, F.exists(F.sequence(F.lit(0), F.size(t) - 1), here)).otherwise(F.lit(False))


def named_runs(tokens: Column | str, names: Column | str, longest: int = 4) -> Column:
    """Those of ``names`` that are exactly the concatenation of up to ``longest`` consecutive tokens.

    One pass over the tokens finds the names that are a token and the tokens that begin another name; only from these are runs made.
    """
    t, names = _c(tokens), _c(names)
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(n) - 1, F.lit(1))), lambda i: n.substr(F.lit(1), i))
    joined = lambda i: F.array(*[F.concat(*[F.get(t, i + j) for j in range(k)]) for k in range(2, longest + 1)])

    def runs(near: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.array_contains(near, F.get(t, i)))
        return F.when(F.size(near) > 0, F.flatten(F.transform(at, joined))).otherwise(F.array().cast("array<string>"))

    def both(single: Column) -> Column:
        near = F.array_intersect(t, F.flatten(F.transform(F.array_except(names, single), starts)))
        return F.array_intersect(names, F.concat(single, once(near, runs)))

    return once(F.array_intersect(names, t), both)


def word_match(text: Column | str, name: Column | str) -> Column:
    """Literal occurrence of ``name`` with no letter, digit or ampersand on either side."""
    edge = "[0-9A-Za-z&]"
    pat = F.concat(F.lit(f"(?<!{edge})\\Q"), _c(name), F.lit(f"\\E(?!{edge})"))
    return F.regexp_like(_c(text), pat)


def strip_suffix(c: Column | str) -> Column:
    """Drop the exchange suffix of a ticker."""
    return F.regexp_replace(_c(c), r"\.(KS|KQ)", "")


def id_time(c: Column | str) -> Column:
    """Timestamp held as 14 digits after the ninth character of an id; null if malformed."""
    digits = F.substring(_c(c), 10, 14)
    stamp = F.concat_ws(" ", F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2),
                                         F.substring(digits, 7, 2)),
                        F.concat_ws(":", F.substring(digits, 9, 2), F.substring(digits, 11, 2),
                                    F.substring(digits, 13, 2)))
    # try_cast keeps the value free of any time zone
    return F.when(digits.rlike(r"^\d{14}$"), stamp.try_cast("timestamp_ntz"))
