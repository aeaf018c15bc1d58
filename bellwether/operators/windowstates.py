"""Rolling count, mean, deviation, least and greatest value from window states that merge.

A sliding frame aggregates all its rows again for every row and every function. Here only the
shortest span is a frame; its state (n, mean, sum of squared differences, least, greatest)
is merged with lagged states beside it, so a span of 30 rows is three lagged states of 10
and a lag reads one row whatever the span. All share the exchange and the sort of the
panel. Squared differences are merged, never subtracted, so a deviation does not cancel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EMPTY = "named_struct('n', 0L, 'mean', 0D, 'm2', 0D, 'low', cast(null AS double), 'high', cast(null AS double))"


def _framed(x: str, span: int, order: str) -> Column:
    """The state of the ``span`` rows before the current one, aggregated from the rows."""
    w = f"OVER (PARTITION BY ticker ORDER BY `{order}` ROWS BETWEEN {span} PRECEDING AND 1 PRECEDING)"
    v = f"cast(`{x}` AS double)"
    return F.expr(f"named_struct('n', count({v}) {w}, 'mean', coalesce(avg({v}) {w}, 0D), "
                  f"'m2', coalesce(var_pop({v}) {w} * count({v}) {w}, 0D), 'low', min({v}) {w}, 'high', max({v}) {w})")


def _lagged(state: str, rows: int, order: str) -> Column:
    return F.expr(f"lag(`{state}`, {rows}, {_EMPTY}) OVER (PARTITION BY ticker ORDER BY `{order}`)")


def merged(a: str, b: str) -> Column:
    """The state of the rows of two states, given by name, that share none; an empty one changes nothing."""
    n = f"`{a}`.n + `{b}`.n"
    share, apart = f"`{b}`.n / greatest({n}, 1L)", f"(`{b}`.mean - `{a}`.mean)"
    return F.expr(f"named_struct('n', {n}, 'mean', `{a}`.mean + {apart} * ({share}), "
                  f"'m2', `{a}`.m2 + `{b}`.m2 + {apart} * {apart} * `{a}`.n * ({share}), "
                  f"'low', least(`{a}`.low, `{b}`.low), 'high', greatest(`{a}`.high, `{b}`.high))")


def pieces(span: int, built: list[int]) -> list[tuple[int, int]] | None:
    """(length, offset) of the built states that cover ``span`` rows, longest first; null if they cannot."""
    out, done = [], 0
    while done < span:
        fits = [b for b in built if b <= span - done]
        if not fits:
            return None
        out.append((max(fits), done))
        done += max(fits)
    return out


def rolling_states(df: DataFrame, series: list[str], spans: list[int], order: str = "date") -> DataFrame:
    """Adds ``<series>__<span>``, the state of the ``span`` rows before the current one, per ticker.

    The shortest span, and one that shorter spans cannot fill, is aggregated from its rows. Null values are not counted; where
    none is left, n, mean and m2 are 0 and low and high null. NaN and infinite values make mean and m2 NaN for the spans
    that hold them. Rows should be unique per (ticker, order), else equal ones stand as the sort leaves them. An empty
    table gives an empty table.
    """
    if not spans or min(spans) < 1:
        raise ValueError("spans are whole numbers from 1")
    built: list[int] = []
    for span in sorted(set(spans)):
        parts = pieces(span, built)
        if parts is None:
            df = df.withColumns({f"{s}__{span}": _framed(s, span, order) for s in series})
        else:
            (first, _), rest = parts[0], parts[1:]
            lags = {f"_{s}_{at}": _lagged(f"{s}__{k}", at, order) for s in series for k, at in rest}
            df = df.withColumns(lags)
            for k, (_, at) in enumerate(rest):
                df = df.withColumns({f"{s}__{span}": merged(f"{s}__{first if k == 0 else span}", f"_{s}_{at}") for s in series})
            df = df.drop(*lags)
        built.append(span)
    return df


def _state(name: str, then: str, least: int = 1) -> Column:
    return F.expr(f"CASE WHEN `{name}`.n >= {least} THEN {then.format(f'`{name}`')} END")


def mean(state: str) -> Column:
    return _state(state, "{0}.mean")


def std_pop(state: str) -> Column:
    return _state(state, "sqrt({0}.m2 / {0}.n)")


def std_samp(state: str) -> Column:
    return _state(state, "sqrt({0}.m2 / ({0}.n - 1))", 2)


def low(state: str) -> Column:
    return F.expr(f"`{state}`.low")


def high(state: str) -> Column:
    return F.expr(f"`{state}`.high")
