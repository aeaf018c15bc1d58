"""Query registry.

A query declares its result columns once (``"ticker:s date:d ret:f n:i"``). From that
one declaration come the final Spark projection and the outer SELECT of its SQL, so
both sides have the same names, types and rounding.

Column kinds: s string, d date, t timestamp, i whole number, b boolean,
f double to 6 places, g double to 4 places, l list of strings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.plans.ctes import with_views
from bellwether.sources.views import Views


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    columns: str
    build: Callable[[Views], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def _pairs(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.rsplit(":", 1)) for c in columns.split()]


def present(df: DataFrame, columns: str) -> DataFrame:
    """The declared columns in plain comparable types."""
    out = []
    for name, kind in _pairs(columns):
        c = F.col(f"`{name}`")
        if kind == "d":
            c = F.substring(c.cast("string"), 1, 10)
        elif kind == "t":
            c = F.substring(c.cast("string"), 1, 19)
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "s":
            c = c.cast("string")
        elif kind == "f":
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind == "g":
            c = F.round(c.cast("double"), 4) + F.lit(0.0)
        elif kind == "l":
            c = F.array_join(c, " ")
        out.append(c.alias(name))
    return df.select(*out)


def present_sql(body: str, columns: str) -> str:
    out = []
    for name, kind in _pairs(columns):
        c = f'"{name}"'
        e = {
            "d": f"strftime(CAST({c} AS DATE), '%Y-%m-%d')",
            "t": f"strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')",
            "i": f"CAST({c} AS BIGINT)",
            "s": f"CAST({c} AS VARCHAR)",
            "f": f"ROUND(CAST({c} AS DOUBLE), 6) + CAST(0 AS DOUBLE)",
            "g": f"ROUND(CAST({c} AS DOUBLE), 4) + CAST(0 AS DOUBLE)",
            "b": f"CAST({c} AS BOOLEAN)",
            "l": f"array_to_string({c}, ' ')",
        }[kind]
        out.append(f"{e} AS {c}")
    return f"SELECT {', '.join(out)} FROM result"


def query(name: str, ids: str, columns: str, sql: str | None = None, views: str = ""):
    """Register ``build(views)``. ``sql`` may use the views named in ``views``, and may
    itself be ``name AS (...), ..., SELECT`` parts separated by a line of ``---``."""

    def register(build: Callable[[Views], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"query {name} registered twice")
        text = None
        if sql is not None:
            *steps, body = [p.strip().rstrip(",") for p in sql.split("\n---\n")]
            steps.append(f"result AS ({body})")
            text = with_views(views.split(), steps, present_sql(body, columns))
        CATALOGUE[name] = Query(name, ids, columns, build, text)
        return build

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = CATALOGUE[name]
    return present(q.build(Views(spark, sf_dir)), q.columns)
