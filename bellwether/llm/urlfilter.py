"""URL filters: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.llm.common import unused

MAX_RULES = 200_000


@dataclass
class Node:
    """One host label or path segment. ``tails``: (start of the next segment, rule number), longest first."""

    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    tails: list[tuple[str, int]] = field(default_factory=list)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def build_trie(rules: list[Rule]) -> Node:
    """The path of a rule may end within a segment: its last part is kept as a tail of the node before."""
    root = Node()
    for no, rule in enumerate(rules):
        at = root
        for label in reversed(rule.host.split(".")):
            at = at.labels.setdefault(label, Node())
        *whole, tail = rule.path.split("/")
        for segment in whole:
            at = at.segments.setdefault(segment, Node())
        at.tails.append((tail, no))
        at.tails.sort(key=lambda t: (-len(t[0]), t[1]))
    return root


def precedence(rule: Rule) -> tuple:
    """Longest rule first; of equal length the one with the longer host; then allow before block; then by name."""
    return (-len(rule.name), -len(rule.host), rule.verdict != "allow", rule.name)


def longest_match(root: Node, rules: list[Rule], host: str, path: str) -> int | None:
    """Number of the rule that decides, or None."""
    best, at = None, root
    segments = path.split("/")
    for label in reversed(host.split(".")):
        at = at.labels.get(label)
        if at is None:
            break
        here = at
        for segment in segments:
            found = next((no for tail, no in here.tails if segment.startswith(tail)), None)
            if found is not None and (best is None or precedence(rules[found]) < precedence(rules[best])):
                best = found
            here = here.segments.get(segment)
            if here is None:
                break
    return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``.

    ``rules`` are (allow or block, host, path). A rule fits its host and all subdomains if the
    path starts with the rule's. The longest fitting rule decides; without one, ``rule`` is null
    and the verdict is ``default``. Null urls, and urls without ``://``, have an empty host and path
    and fit no rule. Equal rules count once, allow before block. Rows, repeated or not, are kept one by
    one, and columns of ``pages`` with the names of results are replaced.

    The trie is broadcast, so there may be at most ``MAX_RULES`` rules; beyond it use ``judge_by_join``.
    """
    ordered = _ordered(rules)
    if len(ordered) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: use judge_by_join")
    shared = pages.sparkSession.sparkContext.broadcast((build_trie(ordered), ordered))

    @F.pandas_udf("rule string, verdict string")
    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        trie, known = shared.value
        found = [longest_match(trie, known, h, p) for h, p in zip(hosts, paths, strict=True)]
        rows = [(None, default) if no is None else (known[no].name, known[no].verdict) for no in found]
        return pd.DataFrame(rows, columns=["rule", "verdict"])

    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    mine = unused(out, "decided")
    out = out.withColumn(mine, decide("host", "path"))
    return out.withColumns({"rule": F.col(f"{mine}.rule"), "verdict": F.col(f"{mine}.verdict")}).drop(mine)


def judge_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """As ``judge``, for a rule table (verdict, host, path) of any size, which is joined and not broadcast by us.

    Each different host and path meets the rules on (host suffix, path up to a slash).
    """
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rules = rules.select("verdict", F.col("host").alias("suffix"), F.col("path").alias("start"))
    rules = rules.withColumn("head", F.regexp_extract("start", "(?s)^(.*/)?", 0))
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), k -> substring_index(host, '.', -k))")
    heads = F.expr("transform(sequence(0, size(split(path, '/')) - 1), k -> concat(substring_index(path, '/', k), if(k > 0, '/', '')))")
    probes = out.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).withColumn("head", F.explode(heads))
    name = F.concat("suffix", "start")
    order = F.struct(-F.length(name), -F.length("suffix"), F.col("verdict") != "allow", name)
    best = (
        probes.join(rules, ["suffix", "head"])
        .filter(F.expr("startswith(path, start)"))
        .groupBy("host", "path")
        .agg(F.min(F.struct(order.alias("o"), name.alias("rule"), F.col("verdict"))).alias("_best"))
    )
    joined = out.drop("rule", "verdict").join(best, ["host", "path"], "left")
    joined = joined.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))})
    return joined.select(*dict.fromkeys([*pages.columns, "host", "path", "rule", "verdict"]))


def _ordered(rules: Iterable[tuple[str, str, str]]) -> list[Rule]:
    found: dict[str, Rule] = {}
    for rule in sorted((Rule(*r) for r in rules), key=precedence):
        found.setdefault(f"{rule.host}\n{rule.path}", rule)
    return list(found.values())
