"""URL filter: longest matching allow or block rule, found in a trie of host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from postmart.llm.common import sql_lower

#: Largest rule list that is sent to every executor (about 200 bytes a rule).  Longer lists are refused.
MAX_RULES = 1_000_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # without a leading dot; '' fits every host
    path: str  # '' fits every path


class _PathNode:
    """Rules by their path: complete segments lead to children, the rest of the last segment is a tail."""

    __slots__ = ("children", "tails", "lengths")

    def __init__(self):
        self.children: dict[str, _PathNode] = {}
        self.tails: dict[str, Rule] = {}
        self.lengths: list[int] = []


class _HostNode:
    __slots__ = ("children", "anywhere", "paths")

    def __init__(self):
        self.children: dict[str, _HostNode] = {}
        self.anywhere: Rule | None = None
        self.paths: _PathNode | None = None


def _stronger(old: Rule | None, new: Rule) -> Rule:
    """Of two rules for the same place the blocking one counts."""
    return new if old is None or new.verdict == "block" else old


def build_trie(rules: Sequence[Rule]) -> _HostNode:
    root = _HostNode()
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")) if rule.host else ():
            node = node.children.setdefault(label, _HostNode())
        if not rule.path:
            node.anywhere = _stronger(node.anywhere, rule)
            continue
        if not rule.path.startswith("/"):
            raise ValueError(f"a rule's path starts with '/': {rule}")
        *whole, tail = rule.path[1:].split("/")
        place = node.paths = node.paths or _PathNode()
        for segment in whole:
            place = place.children.setdefault(segment, _PathNode())
        place.tails[tail] = _stronger(place.tails.get(tail), rule)
        if len(tail) not in place.lengths:
            place.lengths = sorted([*place.lengths, len(tail)], reverse=True)
    return root


def _longest_path(node: _PathNode, segments: list[str]) -> Rule | None:
    """The deepest node that fits has the longest path; in a node the longest tail."""
    best = None
    for depth, segment in enumerate(segments):
        for length in node.lengths:
            if (rule := node.tails.get(segment[:length])) and len(segment) >= length:
                best = rule
                break
        if depth + 1 == len(segments) or (node := node.children.get(segment)) is None:
            break
    return best


def match(root: _HostNode, host: str, path: str) -> Rule | None:
    """Longest rule (characters of host and path together) that fits; of equally long ones the longer host."""
    best: Rule | None = None
    segments = path[1:].split("/") if path.startswith("/") else None
    node: _HostNode | None = root
    for label in [None, *(reversed(host.split(".")) if host else ())]:
        node = node if label is None else node.children.get(label)
        if node is None:
            break
        for rule in (node.anywhere, segments and node.paths and _longest_path(node.paths, segments)):
            if rule and (best is None or len(rule.host) + len(rule.path) >= len(best.host) + len(best.path)):
                best = rule
    return best


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path without query and fragment); ('', '') for NULL or without '://'."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, the deciding rule as ``host + path`` and its verdict.

    The trie is compiled once on the driver and broadcast; the list is refused beyond ``MAX_RULES``.  Only
    the id and the url are read, there is no shuffle, and rows are independent of each other.

    NULL urls and urls without ``://`` have an empty host and path.  Without a fitting rule ``rule`` is
    NULL and the verdict is ``default``.  A path rule never fits an empty path.  Repeated rows give
    repeated results, an empty table none, further columns are ignored, and long urls cost their length."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are sent to every executor")
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast([tuple(r) for r in rules])

    def judge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = build_trie([Rule(*r) for r in shared.value])
        for batch in batches:
            parts = [split_url(u) for u in batch["url"]]
            found = [match(trie, h, p) for h, p in parts]
            yield pd.DataFrame({
                "id": batch["id"],
                "host": [h for h, _ in parts],
                "path": [p for _, p in parts],
                "rule": [r.host + r.path if r else None for r in found],
                "verdict": [r.verdict if r else default for r in found],
            })

    narrow = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"))
    out = narrow.mapInPandas(judge, "id bigint, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


#: The rules of the registered query.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]

_RULE_ROWS = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)

SQL = rf"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_RULE_ROWS}),
parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
),
hosts AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS host FROM parts),
urls AS (
  SELECT page_id, {sql_lower('host')} AS host,
    regexp_extract(substr(coalesce(rest, ''), length(host) + 1), '^[^?#]*') AS path FROM hosts
),
fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM urls) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (page_id)
"""
