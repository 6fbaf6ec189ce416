"""URL filter: a trie over reversed host labels and path segments decides by the longest match.

A rule is (host, path, verdict). It fits a URL whose host is the rule's host or a subdomain of it and
whose path starts with the rule's path. Of the rules that fit, the one whose ``host + path`` is longest
wins; of equally long ones a block rule goes before an allow rule, and then the longer host.

Defined cases: a null URL, or one without ``://``, has empty host and path and so the default verdict;
empty host labels and ports are taken literally; in rules as in URLs only A-Z of a host are lower-cased;
repeated rows are judged alike; other columns of the input are left alone.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of rules up to which the trie is broadcast; beyond it the rules are joined, with equal results.
BROADCAST_CHARS = 64_000_000

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class UrlTrie:
    """Trie over reversed host labels; below each host a trie over whole path segments. A node of the latter
    has the rules whose path ends in it: the last, unfinished segment leads to the verdict. Such ends are
    sought by the prefixes of a URL's segment, for the lengths that the node has, so a node's cost follows
    those lengths and not its rules."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        nodes = []
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a verdict is allow or block, not {verdict!r}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            segments = path.split("/")
            node = node.setdefault("paths", {})
            for segment in segments[:-1]:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            if "ends" not in node:
                node["ends"] = {}
                nodes.append(node)
            node["ends"][segments[-1]] = node["ends"].get(segments[-1], False) or verdict == "block"
        for node in nodes:
            node["sizes"] = sorted({len(end) for end in node["ends"]}, reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the rule that wins, or None."""
        best: tuple[int, bool, int] | None = None
        segments = path.split("/")
        node, host_size = self.root, -1
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            host_size += 1 + len(label)
            below, before = node.get("paths"), 0
            for segment in segments:
                if below is None:
                    break
                for size in below.get("sizes", ()):
                    # The first end found in a node is its longest, as sizes fall.
                    if size <= len(segment) and (blocks := below["ends"].get(segment[:size])) is not None:
                        found = (host_size + before + size, blocks, host_size)
                        best = max(best or found, found)
                        break
                below = below.get("segments", {}).get(segment)
                before += len(segment) + 1
        if best is None:
            return None
        total, blocks, host_size = best
        return host[len(host) - host_size :] + path[: total - host_size], "block" if blocks else "allow"


_BUILT: dict[int, UrlTrie] = {}


def _trie(shared: Broadcast) -> UrlTrie:
    """The worker's trie, built once for each broadcast list of rules."""
    if shared._path not in _BUILT:
        _BUILT.clear()
        _BUILT[shared._path] = UrlTrie(shared.value)
    return _BUILT[shared._path]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    No shuffle: the trie goes to every task while the rules are at most ``BROADCAST_CHARS`` long.
    A longer list is joined instead, see ``judge_urls_by_join``. Columns of ``df`` that have one of
    the four names are replaced.
    """
    rules = [(h.translate(_LOWER), p, v) for h, p, v in rules]
    if sum(len(h) + len(p) for h, p, _ in rules) > BROADCAST_CHARS:
        table = df.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
        return judge_urls_by_join(df, table, url_col, default)
    shared = df.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf("struct<rule string, verdict string>")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = _trie(shared).match
        found = [match(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    url = F.col(url_col)
    kept = [F.col(c) for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    parts = df.select(*kept, url_host(url).alias("host"), url_path(url).alias("path"))
    out = parts.withColumn("__j", judged("host", "path"))
    return out.select(*parts.columns, F.col("__j.rule").alias("rule"), F.col("__j.verdict").alias("verdict"))


def judge_urls_by_join(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same for ``rules`` (rule_host, rule_path, rule_verdict) of any number.

    Each distinct (host, path) is joined with the rules' path lengths by its hosts, then with the rules
    themselves by host and path prefix: rows follow the lengths that a host's rules have, not its rules.
    """
    url = F.col(url_col)
    kept = [F.col(c) for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    parts = df.select(*kept, url_host(url).alias("host"), url_path(url).alias("path"))
    lowered = F.translate("rule_host", string.ascii_uppercase, string.ascii_lowercase)
    rules = rules.select(lowered.alias("rule_host"), "rule_path", (F.col("rule_verdict") == "block").alias("blocks"))
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("blocks").alias("blocks"))
    lengths = rules.select("rule_host", F.length("rule_path").alias("size")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    tried = parts.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes)).join(lengths, "rule_host")
    tried = tried.where(F.col("size") <= F.length("path")).withColumn("rule_path", F.expr("substring(path, 1, size)"))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), "blocks", F.length("rule_host"))
    best = tried.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path").agg(
        F.max(F.struct(rank.alias("rank"), F.concat("rule_host", "rule_path").alias("rule"), "blocks")).alias("__b")
    )
    out = parts.join(best, ["host", "path"], "left")
    verdict = F.when(F.col("__b").isNull(), F.lit(default)).when(F.col("__b.blocks"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*parts.columns, F.col("__b.rule").alias("rule"), verdict.alias("verdict"))
