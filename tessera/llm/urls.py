"""URL filter: allow and block rules in a trie of reversed host labels, then path segments.

A rule `example.org/en/1` fits example.org and its subdomains when the path starts with `/en/1`. Of the rules
that fit, the one with the most characters, host and path together, wins; a block wins a tie.
The trie is as large as the rule list (`max_rules` at most) and goes to every task.

Null urls and urls without `://` have an empty host and path, which no rule fits: they get the default verdict. Each row
is judged by itself; repeated and null keys make no difference.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.common import map_rows


@dataclass
class Node:
    """labels and segments: the next nodes; starts: rules whose last, possibly partial, segment begins here."""

    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    starts: list[tuple[str, str, str]] = field(default_factory=list)


def trie(rules: list[tuple[str, str]], max_rules: int = 1_000_000) -> Node:
    """rules: (verdict, host/path)."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the trie is made for {max_rules} at most")
    root = Node()
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {verdict}")
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, last = (slash + path).split("/")  # "/en/1": "", "en", "1"
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        node.starts.append((last, verdict, rule))
    for node in walk(root):
        node.starts.sort(key=lambda x: (-len(x[0]), x[1] != "block"))
    return root


def walk(node: Node):
    left = [node]
    while left:
        node = left.pop()
        yield node
        left += [*node.labels.values(), *node.segments.values()]


def judge(root: Node, host: str, path: str) -> tuple[str | None, str | None]:
    """The rule that wins and its verdict, or None twice."""
    node, hosts = root, []
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        hosts.append(node)
    parts, best = path.split("/"), (0, False, None, None)
    for node in hosts:
        for segment in parts:
            for last, verdict, rule in node.starts:
                if segment.startswith(last):  # the longest of those that begin here
                    best = max(best, (len(rule), verdict == "block", rule, verdict), key=lambda x: x[:2])
                    break
            node = node.segments.get(segment)
            if node is None:
                break
    return best[2:]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the end."""
    url = F.coalesce(url, F.lit(""))
    there = F.locate("://", url)
    rest = F.when(there > 0, url.substr(there + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict for each row."""
    root = trie(rules)
    host, path = host_and_path(F.col(url))
    rows = pages.select(key, host.alias("host"), path.alias("path"))
    schema = StructType([*rows.schema, StructField("rule", StringType()), StructField("verdict", StringType())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [judge(root, h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())], [x.name for x in schema])

        return work

    return map_rows(rows, schema, make, 5000)
