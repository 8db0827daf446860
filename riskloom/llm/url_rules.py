"""Allow / block rules for URLs: a broadcast trie over reversed host labels
and path segments, longest match first.

A rule is a host (it and all its subdomains) and an optional path prefix.  The
trie goes down the host labels from the right, then the path segments that a
rule holds whole; what a rule has after its last ``/`` is a prefix kept at the
node.  The walk keeps the last rule met, which is the longest: more host
labels win over fewer, then the longer path.  Rules are configuration, so the
broadcast is bounded by ``max_rules``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEP = "\0"  # from host labels to path segments; no host or path label is NUL


@dataclass(frozen=True)
class Rule:
    """``text`` is the host followed by the path, such as ``org/`` or ``a.org/x``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def build_trie(rules: Sequence[Rule]) -> dict:
    """Nested dicts; a node's rules are under the key None as
    [(tail prefix, rule text, verdict)], longest tail first."""
    root: dict = {}
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(SEP, {})
        *whole, tail = rule.path.split("/")[1:]
        for segment in whole:
            node = node.setdefault(segment, {})
        here = node.setdefault(None, [])
        if any(t == tail for t, _, _ in here):
            raise ValueError(f"two rules for {rule.text}")
        here.append((tail, rule.text, rule.verdict))
        here.sort(key=lambda x: -len(x[0]))
    return root


def _in_paths(node: dict, path: str) -> tuple[str, str] | None:
    if not path.startswith("/"):
        return None  # every rule's path starts with /
    best, at = None, 1
    while node is not None:
        rest = path[at:]
        best = next((x[1:] for x in node.get(None, ()) if rest.startswith(x[0])), best)
        end = path.find("/", at)
        node, at = (None, at) if end < 0 else (node.get(path[at:end]), end + 1)
    return best


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule text, verdict) of the longest rule that fits, else None."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            return best
        best = (_in_paths(node[SEP], path) if SEP in node else None) or best
    return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.when(url.contains("://"), F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.when(url.contains("://"), F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", max_rules: int = 100_000) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row.

    A null url, or one without ``://``, has an empty host and path and gets the
    default verdict.  Rows are judged one by one: repeated rows, null ids and
    empty tables need no care, other columns are ignored.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the broadcast is bounded at {max_rules}")
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [match(trie.value, h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    url = F.col("url").cast("string")
    return (pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"))
            .mapInArrow(run, "page_id long, host string, path string, rule string, verdict string"))
