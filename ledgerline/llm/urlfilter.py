"""URL filters: a trie over reversed host labels and path segments, longest match first.

Each rule is a host and a path prefix with a verdict. It fits its host and all
subdomains where the url's path starts with the rule's path. Of the rules that fit, the
one with the longest text (host + path) wins, so a long allow entry reopens part of a
blocked site and the other way round.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no
rule; urls that fit none get ``default``. An empty table gives an empty result; equal
urls get equal verdicts; other columns pass through, clashing names raise ``ValueError``.
Two rules with the same host and path must agree, else ``ValueError``.

The rule list is broadcast. Its size is checked against ``max_rules``; beyond it
:func:`judge_urls` cuts the list into several tries that are read one after another and
compared by length, so no single broadcast grows with the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

#: Rules in one broadcast trie (about 200 bytes each).
MAX_RULES = 200_000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    """A host label or a path segment; ``tails``: rules that end within the next segment."""

    labels: dict[str, _Node] = field(default_factory=dict)
    segments: dict[str, _Node] = field(default_factory=dict)
    tails: list[tuple[str, Rule]] = field(default_factory=list)


def split_url(url: str | None) -> tuple[str, str]:
    """(host in lower case, path), both empty where there is no ``://``."""
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        seen: dict[str, str] = {}
        for r in rules:
            if seen.setdefault(f"{r.host}\0{r.path}", r.verdict) != r.verdict:
                raise ValueError(f"two verdicts for {r.text}")
            node = self.root
            for label in reversed(r.host.split(".")):
                node = node.labels.setdefault(label, _Node())
            *whole, tail = r.path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            node.tails.append((tail, r))

    def match(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of equally long ones the first in text order."""
        best: Rule | None = None
        node, parts = self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            at = node
            for segment in parts:
                for tail, rule in at.tails:
                    if segment.startswith(tail) and (best is None or (-len(rule.text), rule.text) < (-len(best.text), best.text)):
                        best = rule
                at = at.segments.get(segment)
                if at is None:
                    break
        return best


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """``df`` plus host, path, rule (the winner's text or null) and verdict."""
    added = ("host", "path", "rule", "verdict")
    if clash := {c.lower() for c in df.columns} & set(added):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    spark = df.sparkSession
    ship(spark)
    ordered = sorted(set(rules), key=lambda r: (r.host, r.path, r.verdict))
    UrlTrie(ordered)  # conflicting rules are found here, not on the executors
    parts = [spark.sparkContext.broadcast(ordered[i : i + max_rules]) for i in range(0, len(ordered), max_rules)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [UrlTrie(p.value) for p in parts]
        for batch in batches:
            out = []
            for u in batch.column(url).to_pylist():
                host, path = split_url(u)
                fits = [m for t in tries if (m := t.match(host, path))]
                best = min(fits, key=lambda r: (-len(r.text), r.text)) if fits else None
                out.append((host, path, best and best.text, best.verdict if best else default))
            columns = [pa.array(list(c), type=pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], type=pa.string())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, " + ", ".join(f"{a} string" for a in added))
